"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

One query warms the session up; then every query is timed once, to its last row (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "panel_full_outer", "dup_keys", "join_audit", "table_profile", "breakdown_shares", "trailing_window", "exclusions",
    "median_label", "survival_scores", "score_rank", "revenue_range", "feature_corr", "auc_exact", "ks_exact", "rent_regions",
    "brand_years", "top_brands", "competition_topn", "fin_break_even", "loan_schedule", "cash_runway", "html_lines",
    "quote_verify", "notice_assemble", "period_free", "catalog_rules", "assign_version", "release_fp", "match_pairs",
    "match_counts", "field_outcomes", "set_summary", "source_manifest", "paged_json_complete", "throttle_audit",
]


def main() -> None:
    from placemetrics.plans import registry
    from placemetrics.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])
    for name in names:
        times[name] = round(run(name), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
