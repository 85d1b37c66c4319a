"""Registered queries next to their SQL on the smallest tables.

A spread over all families runs by default; set PLACEMETRICS_ALL=1 for every query, or use
tools/check.py.
"""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = ["panel_full_outer", "cell_quality", "breakdown_quality", "lookup_outcome", "exclusions", "score_rank", "rent_regions", "optional_enrich", "fin_break_even",
        "cash_runway", "html_lines", "status_resolve", "catalog_rules", "membership", "match_counts", "group_outcomes", "paged_json_complete", "release_fp", "throttle_audit"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PLACEMETRICS_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, rows, _, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status in ("OK", "OK-EMPTY"), f"{status} {note}"


def test_entry(spark):
    assert entry.entry(spark).columns


def test_no_python_in_relational_plans(spark):
    for name in ("panel_full_outer", "trailing_window", "survival_scores", "match_pairs"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
