"""Product catalog: rules, versions by content, carry-over, precedence and membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.functions.hashing import canonical_json
from placemetrics.functions.ranks import positions
from placemetrics.operators.quality import issue_array

# Kinds, subjects, methods, issue codes by category.
REPAYABLE = ("LOAN",)
POLICY_LOANS = ("LOAN", "GUARANTEE")
REPAYMENT_SUPPORTED = ("EQUAL_INSTALLMENT", "EQUAL_PRINCIPAL")
PRIMARY_METHODS = ("OFFICIAL_WEB_PAGE", "OFFICIAL_ATTACHMENT", "OFFICIAL_API")
FILE_METHODS = ("OFFICIAL_ATTACHMENT", "OFFICIAL_API")
CATEGORY_OF = {
    "SCHEMA_INVALID": "schema", "DUPLICATE_PRODUCT_VERSION": "duplicates", "DUPLICATE_EVIDENCE_ID": "duplicates",
    "DUPLICATE_SOURCE_REF": "duplicates", "DUPLICATE_SOURCE_SYNC": "duplicates", "MISSING_EVIDENCE": "evidence",
    "EVIDENCE_NOT_PRIMARY": "evidence", "EVIDENCE_OBSERVED_AT_AFTER_BASIS_DATE": "evidence",
    "SYNCED_PRODUCT_WITHOUT_SOURCE": "evidence", "EVIDENCE_CHECKSUM_NOT_APPLICABLE": "checksum",
    "EVIDENCE_CHECKSUM_MISSING": "checksum", "CHECKSUM_MISSING": "checksum", "CHECKSUM_NOT_RETRIEVED": "checksum",
    "APPLICATION_PERIOD_CONTRADICTION": "dates", "APPLICATION_PERIOD_NOTE_MISSING": "dates",
    "OBSERVED_OPEN_AFTER_PERIOD_END": "dates", "OBSERVED_OPEN_BEFORE_PERIOD_START": "dates",
    "OBSERVED_AT_AFTER_BASIS_DATE": "dates", "CLOSED_BEFORE_PERIOD_END": "dates",
    "REGION_DISTRICT_CONTRADICTION": "support", "REGION_DISTRICTS_MISSING": "support",
    "INDUSTRY_SCOPE_CONTRADICTION": "support", "INDUSTRY_INCLUDE_EXCLUDE_CONFLICT": "support",
    "PURPOSE_INCLUDE_EXCLUDE_CONFLICT": "support", "SUPPORT_TYPE_FINANCIAL_CONTRADICTION": "support",
    "INTEREST_CONFIRMED_WITHOUT_CONDITION": "support", "INTEREST_RATE_NOT_CONFIRMED": "support",
    "REPAYMENT_PERIOD_CONTRADICTION": "support", "CALCULATION_REASON_MISSING": "calculation",
    "CALCULATION_REASON_UNEXPECTED": "calculation"}
CATEGORIES = ("schema", "duplicates", "evidence", "dates", "support", "checksum", "calculation")
WARNINGS = ("EVIDENCE_NOT_PRIMARY", "CLOSED_BEFORE_PERIOD_END")
VOLATILE = ("version", "observed_at")
VOLATILE_EVIDENCE = ("observed_at", "checksum")
LEGACY_STAGES = {"PRE_REGISTRATION": "PRE_STARTUP", "POST_REGISTRATION": "BUSINESS"}
LEGACY_AUTO_PREFIX = "AUTO:"


# ---------------------------------------------------------------- rules

def calculation_reasons(p: str = "") -> Column:
    """Why a repayment cannot be computed; empty for a computable product."""
    c = lambda n: F.col(p + n)
    other = ~c("support_type").isin(*REPAYABLE)
    return F.when(other, F.array(F.lit("NOT_A_LOAN"))).otherwise(issue_array([
        ("NO_PUBLIC_LIMIT", c("public_limit").isNull()),
        ("RATE_NOT_CONFIRMED", ~c("interest_confirmed") | c("interest_rate").isNull()),
        ("METHOD_NOT_SUPPORTED", ~c("repayment_method").isin(*REPAYMENT_SUPPORTED)),
        ("TERM_UNKNOWN", c("term_months").isNull() | c("grace_months").isNull())]))


def required_evidence(full: bool = True) -> Column:
    """Subjects that need evidence; ``full`` adds region, purpose and industry."""
    rules = [("IDENTITY", F.lit(True)), ("APPLICATION_PERIOD", F.lit(True)), ("BUSINESS_STAGE", F.size("stages") > 0),
             ("FINANCIAL_CONDITION", F.col("support_type").isin(*POLICY_LOANS))]
    if full:
        rules += [("REGION", F.col("region.scope") != "UNKNOWN"),
                  ("PURPOSE", (F.size("purpose.included") > 0) | (F.size("purpose.excluded") > 0)),
                  ("INDUSTRY", F.col("industry.scope") != "UNKNOWN")]
    return issue_array(rules)


def missing_evidence(full: bool = True) -> Column:
    return F.array_except(required_evidence(full), F.transform("evidence", lambda e: e["subject"]))


def overlap(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def _evidence_issues(basis: Column) -> Column:
    synced = F.col("origin") == "SYNC"

    def one(e: Column) -> Column:
        file_backed = e["method"].isin(*FILE_METHODS)
        crawled = synced & (e["method"] == "OFFICIAL_WEB_PAGE")
        return issue_array([
            ("EVIDENCE_OBSERVED_AT_AFTER_BASIS_DATE", e["observed_at"] > basis),
            ("EVIDENCE_CHECKSUM_NOT_APPLICABLE", ~file_backed & ~crawled & e["checksum"].isNotNull()),
            ("EVIDENCE_CHECKSUM_MISSING", file_backed & e["checksum"].isNull()),
            ("EVIDENCE_NOT_PRIMARY", ~e["method"].isin(*PRIMARY_METHODS))])

    ids = F.transform("evidence", lambda e: e["id"])
    repeats = F.array_repeat(F.lit("DUPLICATE_EVIDENCE_ID"), F.size(ids) - F.size(F.array_distinct(ids)))
    return F.concat(F.flatten(F.transform("evidence", one)), repeats)


def product_issues(basis_date: str) -> Column:
    """All issue codes of a product row, repeated where a rule fails repeatedly."""
    basis = F.lit(basis_date).cast("date")
    start, end, seen = F.col("period.start"), F.col("period.end"), F.col("observed_at")
    status, kind, method = F.col("status"), F.col("support_type"), F.col("repayment_method")
    terms = F.col("interest_rate").isNotNull() | F.col("term_months").isNotNull() | F.col("grace_months").isNotNull()
    conditions = F.col("interest_condition").isNotNull() | F.col("repayment_condition").isNotNull()
    unknown, loan = kind == "UNKNOWN", kind.isin(*REPAYABLE)
    other = ~unknown & ~loan
    money = "SUPPORT_TYPE_FINANCIAL_CONTRADICTION"
    reasons = calculation_reasons()
    ind, purpose, region = F.col("industry"), F.col("purpose"), F.col("region")
    listed = (F.size(ind["included"]) > 0) | (F.size(ind["excluded"]) > 0)
    rules = [
        ("CHECKSUM_MISSING", F.col("retrieved") & F.col("checksum").isNull()),
        ("CHECKSUM_NOT_RETRIEVED", ~F.col("retrieved") & F.col("checksum").isNotNull()),
        ("APPLICATION_PERIOD_CONTRADICTION", end < start),
        ("APPLICATION_PERIOD_NOTE_MISSING", start.isNull() & end.isNull() & F.col("period.note").isNull()),
        ("OBSERVED_OPEN_AFTER_PERIOD_END", (status == "OPEN") & (end < seen)),
        ("OBSERVED_OPEN_BEFORE_PERIOD_START", (status == "OPEN") & (seen < start)),
        ("CLOSED_BEFORE_PERIOD_END", (status == "CLOSED") & (end > seen)),
        ("OBSERVED_AT_AFTER_BASIS_DATE", seen > basis),
        ("REGION_DISTRICT_CONTRADICTION", (region["scope"] != "DISTRICTS") & (F.size(region["district_codes"]) > 0)),
        ("REGION_DISTRICTS_MISSING", (region["scope"] == "DISTRICTS") & (F.size(region["district_codes"]) == 0)),
        ("INDUSTRY_SCOPE_CONTRADICTION", ((ind["scope"] == "UNRESTRICTED") & listed) | ((ind["scope"] == "LISTED") & ~listed)),
        ("INDUSTRY_INCLUDE_EXCLUDE_CONFLICT", F.size(overlap(ind["included"], ind["excluded"])) > 0),
        ("PURPOSE_INCLUDE_EXCLUDE_CONFLICT", F.size(overlap(purpose["included"], purpose["excluded"])) > 0),
        (money, unknown & (method != "UNKNOWN")), (money, unknown & (F.col("interest_confirmed") | terms)),
        (money, other & conditions), (money, other & (method != "NOT_APPLICABLE")), (money, other & F.col("interest_confirmed")),
        (money, other & terms), (money, loan & (method == "NOT_APPLICABLE")),
        ("INTEREST_CONFIRMED_WITHOUT_CONDITION", F.col("interest_confirmed") & F.col("interest_condition").isNull()),
        ("INTEREST_RATE_NOT_CONFIRMED", ~F.col("interest_confirmed") & F.col("interest_rate").isNotNull()),
        ("REPAYMENT_PERIOD_CONTRADICTION", F.col("grace_months") >= F.col("term_months")),
        ("CALCULATION_REASON_MISSING", (F.size(reasons) > 0) & (F.size("unsupported_reasons") == 0)),
        ("CALCULATION_REASON_UNEXPECTED", (F.size(reasons) == 0) & (F.size("unsupported_reasons") > 0)),
        ("SYNCED_PRODUCT_WITHOUT_SOURCE", (F.col("origin") == "SYNC") & F.col("external_id").isNull())]
    missing = F.transform(missing_evidence(), lambda _: F.lit("MISSING_EVIDENCE"))
    return F.concat(_evidence_issues(basis), missing, issue_array(rules))


def validate_products(products: DataFrame, basis_date: str) -> DataFrame:
    """One row per issue: product key, version, position of the product, order, code, severity."""
    rows = products.select("product_key", "version", "line", F.posexplode(product_issues(basis_date)).alias("ord", "code"))
    return rows.withColumn("severity", F.when(F.col("code").isin(*WARNINGS), "WARNING").otherwise("ERROR"))


def duplicate_products(products: DataFrame) -> DataFrame:
    """Counts of repeated product versions and source references, keys combined before they travel."""
    versions = products.groupBy("product_key", "version").agg(F.count(F.lit(1)).alias("n"))
    refs = (products.where(F.col("external_id").isNotNull()).groupBy("source", "external_id").agg(F.count(F.lit(1)).alias("n")))

    def extra(df: DataFrame, code: str) -> DataFrame:
        return df.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("issue_count")).select(F.lit(code).alias("code"), "issue_count")

    return extra(versions, "DUPLICATE_PRODUCT_VERSION").unionByName(extra(refs, "DUPLICATE_SOURCE_REF"))


def category_checks(issues: DataFrame) -> DataFrame:
    """PASS / WARN / FAIL per category with the count and the first example."""
    cat = None
    for code, name in CATEGORY_OF.items():
        cat = F.when(F.col("code") == code, name) if cat is None else cat.when(F.col("code") == code, name)
    bad = F.col("severity") == "ERROR"
    first = F.struct((~bad).cast("int").alias("s"), F.col("line"), F.col("ord"), F.col("code"), F.col("product_key"))
    per = issues.withColumn("category", cat).groupBy("category").agg(
        F.count(F.when(bad, 1)).alias("_f"), F.count(F.when(~bad, 1)).alias("_w"), F.min(first).alias("_first"))
    every = issues.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    j = every.join(per, "category", "left").na.fill(0, ["_f", "_w"])
    return j.select("category", F.when(F.col("_f") > 0, "FAIL").when(F.col("_w") > 0, "WARN").otherwise("PASS").alias("outcome"),
                    F.when(F.col("_f") > 0, F.col("_f")).otherwise(F.col("_w")).alias("issue_count"),
                    F.col("_first.code").alias("example_code"), F.col("_first.product_key").alias("example_product"))


# ---------------------------------------------------------------- versions

def content_fingerprint(products: DataFrame, volatile: Sequence[str] = VOLATILE,
                        volatile_evidence: Sequence[str] = VOLATILE_EVIDENCE) -> DataFrame:
    """Add ``fingerprint``: SHA-256 of the canonical JSON without fields that change on every run."""
    fields = [f for f in products.schema.fields if f.name not in volatile]
    body, types = [], []
    for f in fields:
        c, t = F.col(f.name), f.dataType
        if f.name == "evidence":
            kept = [e for e in t.elementType.fields if e.name not in volatile_evidence]
            c = F.transform(c, lambda e: F.struct(*[e[k.name].alias(k.name) for k in kept]))
            t = T.ArrayType(T.StructType(kept))
        body.append(c.alias(f.name))
        types.append(T.StructField(f.name, t))
    packed = F.struct(*body)
    return products.withColumn("fingerprint", F.sha2(canonical_json(packed, T.StructType(types)), 256))


def version_parts(version: Column) -> Column:
    """``struct(major, minor, patch)`` of a well-formed version, else null."""
    ok = version.rlike(r"^\d+\.\d+\.\d+$")
    p = F.split(version, r"\.")

    def n(i: int) -> Column:
        return F.get(p, F.lit(i)).try_cast("bigint")

    return F.when(ok, F.struct(n(0).alias("major"), n(1).alias("minor"), n(2).alias("patch")))


def next_patch(stored: DataFrame, key: str = "product_key", version: str = "version") -> DataFrame:
    """Highest version plus one patch per key; 1.0.0 when none is well-formed."""
    top = stored.groupBy(key).agg(F.max(version_parts(F.col(version))).alias("_m"))
    text = F.concat_ws(".", F.col("_m.major").cast("string"), F.col("_m.minor").cast("string"), (F.col("_m.patch") + 1).cast("string"))
    return top.select(key, F.coalesce(F.when(F.col("_m").isNotNull(), text), F.lit("1.0.0")).alias("next_version"))


def assign_versions(products: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored version of equal content, else the next patch; new keys start at 1.0.0.

    ``products``: product_key, fingerprint. ``stored``: product_key, version, fingerprint, line.
    Both joins sort keys and digests, which take many times their shuffled size; numbers of
    partitions that are named keep adaptive execution from merging them into a few large tasks.
    """
    tasks = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = stored.groupBy("product_key", "fingerprint").agg(F.min_by("version", "line").alias("_stored"))
    j = products.repartition(tasks, "product_key", "fingerprint").join(same, ["product_key", "fingerprint"], "left")
    j = j.repartition(tasks, "product_key").join(next_patch(stored), "product_key", "left")
    return j.select(*products.columns, F.coalesce("_stored", "next_version", F.lit("1.0.0")).alias("assigned_version"),
                    F.col("_stored").isNotNull().alias("reused"))


def next_daily(versions: DataFrame, prefix: Column, by: str, manual: Column | None = None) -> DataFrame:
    """``<day>.<n>`` with n one above the highest suffix used for that key and day (and by the manual version)."""
    def suffix(v: Column) -> Column:
        return F.when(v.startswith(F.concat(prefix, F.lit("."))), F.substring(v, F.length(prefix) + 2, F.length(v)).try_cast("int"))

    used = F.greatest(suffix(F.col("version")), suffix(manual)) if manual is not None else suffix(F.col("version"))
    return versions.groupBy(by, prefix.alias("day")).agg(F.coalesce(F.max(F.greatest(used, F.lit(0))), F.lit(0)).alias("_n")).select(
        by, "day", F.concat_ws(".", "day", (F.col("_n") + 1).cast("string")).alias("next_version"))


def check_immutable(products: DataFrame, stored: DataFrame) -> DataFrame:
    """Product versions that exist with other content."""
    s = stored.select("product_key", "version", F.col("fingerprint").alias("_stored"))
    return products.join(s, ["product_key", "version"]).where(F.col("fingerprint") != F.col("_stored")).select("product_key", "version")


# ---------------------------------------------------------------- merge

def carry_over(collected: DataFrame, previous: DataFrame, syncs: DataFrame) -> DataFrame:
    """Products of sources that succeeded, and the previous products of those that failed."""
    ok = syncs.where("succeeded").select("source")
    failed = syncs.where("NOT succeeded").select("source")
    return (collected.join(ok, "source", "left_semi").withColumn("carried_over", F.lit(False))
            .unionByName(previous.join(failed, "source", "left_semi").withColumn("carried_over", F.lit(True))))


def sync_report(syncs: DataFrame, previous: DataFrame, as_of: str) -> DataFrame:
    """Last success date and count per source; a failed source keeps its previous ones."""
    p = previous.select("source", F.col("last_succeeded_on").alias("_d"), F.col("fetched_count").alias("_n"))
    j = syncs.join(p, "source", "left")
    return j.select("source", "succeeded", F.when(F.col("succeeded"), F.lit(as_of).cast("date")).otherwise(F.col("_d")).alias("last_succeeded_on"),
                    F.when(F.col("succeeded"), F.col("fetched_count")).otherwise(F.col("_n")).alias("fetched_count"))


def merge_precedence(manual: DataFrame, auto: DataFrame, ref: Sequence[str] = ("source", "external_id")) -> tuple[DataFrame, DataFrame]:
    """Manual rows and the automatic rows they do not override, and the overridden references."""
    refs = manual.select(*ref).where(F.col(ref[-1]).isNotNull()).distinct()
    kept = auto.join(refs, list(ref), "left_anti")
    return manual.unionByName(kept), auto.join(refs, list(ref), "left_semi").select(*ref)


def added_rows(current: DataFrame, previous: DataFrame, ref: Sequence[str] = ("source", "external_id")) -> DataFrame:
    return current.join(previous.select(*ref).distinct(), list(ref), "left_anti")


def drop_blocked(products: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products without blocked automatic ones, and how many were hidden."""
    b = blocked.select("source", "external_id", F.lit(True).alias("_b")).distinct()
    j = products.join(b, ["source", "external_id"], "left")
    hidden = (F.col("origin") == "SYNC") & F.coalesce("_b", F.lit(False))
    return (j.where(~hidden).select(*products.columns),
            j.agg(F.count(F.when(hidden, 1)).alias("hidden_count"), F.count(F.when(~hidden, 1)).alias("shown_count")))


def pinned_extraction(products: DataFrame, extractions: DataFrame, model: str, prompt: str) -> DataFrame:
    """Extraction of exactly this text by this model and prompt; otherwise NOT_READ."""
    e = extractions.where((F.col("model") == model) & (F.col("prompt_version") == prompt)).select(
        "product_key", "text_checksum", F.col("fields").alias("extracted"))
    j = products.join(e, ["product_key", "text_checksum"], "left")
    return j.withColumn("read_status", F.when(F.col("extracted").isNull(), "NOT_READ").otherwise("AVAILABLE"))


def membership(products: DataFrame) -> DataFrame:
    """Position of every product in a release: manual rows first in their own order, then by key."""
    order = F.when(F.col("origin") == "OPERATOR", F.concat(F.lit("0"), F.lpad(F.col("line").cast("string"), 19, "0"))).otherwise(
        F.concat(F.lit("1"), F.col("product_key")))
    return positions(products.select("product_key", "version", order.alias("_key")), "_key").drop("_key")


# ---------------------------------------------------------------- old shapes

def upgrade_origin(json: Column) -> Column:
    """Origin of a stored product: written, or told by the old reviewer's prefix, else null."""
    o, r = F.get_json_object(json, "$.origin"), F.get_json_object(json, "$.reviewer")
    return F.coalesce(o, F.when(r.startswith(LEGACY_AUTO_PREFIX), "SYNC").when(r.isNotNull(), "OPERATOR"))


PROFILE_KEYS = ("age", "businessStatus", "districtCode", "openedYearMonth", "targetGroups")
LEGACY_KEYS = ("businessStage", "districtCode", "industryCode", "purpose")
LEGACY_REQUIRED = ("businessStage", "districtCode")


def upgrade_profile(json: Column) -> Column:
    """``struct(kind, business_status, opened, district, age, groups, legacy)`` of a stored profile.

    The current shape needs exactly its five keys; the old shape needs stage and district and may
    carry two more; anything else is INVALID. Inputs the old shape lacks stay unanswered.
    """
    schema = "businessStatus string, openedYearMonth string, districtCode string, age int, targetGroups array<string>, businessStage string"
    v = F.from_json(json, schema)
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))

    def has(names: Sequence[str]) -> Column:
        return F.array(*[F.lit(n) for n in names])

    current = (F.array_sort(keys) == has(PROFILE_KEYS)) & F.coalesce(v["businessStatus"].isin("PRE_STARTUP", "BUSINESS"), F.get_json_object(json, "$.businessStatus").isNull())
    legacy = (F.size(F.array_except(keys, has(LEGACY_KEYS))) == 0) & (F.size(F.array_except(has(LEGACY_REQUIRED), keys)) == 0) & v["businessStage"].isin(
        *LEGACY_STAGES, "UNKNOWN")
    stage = None
    for k, s in LEGACY_STAGES.items():
        stage = F.when(v["businessStage"] == k, s) if stage is None else stage.when(v["businessStage"] == k, s)
    kind = F.when(json.isNull(), "NONE").when(current, "OK").when(F.coalesce(legacy, F.lit(False)), "OK_LEGACY").otherwise("INVALID")
    ok, old = kind == "OK", kind == "OK_LEGACY"
    return F.struct(kind.alias("kind"), F.when(ok, v["businessStatus"]).when(old, stage).alias("business_status"),
                    F.when(ok, v["openedYearMonth"]).alias("opened"), F.when(ok | old, v["districtCode"]).alias("district"),
                    F.when(ok, v["age"]).alias("age"), F.when(ok, v["targetGroups"]).alias("groups"))
