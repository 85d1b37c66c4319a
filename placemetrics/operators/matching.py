"""Matching applicant profiles with notices: three-valued verdicts, groups, lists and counts.

A verdict is a text: ``MATCH``, ``MISMATCH`` or ``CHECK:<reason>``. A reading is a struct with a
``status`` (READ, NOT_MENTIONED, UNREADABLE, NOT_READ) and its value fields; a profile is a
struct of five nullable inputs. The verdict functions take Columns, so they work on joined rows
and inside arrays alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.operators.catalog import POLICY_LOANS, PRIMARY_METHODS
from placemetrics.operators.quality import first_reason, issue_array
from placemetrics.session import cut

# Keys, groups, tabs and marks in display order.
CONDITIONS = ("stage", "business_age", "age", "region", "food", "groups")
GROUPS = ("MATCHING", "NOT_MENTIONED_ONLY", "NEEDS_CHECK", "NOT_MATCHING", "CLOSED")
TABS = ("POLICY_FUND", "SUPPORT_PROGRAM")
CAPITAL = "서울"
NOT_LIMITING = ("서울", "전국")
FINANCE_CATEGORY = "금융"
FRESH_DAYS = 3
USER_GROUPS = ("WOMEN", "DISABLED", "RESTART")
MAX_AGE = 120
MATCH, MISMATCH = "MATCH", "MISMATCH"


def check(reason: str) -> Column:
    return F.lit(f"CHECK:{reason}")


def yes_no(cond: Column) -> Column:
    return F.when(cond, MATCH).otherwise(MISMATCH)


def unread(reading: Column, verdict: Column) -> Column:
    """CHECK with the status as reason unless the reading holds a value."""
    return F.when(reading["status"] == "READ", verdict).otherwise(F.concat(F.lit("CHECK:"), reading["status"]))


def in_range(v: Column, r: Column) -> Column:
    low = F.coalesce(v >= r["min"], F.lit(True))
    high = F.coalesce(F.when(r["excl"], v < r["max"]).otherwise(v <= r["max"]), F.lit(True))
    return low & high


def _unlimited(r: Column) -> Column:
    return r["min"].isNull() & r["max"].isNull()


# ---------------------------------------------------------------- verdicts per condition

def stage_verdict(r: Column, p: Column) -> Column:
    wanted = F.when(r["value"] == "PRE_STARTUP_ONLY", "PRE_STARTUP").otherwise("BUSINESS")
    v = F.when(r["value"] == "BOTH", MATCH).when(p["status"].isNull(), check("INPUT_MISSING")).otherwise(yes_no(p["status"] == wanted))
    return unread(r, v)


def years_to_months(years: Column) -> Column:
    """Whole months of a year count; null for 0.3 years and the like."""
    m = years * 12
    return F.when(F.abs(m - F.round(m)) < 1e-9, F.round(m).cast("int"))


def opening_days(p: Column, as_of: Column) -> tuple[Column, Column]:
    """Earliest and latest day an opening month allows."""
    first = F.to_date(F.concat(p["opened"], F.lit("-01")))
    return first, F.least(F.last_day(first), as_of)


def business_age_verdict(r: Column, p: Column, as_of: Column, days: tuple[Column, Column] | None = None,
                         months: tuple[Column, Column] | None = None) -> Column:
    """The opening is known to the month: both ends of that month have to agree, else CHECK.

    Months are added with the day clamped to the month's end. ``days`` and ``months`` can be
    given where they were worked out before a join.
    """
    first, last = days or opening_days(p, as_of)
    lo, hi = months or (years_to_months(r["min"]), years_to_months(r["max"]))

    def too_young(opened: Column) -> Column:
        return F.coalesce(F.add_months(opened, lo) > as_of, F.lit(False))

    def too_old(opened: Column) -> Column:
        limit = F.add_months(opened, hi)
        return F.coalesce(F.when(r["excl"], as_of >= limit).otherwise(as_of > limit), F.lit(False))

    fractional = (r["min"].isNotNull() & lo.isNull()) | (r["max"].isNotNull() & hi.isNull())
    v = (F.when(_unlimited(r), MATCH).when(p["status"].isNull(), check("INPUT_MISSING"))
         .when(p["status"] == "PRE_STARTUP", yes_no(in_range(F.lit(0.0), r)))
         .when(p["opened"].isNull(), check("INPUT_MISSING")).when(fractional | (first > as_of), check("UNCERTAIN"))
         .when(too_young(first) | too_old(last), MISMATCH)
         .when(~too_young(last) & ~too_old(first), MATCH).otherwise(check("UNCERTAIN")))
    return unread(r, v)


def age_verdict(r: Column, p: Column) -> Column:
    v = F.when(_unlimited(r), MATCH).when(p["age"].isNull(), check("INPUT_MISSING")).otherwise(yes_no(in_range(p["age"], r)))
    return unread(r, v)


def region_verdict(r: Column, p: Column) -> Column:
    """Exclusions first; without a district only a whole-city value without exclusions matches."""
    d = p["district"]
    city = (r["scope"] == "NATIONWIDE") | ((r["scope"] == "PROVINCES") & F.array_contains(r["provinces"], CAPITAL))
    open_ = (F.size(r["ex_provinces"]) == 0) & (F.size(r["ex_districts"]) == 0)
    v = (F.when(d.isNull(), F.when(city & open_, MATCH).otherwise(check("INPUT_MISSING")))
         .when(F.array_contains(r["ex_provinces"], CAPITAL) | F.array_contains(r["ex_districts"], d), MISMATCH)
         .when(r["scope"] == "SEOUL_DISTRICTS", yes_no(F.array_contains(r["districts"], d))).otherwise(yes_no(city)))
    return unread(r, v)


def food_verdict(r: Column) -> Column:
    return unread(r, yes_no(r["value"] != "EXCLUDED"))


def groups_verdict(r: Column, p: Column, age: Column) -> Column:
    """Any group the applicant is in matches; else a missing input, else an uncertain group, else no match.

    Youth goes by the age range and needs its upper bound; damaged applicants are never assumed.
    """
    wanted = r["value"]
    youth = F.array_contains(wanted, "YOUTH")
    no_youth_age = (age["status"] != "READ") | age["max"].isNull()
    is_youth = youth & ~no_youth_age & F.coalesce(in_range(p["age"], age), F.lit(False)) & p["age"].isNotNull()
    user = F.greatest(*[F.array_contains(wanted, g).cast("int") for g in USER_GROUPS]) == 1
    in_one = F.coalesce(F.arrays_overlap(wanted, p["groups"]), F.lit(False))
    missing = (youth & ~no_youth_age & p["age"].isNull()) | (user & p["groups"].isNull())
    uncertain = F.array_contains(wanted, "OTHER") | (youth & no_youth_age)
    v = (F.when((F.size(wanted) == 0) | is_youth | in_one, MATCH).when(missing, check("INPUT_MISSING"))
         .when(uncertain, check("UNCERTAIN")).otherwise(MISMATCH))
    return unread(r, v)


def verdict(name: str, readings: dict[str, Column], p: Column, as_of: Column) -> Column:
    """Verdict of one condition by name."""
    r = readings[name]
    if name == "stage":
        return stage_verdict(r, p)
    if name == "business_age":
        return business_age_verdict(r, p, as_of)
    if name == "age":
        return age_verdict(r, p)
    if name == "region":
        return region_verdict(r, p)
    if name == "food":
        return food_verdict(r)
    return groups_verdict(r, p, readings["age"])


def six_verdicts(readings: dict[str, Column], p: Column, as_of: Column) -> dict[str, Column]:
    return {n: verdict(n, readings, p, as_of) for n in CONDITIONS}


# ---------------------------------------------------------------- title mark and group

def title_mark(title: Column, origin: Column, source: Column) -> Column:
    """Leading ``[...]`` of a collected notice title, trimmed."""
    mark = F.nullif(F.regexp_extract(title, r"^\s*\[([^\]]+)\]", 1), F.lit(""))
    return F.when((origin == "SYNC") & (source == "BIZINFO"), F.trim(mark))


def apply_title_mark(region: Column, status: Column, mark: Column) -> Column:
    """The capital's mark decides an unread region; another region's mark explains a missing mention."""
    other = mark.isNotNull()
    for name in NOT_LIMITING:
        other = other & ~mark.contains(name)
    return (F.when((mark == CAPITAL) & (status != "READ"), MATCH)
             .when(other & (region == "CHECK:NOT_MENTIONED"), check("TITLE_REGION_MARK")).otherwise(region))


def match_group(verdicts: Sequence[Column]) -> Column:
    """Group of an open notice out of its six verdicts."""
    bad, checks, other = F.lit(False), F.lit(False), F.lit(False)
    for v in verdicts:
        bad = bad | (v == MISMATCH)
        checks = checks | (v != MATCH)
        other = other | ((v != MATCH) & (v != "CHECK:NOT_MENTIONED"))
    return (F.when(bad, "NOT_MATCHING").when(~checks, "MATCHING").when(~other, "NOT_MENTIONED_ONLY").otherwise("NEEDS_CHECK"))


# ---------------------------------------------------------------- product side

def assign_tab(origin: Column, source: Column, category: Column, support_type: Column) -> Column:
    fund = (F.when(origin == "SYNC", (source == "SEMAS_OLS") | F.coalesce((source == "BIZINFO") & (category == FINANCE_CATEGORY), F.lit(False)))
             .otherwise(support_type.isin(*POLICY_LOANS)))
    return F.when(fund, TABS[0]).otherwise(TABS[1])


def open_state(products: DataFrame, syncs: DataFrame, as_of: str) -> DataFrame:
    """Add closed_by, fresh, the reasons an open notice is unconfirmed, and application_state.

    ``products``: origin, source, status, period_end, ai_period_status, ai_period_end.
    ``syncs``: source, last_succeeded_on.
    """
    day = F.lit(as_of).cast("date")
    j = products.join(syncs.select("source", F.col("last_succeeded_on").alias("_ok_day")), "source", "left")
    closed = F.when(F.col("status") == "CLOSED", "SOURCE_STATUS").when(F.col("period_end") < day, "SOURCE_END_DATE")
    fresh = (F.col("origin") != "SYNC") | F.coalesce(F.date_add("_ok_day", FRESH_DAYS) >= day, F.lit(False))
    reasons = issue_array([
        ("STATUS_NOT_OPEN", F.col("status") != "OPEN"), ("SOURCE_STALE", ~fresh),
        ("AI_END_DATE_PASSED", (F.col("ai_period_status") == "READ") & F.coalesce(F.col("ai_period_end") < day, F.lit(False)))])
    out = j.withColumns({"closed_by": closed, "fresh": fresh}).withColumn(
        "unconfirmed", F.when(F.col("closed_by").isNull(), reasons).otherwise(F.array().cast("array<string>")))
    state = F.when(F.col("closed_by").isNotNull(), "CLOSED").when(F.size("unconfirmed") == 0, "OPEN_CONFIRMED").otherwise("UNCONFIRMED")
    return out.withColumn("application_state", state).drop("_ok_day")


def select_readings(products: DataFrame) -> DataFrame:
    """Stage and region readings: an operator's own value with evidence replaces the extracted one.

    ``products``: origin, stages, region, evidence and extracted ``stage`` / ``region`` structs
    named ``read_stage`` (status, value) and ``read_region`` (status, scope). Collected products
    never use operator fields. Stage needs evidence from an original document; region accepts
    any recorded evidence.
    """
    operator = F.col("origin") != "SYNC"

    def evidence(subject: str, primary: bool) -> Column:
        return F.exists("evidence", lambda e: (e["subject"] == subject) & (e["method"].isin(*PRIMARY_METHODS) if primary else F.lit(True)))

    pre, post = F.array_contains("stages", "PRE_REGISTRATION"), F.array_contains("stages", "POST_REGISTRATION")
    stage = F.when(pre & post, "BOTH").when(pre, "PRE_STARTUP_ONLY").when(post, "BUSINESS_ONLY")
    scope = (F.when(F.col("region.scope") == "NATIONWIDE", "NATIONWIDE").when(F.col("region.scope") == "SEOUL", "PROVINCES")
             .when((F.col("region.scope") == "DISTRICTS") & (F.size("region.district_codes") > 0), "SEOUL_DISTRICTS"))
    use_stage = operator & stage.isNotNull() & evidence("BUSINESS_STAGE", True)
    use_region = operator & scope.isNotNull() & evidence("REGION", False)

    def pick(use: Column, own: Column, read: Column, value: str) -> Column:
        return F.struct(F.when(use, "READ").otherwise(F.coalesce(read["status"], F.lit("NOT_READ"))).alias("status"),
                        F.when(use, own).otherwise(F.when(read["status"] == "READ", read[value])).alias("value"),
                        F.when(use, "OPERATOR").when(read["status"] == "READ", "AI").alias("source"))

    return products.withColumns({"stage_reading": pick(use_stage, stage, F.col("read_stage"), "value"),
                                 "region_reading": pick(use_region, scope, F.col("read_region"), "scope")})


# ---------------------------------------------------------------- lists

#: District and stage keys; districts of the list follow after OTHER, which is any district out of it.
ANY, NONE, OTHER = range(3)
PRE_STARTUP, BUSINESS, STAGES = 2, 3, 4
SALT = 8
#: Pairs for one task on average, tasks for each partition of a shuffle, and applicants of one block, who are in a task's memory together.
TASK_PAIRS, TASKS, BLOCK = 250_000_000, 4, 8_192
#: Verdicts as numbers: a pair handles numbers, words come last. ASK hangs on the applicant, OWN is a word that is none of these.
OK, MISSING, UNSURE, OUT, ASK = range(5)
WORDS = (MATCH, "CHECK:INPUT_MISSING", "CHECK:UNCERTAIN", MISMATCH, None, "CHECK:NOT_MENTIONED", "CHECK:UNREADABLE", "CHECK:NOT_READ", "CHECK:TITLE_REGION_MARK")
OWN = len(WORDS)
#: What is known of an applicant's opening.
UNKNOWN, NOT_YET, LATER, OPENED = range(4)
#: A bit for each group an applicant can name, and one for anything else.
GROUP_BITS, OTHER_BIT = {g: 1 << i for i, g in enumerate(USER_GROUPS)}, 1 << len(USER_GROUPS)


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _district_key(codes: Column, district: Column) -> Column:
    return (F.array_position(codes, district) + OTHER).cast("int")


def _candidate_keys(products: DataFrame, codes: Column) -> DataFrame:
    """(district key, stage key) rows under which a product can be anything but a mismatch, with both verdicts.

    The district key is ANY when no district rules the product out, otherwise one row per
    possible district of ``codes``, OTHER and NONE for applicants without one; the stage key works
    alike. Applicants under one key get the same verdicts: v_region and v_stage. Only a district
    under OTHER has to be asked for: one that ``_named`` has if ``_only``, else one that it has not.
    """
    region, stage = F.col("region"), F.col("stage")
    none = F.array().cast("array<string>")
    excluded = F.coalesce(region["ex_districts"], none)
    city = _true((region["scope"] == "NATIONWIDE") | ((region["scope"] == "PROVINCES") & F.array_contains(region["provinces"], CAPITAL)))
    every = city & _true((F.size(region["ex_provinces"]) == 0) & (F.size(region["ex_districts"]) == 0))
    shut = _true(F.array_contains(region["ex_provinces"], CAPITAL))
    listed = F.when(region["scope"] == "SEOUL_DISTRICTS", F.array_except(region["districts"], excluded))
    open_ = F.coalesce(listed, F.when(city, F.array_except(codes, excluded)), none)
    dkeys = (F.when((region["status"] != "READ") | every, F.array(F.lit(ANY))).when(shut, F.array(F.lit(NONE)))
             .otherwise(F.array_distinct(F.concat(F.array(F.lit(NONE)), F.transform(open_, lambda d: _district_key(codes, d)),
                                                  F.when(city, F.array(F.lit(OTHER))).otherwise(F.array().cast("array<int>"))))))
    skeys = (F.when((stage["status"] != "READ") | (stage["value"] == "BOTH"), F.array(F.lit(ANY)))
             .when(stage["value"] == "PRE_STARTUP_ONLY", F.array(F.lit(PRE_STARTUP), F.lit(NONE)))
             .otherwise(F.array(F.lit(BUSINESS), F.lit(NONE))))
    rows = products.withColumn("_dk", F.explode(dkeys)).withColumn("_sk", F.explode(skeys))

    def known(key: str) -> Column:
        return F.when(F.col(key) == NONE, check("INPUT_MISSING")).otherwise(MATCH)

    return rows.withColumns({"v_region": apply_title_mark(unread(region, known("_dk")), region["status"], F.col("mark")),
                             "v_stage": unread(stage, known("_sk")), "_only": listed.isNotNull(),
                             "_named": F.when(F.col("_dk") == OTHER, F.coalesce(listed, excluded))})


def last_opening(day: Column, months: Column) -> Column:
    """Last day to which ``months`` can be added without passing ``day``."""
    back = F.add_months(day, -months)
    return F.when(day == F.last_day(day), F.last_day(back)).otherwise(back)


def _group_bits(groups: Column) -> Column:
    bits = F.when(F.size(F.array_except(groups, F.array(*[F.lit(g) for g in USER_GROUPS]))) > 0, OTHER_BIT).otherwise(0)
    for g, bit in GROUP_BITS.items():
        bits = bits.bitwiseOR(F.when(F.array_contains(groups, g), bit).otherwise(0))
    return F.when(groups.isNotNull(), bits)


def _notice_side(keyed: DataFrame, day: Column) -> DataFrame:
    """What a pair asks of a notice: numbers of the verdicts that stand without an applicant, and plain bounds for the others.

    ``_all`` is the place of the group out of those that stand, ``_own`` has their words if one is not in ``WORDS``.
    """
    age, business, groups = F.col("age"), F.col("business_age"), F.col("groups")
    wanted = groups["value"]
    no_youth_age = (age["status"] != "READ") | age["max"].isNull()
    youth = _true(F.array_contains(wanted, "YOUTH"))
    lo, hi = years_to_months(business["min"]), years_to_months(business["max"])
    open_ = {"age": (age["status"] == "READ") & ~_unlimited(age), "business_age": (business["status"] == "READ") & ~_unlimited(business),
             "groups": (groups["status"] == "READ") & ~_true(F.size(wanted) == 0)}
    stands = {n: unread(F.col(n), F.lit(MATCH)) for n in open_} | {"food": food_verdict(F.col("food")), "stage": F.col("v_stage"), "region": F.col("v_region")}
    rows = keyed.withColumns({f"v_{n}": F.when(open_[n], MATCH).otherwise(v) if n in open_ else v for n, v in stands.items()})
    v = [F.col(f"v_{n}") for n in CONDITIONS]
    words = F.array(*[F.lit(w) for w in WORDS if w])
    own = F.lit(False)
    for w in v:
        own = own | ~_true(F.array_contains(words, w))

    def number(n: str) -> Column:
        c = F.coalesce(*[F.when(F.col(f"v_{n}") == w, i) for i, w in enumerate(WORDS) if w], F.lit(OWN))
        return F.when(open_[n], ASK).otherwise(c) if n in open_ else c

    group = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), match_group(v)) - 1
    wanted_bits = F.coalesce(_group_bits(wanted), F.lit(0))
    return rows.select(
        "product_key", "tab", "position", "application_state", "_dk", "_sk", "_named", "_only", *[number(n).alias(f"_{n}") for n in CONDITIONS],
        group.cast("int").alias("_all"), F.when(own, F.array(*v)).alias("_own"),
        age["min"].alias("_min"), age["max"].alias("_max"), age["excl"].alias("_excl"),
        _true(in_range(F.lit(0.0), business)).alias("_from_start"),
        _true((business["min"].isNotNull() & lo.isNull()) | (business["max"].isNotNull() & hi.isNull())).alias("_fractional"),
        F.unix_date(last_opening(day, lo)).alias("_young_after"),
        F.unix_date(last_opening(F.when(business["excl"], day).otherwise(F.date_sub(day, 1)), hi)).alias("_old_until"),
        _true(youth & ~no_youth_age).alias("_youth"), F.exists(wanted, lambda g: g.isin(*USER_GROUPS)).alias("_user"),
        (_true(F.array_contains(wanted, "OTHER")) | _true(youth & no_youth_age)).alias("_unsure"),
        wanted_bits.alias("_wanted_bits"), F.when(wanted_bits >= OTHER_BIT, wanted).alias("_wanted"))


def _profile_side(profiles: DataFrame, day: Column, codes: Column) -> DataFrame:
    """What a pair asks of an applicant, in a row for each pair of keys."""
    p = F.col("profile")
    first, last = opening_days(p, day)
    bits = _group_bits(p["groups"])
    dkey = F.when(p["district"].isNull(), NONE).otherwise(_district_key(codes, p["district"]))
    skey = F.when(p["status"].isNull(), NONE).when(p["status"] == "PRE_STARTUP", PRE_STARTUP).when(p["status"] == "BUSINESS", BUSINESS)
    opening = (F.when(p["status"].isNull(), UNKNOWN).when(p["status"] == "PRE_STARTUP", NOT_YET).when(p["opened"].isNull(), UNKNOWN)
               .when(first > day, LATER).otherwise(OPENED))
    rows = profiles.select(
        "profile_id", p["age"].alias("_years"), opening.alias("_opening"), F.unix_date(first).alias("_first"), F.unix_date(last).alias("_last"),
        bits.alias("_bits"), F.when(bits >= OTHER_BIT, p["groups"]).alias("_in"), F.when(dkey == OTHER, p["district"]).alias("_district"),
        skey.alias("_stage"), F.explode(F.array(dkey, F.lit(ANY))).alias("_dk"))
    # a stage that is none of the two only meets notices for any
    return rows.withColumn("_sk", F.explode(F.array_compact(F.array("_stage", F.lit(ANY))))).drop("_stage")


def _dealt(notices: DataFrame, people: DataFrame, n_notices: int, n_people: int, salt: int, n_codes: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt out to cells, blocks of applicants by heaps of notices: each pair has one cell, and one ``_key`` in it.

    A task's memory holds blocks, whose size is fixed; their number and that of the tasks follow from the input.
    """
    parts = max(salt, TASKS * int(notices.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_notices * n_people // TASK_PAIRS))
    blocks = max(1, -(-n_people // BLOCK))
    heaps = -(-parts // blocks)

    def own(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def keyed(rows: DataFrame) -> DataFrame:
        key = ((F.col("_block") * heaps + F.col("_heap")) * (n_codes + OTHER + 1) + F.col("_dk")) * STAGES + F.col("_sk")
        return rows.withColumn("_key", key).drop("_block", "_heap", "_dk", "_sk").repartition(parts, "_key")

    left = notices.withColumns({"_heap": own("product_key", heaps), "_block": each(blocks)})
    right = people.withColumns({"_block": own("profile_id", blocks), "_heap": each(heaps)})
    return keyed(left), keyed(right)


def _pair_results() -> dict[str, Column]:
    """What age, business age and groups come to for a pair, out of columns of both sides. That of groups holds where age is not OUT."""
    first, last, opening, has_age = F.col("_first"), F.col("_last"), F.col("_opening"), F.col("_years").isNotNull()
    fits = in_range(F.col("_years"), {"min": F.col("_min"), "max": F.col("_max"), "excl": F.col("_excl")})

    def too_young(opened: Column) -> Column:
        return _true(opened > F.col("_young_after"))

    def too_old(opened: Column) -> Column:
        return _true(opened <= F.col("_old_until"))

    both = F.col("_bits").bitwiseAND(F.col("_wanted_bits"))
    in_one = (_true(both.bitwiseAND(F.lit(OTHER_BIT - 1)) != 0)
              | F.when(both >= OTHER_BIT, _true(F.arrays_overlap("_wanted", "_in"))).otherwise(False))
    youth = F.col("_youth")
    asked = {
        "age": F.when(~has_age, MISSING).when(fits, OK).otherwise(OUT),
        "business_age": F.when(opening == UNKNOWN, MISSING)
        .when(opening == NOT_YET, F.when(F.col("_from_start"), OK).otherwise(OUT)).when(F.col("_fractional") | (opening == LATER), UNSURE)
        .when(too_young(first) | too_old(last), OUT).when(~too_young(last) & ~too_old(first), OK).otherwise(UNSURE),
        # an age that passed is one of the youth's, as the range is the same
        "groups": F.when(in_one | (youth & has_age), OK).when(youth | (F.col("_user") & F.col("_bits").isNull()), MISSING)
        .when(F.col("_unsure"), UNSURE).otherwise(OUT)}
    return {n: F.when(F.col(f"_{n}") != ASK, F.col(f"_{n}")).otherwise(v) for n, v in asked.items()}


def match_list(products: DataFrame, profiles: DataFrame, as_of: str, districts: Sequence[str], salt: int = SALT) -> DataFrame:
    """Remaining (profile, open product) pairs with six verdicts and their group.

    Pairs that mismatch are not listed (``match_counts`` counts them without any pair), so they need not be made:
    products and profiles meet in an equi-join on district and stage keys, and each pair that
    can still match meets exactly once. All that hangs on one side alone is worked out before; a
    pair compares numbers. Pairs are dealt out to at least ``salt`` cells.
    """
    day = F.lit(as_of).cast("date")
    # a notice that excludes food businesses mismatches for everyone
    open_ = products.where(F.col("closed_by").isNull() & (food_verdict(F.col("food")) != MISMATCH))
    n_people = profiles.count()
    codes = F.array(*[F.lit(d) for d in districts]).cast("array<string>")
    left, right = _dealt(_notice_side(_candidate_keys(open_, codes), day), _profile_side(profiles, day, codes), open_.count(), n_people, salt, len(districts))
    results = _pair_results()
    # the key is one number, which the hash table of a block holds without a copy of the row's keys
    live = left.join(right.hint("shuffle_hash"), "_key").where(F.col("_named").isNull() | (_true(F.array_contains("_named", F.col("_district"))) == F.col("_only")))
    for r in results.values():
        live = live.where(r != OUT)
    pairs = live.select("profile_id", "product_key", "tab", "position", "application_state", "_all", "_own",
                        *[results.get(n, F.col(f"_{n}")).alias(f"_{n}") for n in CONDITIONS])
    words = F.array(*[F.lit(w) for w in WORDS])
    asks = F.lit(False)
    for n in results:
        asks = asks | F.col(f"_{n}").isin(MISSING, UNSURE)
    return pairs.select("profile_id", "product_key", "tab", "position", "application_state",
                        *[F.coalesce(F.get(words, F.col(f"_{n}")), F.get("_own", F.lit(i))).alias(f"v_{n}") for i, n in enumerate(CONDITIONS)],
                        F.get(F.array(*[F.lit(g) for g in GROUPS]), F.when(asks, GROUPS.index("NEEDS_CHECK")).otherwise(F.col("_all"))).alias("group"))


# ---------------------------------------------------------------- counts and first pages on classes

#: What a verdict leaves of a pair: the group of an open pair is that of its highest level.
LEVELS = len(GROUPS) - 1
FACTORS = ("opening", "person", "place")


def level(v: Column) -> Column:
    return F.when(v == MATCH, 0).when(v == "CHECK:NOT_MENTIONED", 1).when(v == MISMATCH, LEVELS - 1).otherwise(2)


@dataclass(frozen=True)
class Classes:
    """Applicants and open notices as classes of what their verdicts hang on.

    A verdict looks at some readings of the notice and some inputs of the applicant. Three factors
    cover all six: opening (stage, business age), person (age, groups) and place (region, title mark,
    food). ``notices`` has a key for each factor (n_opening, ...), ``profiles`` likewise (p_opening,
    ...); ``notice_classes`` and ``profile_classes`` count their distinct keys. ``tables`` tells for
    every key of a notice and of an applicant the level they reach together, once for each two distinct
    keys, without mismatches. A pair's group is that of the highest of its three levels, so counts and
    first pages come from joins of keys alone and pairs are never made.
    """

    notices: DataFrame
    profiles: DataFrame
    notice_classes: DataFrame
    profile_classes: DataFrame
    tables: dict[str, DataFrame]


def classes(products: DataFrame, profiles: DataFrame, as_of: str) -> Classes:
    day = F.lit(as_of).cast("date")
    p = F.col("profile")
    inputs = {"opening": F.struct(p["status"].alias("status"), p["opened"].alias("opened")),
              "person": F.struct(p["age"].alias("age"), F.sort_array(p["groups"]).alias("groups")),
              "place": F.struct(p["district"].alias("district"))}

    def kept(name: str) -> Column:
        """A reading as far as it matters: its values if it was read, else whether it was mentioned."""
        r = F.col(name)
        return F.when(r["status"] == "READ", F.to_json(r)).otherwise(F.when(r["status"] == "NOT_MENTIONED", "N").otherwise("C"))

    mark = F.when(F.col("region.status") != "READ", F.col("mark"))
    keys = {"opening": F.array(kept("stage"), kept("business_age")), "person": F.array(kept("age"), kept("groups")),
            "place": F.array(kept("region"), F.coalesce(mark, F.lit("")), kept("food"))}
    read = {"opening": ("stage", "business_age"), "person": ("age", "groups"), "place": ("region", "mark", "food")}

    def verdicts(factor: str) -> list[Column]:
        if factor == "opening":
            return [stage_verdict(F.col("stage"), p), business_age_verdict(F.col("business_age"), p, day)]
        if factor == "person":
            return [age_verdict(F.col("age"), p), groups_verdict(F.col("groups"), p, F.col("age"))]
        return [apply_title_mark(region_verdict(F.col("region"), p), F.col("region.status"), F.col("mark")), food_verdict(F.col("food"))]

    open_ = products.where(F.col("closed_by").isNull())
    # Keys are digests of 128 bits: short in every shuffle, the same in every run.
    digest = lambda c: F.unhex(F.md5(F.to_json(c)))
    notices = open_.select("*", *[digest(keys[f]).alias(f"n_{f}") for f in FACTORS])
    people = profiles.select("*", *[digest(inputs[f]).alias(f"p_{f}") for f in FACTORS])
    columns = [c for f in FACTORS for c in read[f]]
    notice_classes = cut(notices.groupBy("tab", "application_state", *[f"n_{f}" for f in FACTORS]).agg(F.count("*").alias("value"), *[F.any_value(c).alias(c) for c in columns]))
    profile_classes = cut(people.groupBy(*[f"p_{f}" for f in FACTORS]).agg(F.count("*").alias("value"), F.any_value("profile").alias("profile")))
    tables = {}
    for f in FACTORS:
        left = notice_classes.groupBy(f"n_{f}").agg(*[F.any_value(c).alias(c) for c in read[f]])
        right = profile_classes.groupBy(f"p_{f}").agg(F.any_value("profile").alias("profile"))
        # Distinct keys of both sides; those of applicants are few, as their inputs are (months, ages, districts, groups).
        both = left.crossJoin(right).select(f"n_{f}", f"p_{f}", F.greatest(*[level(v) for v in verdicts(f)]).alias(f"l_{f}"))
        tables[f] = both.where(F.col(f"l_{f}") < LEVELS - 1)
    return Classes(notices, people, notice_classes, profile_classes, tables)


def _contract(weights: DataFrame, partners: DataFrame, tables: dict[str, DataFrame], own: str, other: str, merge: Column) -> DataFrame:
    """Exchange the keys of one side (``own`` n or p) for those of the other, factor by factor.

    ``weights``: the three keys, further columns, ``level`` and ``value``. After each factor the rows
    with equal keys are merged, so what is exchanged already is never carried twice; only keys that
    occur together on the other side (``partners``) are made.
    """
    carry = [c for c in weights.columns if c not in ("level", "value") and not c.startswith(f"{own}_")]
    rows, done = weights, []
    for f in ("place", "opening", "person"):
        new = [*done, f"{other}_{f}"]
        # The factor's table with the partner keys already made and this one, as they occur together.
        table = tables[f].join(partners.select(*new).distinct(), f"{other}_{f}")
        rows = rows.join(table, [f"{own}_{f}", *done])
        rest = [f"{own}_{x}" for x in FACTORS if f"{other}_{x}" not in new]
        rows = rows.withColumn("level", F.greatest("level", f"l_{f}")).groupBy(*carry, *rest, *new, "level").agg(merge.alias("value"))
        done = new
    return rows


def _by_level(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("level") == i, F.col("value"))), F.lit(0)).alias(g.lower()) for i, g in enumerate(GROUPS[:3])])


def match_counts(products: DataFrame, profiles: DataFrame, as_of: str) -> DataFrame:
    """Zero-filled group counts per profile and tab.

    Counts are sums of products over classes; pairs that mismatch are counted by difference.
    """
    c = classes(products, profiles, as_of)
    weights = c.notice_classes.select("tab", *[f"n_{f}" for f in FACTORS], "value", F.lit(0).alias("level"))
    keys = [f"p_{f}" for f in FACTORS]
    per = _by_level(_contract(weights, c.profile_classes, c.tables, "n", "p", F.sum("value")), "tab", *keys)
    totals = products.groupBy("tab").agg(F.count(F.when(F.col("closed_by").isNull(), 1)).alias("_open"),
                                         F.count(F.when(F.col("closed_by").isNotNull(), 1)).alias("closed"))
    grid = c.profiles.select("profile_id", *keys, F.explode(F.array(*[F.lit(t) for t in TABS])).alias("tab"))
    j = grid.join(F.broadcast(totals), "tab", "left").join(per, ["tab", *keys], "left")     # two rows of totals
    shown = [F.coalesce(g.lower(), F.lit(0)) for g in GROUPS[:3]]
    return j.select("profile_id", "tab", *[s.alias(g.lower()) for s, g in zip(shown, GROUPS[:3])],
                    (F.coalesce("_open", F.lit(0)) - shown[0] - shown[1] - shown[2]).alias("not_matching"),
                    F.coalesce("closed", F.lit(0)).alias("closed"))


def product_counts(products: DataFrame, profiles: DataFrame, as_of: str) -> DataFrame:
    """Zero-filled group counts per product over all profiles; the other way round from ``match_counts``."""
    c = classes(products, profiles, as_of)
    weights = c.profile_classes.select(*[f"p_{f}" for f in FACTORS], "value", F.lit(0).alias("level"))
    keys = [f"n_{f}" for f in FACTORS]
    per = _by_level(_contract(weights, c.notice_classes, c.tables, "p", "n", F.sum("value")), *keys)
    listed = c.notices.select("product_key", *keys).join(per, keys, "left").drop(*keys)
    total = profiles.agg(F.count(F.lit(1)).alias("_n"))
    shut = products.where(F.col("closed_by").isNotNull()).select("product_key", *[F.lit(None).cast("long").alias(g.lower()) for g in GROUPS[:3]], F.lit(True).alias("_shut"))
    j = listed.withColumn("_shut", F.lit(False)).unionByName(shut).crossJoin(F.broadcast(total))    # one row
    shown = [F.coalesce(g.lower(), F.lit(0)) for g in GROUPS[:3]]
    return j.select("product_key", *[s.alias(g.lower()) for s, g in zip(shown, GROUPS[:3])],
                    F.when(F.col("_shut"), 0).otherwise(F.col("_n") - shown[0] - shown[1] - shown[2]).alias("not_matching"),
                    F.when(F.col("_shut"), F.col("_n")).otherwise(0).alias("closed"))


def order_key(group: Column, state: Column) -> Column:
    pos = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), group) - 1
    return (pos * 2 + F.when(state == "OPEN_CONFIRMED", 0).otherwise(1)).cast("int")


def first_page(products: DataFrame, profiles: DataFrame, as_of: str, n: int = 50) -> DataFrame:
    """First ``n`` notices per profile and tab in display order; the catalog's order breaks ties.

    Each class of notices gives its first ``n``, and lists are merged class by class to ``n`` again.
    """
    c = classes(products, profiles, as_of)
    own = ["tab", "application_state", *[f"n_{f}" for f in FACTORS]]
    item = F.struct("position", "product_key")
    heads = c.notices.withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy("position", "product_key"))).where(F.col("_r") <= n)
    weights = heads.groupBy(*own).agg(F.sort_array(F.collect_list(item)).alias("value")).withColumn("level", F.lit(0))
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("value"))), 1, n)
    keys = [f"p_{f}" for f in FACTORS]
    lists = _contract(weights, c.profile_classes, c.tables, "n", "p", merged)
    group = F.get(F.array(*[F.lit(g) for g in GROUPS[:3]]), F.col("level"))
    items = lists.select("tab", *keys, group.alias("group"), "application_state", F.inline("value")).withColumn("order_key", order_key(F.col("group"), F.col("application_state")))
    w = Window.partitionBy("tab", *keys).orderBy("order_key", "position", "product_key")
    page = items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return c.profiles.select("profile_id", *keys).join(page, keys).drop(*keys)


# ---------------------------------------------------------------- profiles

def validate_profiles(df: DataFrame, districts: Sequence[str], as_of: str) -> DataFrame:
    """First failing rule per profile: enum, month format, future month, district, age, groups, month without business."""
    p = F.col("profile")
    month = p["opened"].rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    known = F.array(*[F.lit(g) for g in USER_GROUPS])
    reason = first_reason([
        ("INVALID_STATUS", F.coalesce(~p["status"].isin("PRE_STARTUP", "BUSINESS"), F.lit(False))),
        ("INVALID_MONTH", F.coalesce(~month, F.lit(False))), ("FUTURE_MONTH", F.coalesce(p["opened"] > F.lit(as_of[:7]), F.lit(False))),
        ("UNKNOWN_DISTRICT", F.coalesce(~p["district"].isin(*districts), F.lit(False))),
        ("INVALID_AGE", F.coalesce(~p["age"].between(0, MAX_AGE), F.lit(False))),
        ("INVALID_GROUP", F.coalesce(F.size(F.array_except(p["groups"], known)) > 0, F.lit(False))),
        ("REPEATED_GROUP", F.coalesce(F.size(p["groups"]) != F.size(F.array_distinct(p["groups"])), F.lit(False))),
        ("MONTH_WITHOUT_BUSINESS", p["opened"].isNotNull() & ~p["status"].eqNullSafe("BUSINESS"))])
    return df.withColumn("issue", reason)


def district_fallback(own: Column, business: Column, districts: Sequence[str]) -> Column:
    """``struct(district, source)``: the profile's district, else a valid one of the business profile."""
    valid = F.when(business.isin(*districts), business)
    return F.struct(F.coalesce(own, valid).alias("district"),
                    F.when(own.isNotNull(), "FUNDING_PROFILE").when(valid.isNotNull(), "BUSINESS_PROFILE").alias("source"))
