"""Grading of extracted conditions by the verdicts they lead to.

All probes and options of one case live in arrays of its row: at most some hundred probes per
field, so grading is a projection and scales with the number of cases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.money import let
from placemetrics.operators.matching import CONDITIONS, USER_GROUPS, apply_title_mark, business_age_verdict, in_range, match_group, opening_days, six_verdicts, verdict, years_to_months

# Base profile, probe points and the three group profiles.
AS_OF = "2026-11-04"
BASE = {"status": "BUSINESS", "opened": "2023-03", "district": "11680", "age": 37}
AGE_POINTS = (0, 18, 25, 37, 45, 60, 120)
MONTH_POINTS = (1, 30, 60, 130, 400)
YOUTH_POINT = 39
GROUP_PROFILES = {
    "NO_INPUT": (None, None, None, None, None),
    "PRE_STARTUP": ("PRE_STARTUP", None, "11440", 32, []),
    "BUSINESS": ("BUSINESS", "2025-03", "11680", 45, [])}
SURFACE = ("MATCHING", "NOT_MENTIONED_ONLY")
DISPLAYED = ("period", "support")
FIELDS = (*CONDITIONS, *DISPLAYED)
OUTCOMES = ("CORRECT", "EQUIVALENT", "CONFIDENT_WRONG", "MISSED", "DISPLAY_WRONG")
METRICS = ("field_acc", "confident_wrong", "missed", "exact_acc", "group_changed", "group_surfaced")


def profile(status=None, opened=None, district=None, age=None, groups=None) -> Column:
    """Profile struct out of literals or Columns."""
    def text(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    g = groups if isinstance(groups, Column) else (
        F.lit(None).cast("array<string>") if groups is None else F.array(*[F.lit(x) for x in groups]).cast("array<string>"))
    a = age if isinstance(age, Column) else F.lit(age).cast("int")
    return F.struct(text(status).alias("status"), text(opened).alias("opened"), text(district).alias("district"), a.cast("int").alias("age"), g.alias("groups"))


def _base(**changes) -> Column:
    return profile(**{**BASE, "groups": [], **changes})


def _bounds(options: Column) -> Column:
    """All bounds of the read ranges among the options."""
    both = F.transform(F.filter(options, lambda o: o["status"] == "READ"), lambda o: F.array_compact(F.array(o["min"], o["max"])))
    return F.flatten(both)


def _ages(bounds: Column, extra: Sequence[int] = ()) -> Column:
    """Null and the ages around every bound, 0 to 120."""
    near = F.flatten(F.transform(bounds, lambda b: F.array((b - 1).cast("int"), b.cast("int"), (b + 1).cast("int"))))
    extra_near = [F.lit(x + d) for x in extra for d in (-1, 0, 1)]
    points = F.concat(F.array(*[F.lit(a) for a in AGE_POINTS], *extra_near), near)
    kept = F.array_distinct(F.filter(points, lambda a: (a >= 0) & (a <= 120)))
    return F.concat(F.array(F.lit(None).cast("int")), kept)


def group_sets() -> Column:
    """Unanswered, and all eight subsets of the user's groups."""
    sets = [F.lit(None).cast("array<string>")]
    for bits in range(2 ** len(USER_GROUPS)):
        sets.append(F.array(*[F.lit(g) for i, g in enumerate(USER_GROUPS) if bits >> i & 1]).cast("array<string>"))
    return F.array(*sets)


def probe_profiles(name: str, options: Column, context_age: Column, districts: Sequence[str], as_of: str = AS_OF,
                   kinds: bool = False) -> Column:
    """Profiles at which the verdict of a field can change: thresholds and their neighbours.

    With ``kinds``, of the ages at which groups are asked only one of each kind: the verdict on groups tells missing ages and
    those in and out of the context's range apart, and no others.
    """
    if name == "stage":
        return F.array(_base(status="PRE_STARTUP", opened=None), _base(), _base(status=None))
    if name == "business_age":
        year, month = int(as_of[:4]), int(as_of[5:7])
        now = year * 12 + month - 1
        near = F.flatten(F.transform(_bounds(options), lambda y: F.transform(
            F.array(*[F.lit(d) for d in (-2, -1, 0, 1, 2)]), lambda d: (F.floor(y * 12 + 0.5) + d).cast("int"))))
        months = F.array_distinct(F.filter(F.concat(F.array(*[F.lit(m) for m in MONTH_POINTS]), near), lambda m: m >= 0))

        def opened(m: Column) -> Column:
            i = F.lit(now) - m
            return F.concat(F.floor(i / 12).cast("string"), F.lit("-"), F.lpad((F.pmod(i, F.lit(12)) + 1).cast("string"), 2, "0"))

        return F.concat(F.array(_base(status="PRE_STARTUP", opened=None), _base(opened=None), _base(status=None, opened=None)),
                        F.transform(months, lambda m: _base(opened=opened(m))))
    if name == "age":
        return F.transform(_ages(_bounds(options)), lambda a: _base(age=a))
    if name == "region":
        codes = F.array(F.lit(None).cast("string"), *[F.lit(d) for d in districts])
        return F.transform(codes, lambda d: _base(district=d))
    if name == "food":
        return F.array(_base())
    ages = _ages(_bounds(F.array(context_age)), extra=(YOUTH_POINT,))
    if kinds:
        ages = let(let(ages, F.array_compact), lambda known: let(F.transform(known, lambda a: F.coalesce(in_range(a, context_age), F.lit(False))), lambda inside: F.concat(
            F.array(F.lit(None).cast("int")), *[F.filter(F.array(F.get(known, (F.array_position(inside, F.lit(k)) - 1).cast("int"))), lambda a: a.isNotNull()) for k in (True, False)])))
    return let(ages, lambda own: F.flatten(F.transform(group_sets(), lambda g: F.transform(own, lambda a: _base(age=a, groups=g)))))


def _vector(name: str, option: Column, context: dict[str, Column], probes: Column, as_of: Column) -> Column:
    if name == "business_age":
        # days and months are worked out once for a probe and once for an option, not at every mention
        months = F.struct(*[m.alias(n) for n, m in zip(("lo", "hi"), (years_to_months(option["min"]), years_to_months(option["max"])))])
        return let(months, lambda m: F.transform(probes, lambda q: business_age_verdict(option, q["p"], as_of, (q["first"], q["last"]), (m["lo"], m["hi"]))))
    return F.transform(probes, lambda p: verdict(name, {**context, name: option}, p, as_of))


def _plain(v: Column) -> Column:
    return F.when(v.startswith("CHECK"), F.lit("CHECK")).otherwise(v)


def condition_outcome(name: str, actual: Column, acceptable: Column, context: dict[str, Column], districts: Sequence[str],
                      as_of: str = AS_OF) -> Column:
    """CORRECT / EQUIVALENT / MISSED / CONFIDENT_WRONG of one matched field."""
    day = F.lit(as_of).cast("date")
    probes = probe_profiles(name, F.concat(F.array(actual), acceptable), context["age"], districts, as_of, kinds=True)

    if name == "business_age":
        def with_days(p: Column) -> Column:
            return let(opening_days(p, day)[0], lambda first: F.struct(p.alias("p"), first.alias("first"), F.least(F.last_day(first), day).alias("last")))

        probes = F.transform(probes, with_days)

    def grade(ps: Column) -> Column:
        # the pieces are bound once: probes, then the verdicts of the answer, then each option's
        def with_actual(mine: Column) -> Column:
            golds = F.transform(acceptable, lambda o: F.struct(o["status"].alias("status"), F.transform(
                _vector(name, o, context, ps, day), _plain).alias("v")))

            def decide(gs: Column) -> Column:
                same = F.filter(gs, lambda g: g["v"] == mine)
                misled = lambda g: F.exists(F.arrays_zip(mine.alias("m"), g["v"].alias("g")), lambda z: (z["m"] != "CHECK") & (z["m"] != z["g"]))
                return (F.when(F.exists(same, lambda g: g["status"] == actual["status"]), "CORRECT").when(F.size(same) > 0, "EQUIVALENT")
                        .when(F.exists(gs, lambda g: ~misled(g)), "MISSED").otherwise("CONFIDENT_WRONG"))

            return F.get(F.transform(F.array(golds), decide), F.lit(0))

        mine = F.transform(_vector(name, actual, context, ps, day), _plain)
        return F.get(F.transform(F.array(mine), with_actual), F.lit(0))

    return F.get(F.transform(F.array(probes), grade), F.lit(0))


def displayed_outcome(actual: Column, acceptable: Column) -> Column:
    """Outcome of a field that is only shown; readings are (status, shown text)."""
    shown = lambda r: F.coalesce(F.when(r["status"] == "READ", r["shown"]), F.lit("∅"))
    same = F.filter(acceptable, lambda o: shown(o) == shown(actual))
    return (F.when(F.exists(same, lambda o: o["status"] == actual["status"]), "CORRECT").when(F.size(same) > 0, "EQUIVALENT")
             .when(actual["status"] == "READ", "DISPLAY_WRONG").otherwise("MISSED"))


def field_outcomes(cases: DataFrame, districts: Sequence[str], as_of: str = AS_OF) -> DataFrame:
    """Add ``o_<field>`` for all eight fields.

    ``cases``: per field ``a_<field>`` (the answer) and ``g_<field>`` (array of acceptable readings,
    the primary one first).
    """
    context = {n: F.get(f"g_{n}", F.lit(0)) for n in CONDITIONS}
    cols = {f"o_{n}": condition_outcome(n, F.col(f"a_{n}"), F.col(f"g_{n}"), context, districts, as_of) for n in CONDITIONS}
    cols |= {f"o_{n}": displayed_outcome(F.col(f"a_{n}"), F.col(f"g_{n}")) for n in DISPLAYED}
    return cases.withColumns(cols)


def expand_gold(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every combination of one acceptable reading per matched field, as rows.

    A case has a handful of options per field, so this explodes arrays of its own row.
    """
    d = cases.select(*keys, *[f"g_{n}" for n in CONDITIONS])
    for n in CONDITIONS:
        d = d.select("*", F.posexplode(f"g_{n}").alias(f"i_{n}", f"c_{n}")).drop(f"g_{n}")
    return d


def open_group(readings: dict[str, Column], p: Column, mark: Column, as_of: Column) -> Column:
    v = six_verdicts(readings, p, as_of)
    v["region"] = apply_title_mark(v["region"], readings["region"]["status"], mark)
    return let(F.struct(*[v[n].alias(n) for n in CONDITIONS]), lambda x: match_group([x[n] for n in CONDITIONS]))


def group_outcomes(cases: DataFrame, keys: Sequence[str], as_of: str = AS_OF) -> DataFrame:
    """SAME / SURFACED / OTHER per case and group profile.

    Gold groups are computed once per combination and folded into a short set per case.
    """
    day = F.lit(as_of).cast("date")
    names = list(GROUP_PROFILES)
    profiles = {n: profile(*v) for n, v in GROUP_PROFILES.items()}
    combos = expand_gold(cases.select(*keys, "mark", *[f"g_{n}" for n in CONDITIONS]), [*keys, "mark"])
    gold = {n: F.col(f"c_{n}") for n in CONDITIONS}
    sets = combos.groupBy(*keys).agg(*[F.collect_set(open_group(gold, profiles[p], F.col("mark"), day)).alias(f"s_{p}") for p in names])
    mine = {n: F.col(f"a_{n}") for n in CONDITIONS}
    j = cases.join(sets, list(keys))

    def outcome(p: str) -> Column:
        return F.get(F.transform(F.array(open_group(mine, profiles[p], F.col("mark"), day)), lambda got: F.when(
            F.array_contains(F.col(f"s_{p}"), got), "SAME").when(got.isin(*SURFACE), "SURFACED").otherwise("OTHER")), F.lit(0))

    return j.withColumns({f"q_{p}": outcome(p) for p in names}).drop(*[f"s_{p}" for p in names])


def case_scores(graded: DataFrame) -> DataFrame:
    """Six ratios per graded run."""
    fields = F.array(*[F.col(f"o_{n}") for n in FIELDS])
    groups = F.array(*[F.col(f"q_{p}") for p in GROUP_PROFILES])

    def share(values: Column, kinds: Sequence[str], n: int) -> Column:
        return F.size(F.filter(values, lambda v: v.isin(*kinds))) / F.lit(n)

    return graded.withColumns({
        "field_acc": share(fields, ("CORRECT", "EQUIVALENT"), len(FIELDS)), "exact_acc": share(fields, ("CORRECT",), len(FIELDS)),
        "confident_wrong": share(fields, ("CONFIDENT_WRONG",), len(CONDITIONS)), "missed": share(fields, ("MISSED",), len(FIELDS)),
        "group_changed": share(groups, ("SURFACED", "OTHER"), len(GROUP_PROFILES)), "group_surfaced": share(groups, ("SURFACED",), len(GROUP_PROFILES))})


def unknown_cases(runs: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Runs whose case is not in the gold table; they must be rejected, not ignored."""
    return runs.join(cases.select(key), key, "left_anti")


def known_cases(runs: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """The runs; the job fails at the first one whose case is not in the gold table."""
    known = runs.join(cases.select(key, F.lit(True).alias("_known")).distinct(), key, "left")
    checked = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("unknown case "), F.col(key).cast("string"))).cast(runs.schema[key].dataType))
    return known.withColumn(key, checked).select(*runs.columns)


def set_summary(scores: DataFrame, key: str, by: str = "set_name", cases: DataFrame | None = None) -> DataFrame:
    """Mean over case means and the half-width of its 95% interval, per set and metric.

    Where the gold table is given, runs of cases it does not have are rejected. Runs are averaged within their case first, so a case with many runs does not weigh more.
    """
    scores = scores if cases is None else known_cases(scores, cases, key)
    per_case = scores.groupBy(by, key).agg(*[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("_runs"))
    aggs = []
    for m in METRICS:
        half = F.coalesce(F.stddev_samp(m), F.lit(0.0)) * 1.96 / F.sqrt(F.count(m))
        aggs += [F.avg(m).alias(f"{m}_mean"), half.alias(f"{m}_half")]
    return per_case.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), F.sum("_runs").alias("runs"), *aggs)
