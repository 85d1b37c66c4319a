"""Running totals over sorted values without a one-task sort.

``Window.partitionBy(group).orderBy(value)`` puts a whole group into one task. Here the rows
are first reduced to distinct (group, value) pairs with counts. Where a group has more of them than
one task should sort, they are cut into value ranges, and a range that still has too many is cut
again, so the number of ranges grows with the table. The running total becomes *total of the ranges
before* + *running total inside the range*. A group that holds a third of all rows is then spread
over about a third of the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.session import cut

#: Rows of one group that one task may sort.
TARGET = 500_000
#: Parts a range is cut into, and about how many of its values decide where.
FAN, SAMPLE = 64, 4096
#: Cuts of one range: their numbers fill a long.
LEVELS = 10


def _split_points(rows: DataFrame, over: DataFrame, value: str, salt: int) -> DataFrame:
    """_range, _bounds: values that cut each of the given ranges into about equal parts.

    Only where to cut depends on the sample; every row is ranked.
    """
    step = F.greatest(F.lit(1), F.floor(F.col("_rows") / SAMPLE))
    picked = rows.join(over, "_range").where(F.pmod(F.xxhash64(value, F.lit(salt)), step) == 0)
    sample = picked.groupBy("_range").agg(F.sort_array(F.collect_set(value)).alias("_s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(FAN - 1)), lambda i: F.get("_s", F.floor(i * F.size("_s") / FAN).cast("int")))
    return sample.select("_range", F.array_distinct(at).alias("_bounds"))


def into_ranges(df: DataFrame, by: Sequence[str], value: str, target: int = TARGET) -> DataFrame:
    """Add ``_range``, which rises with the value, so that no group has more than ``target`` rows in a range.

    ``df`` has one row per (by, value). A range is cut as long as a group has too many rows in it;
    how many ranges there are follows from the rows.
    """
    df = cut(df)        # read for the counts and split points of every level, and for the ranges
    rows = df.withColumn("_range", F.lit(0).cast("long"))
    for level in range(LEVELS):
        sizes = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
        over = cut(sizes.groupBy("_range").agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most")).where(F.col("_most") > target).select("_range", "_rows"))
        if over.isEmpty():
            break
        bounds = cut(_split_points(rows, over, value, level))
        part = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(value))), F.lit(0))
        rows = rows.join(bounds, "_range", "left").withColumn("_range", F.col("_range") * FAN + F.when(F.col("_bounds").isNotNull(), part).otherwise(0)).drop("_bounds")
    return rows


def running_totals(df: DataFrame, by: Sequence[str], value: str, measures: Sequence[str], target: int | None = TARGET) -> DataFrame:
    """Add ``cum_<m>`` (up to and including the value) and ``total_<m>`` per group.

    ``df`` has one row per (by, value); measures are additive. ``target`` None: a group is known to
    have few values and is sorted as one.
    """
    by = list(by)
    if target is None:
        upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        everything = Window.partitionBy(*by)
        return df.select("*", *[F.sum(m).over(upto).alias(f"cum_{m}") for m in measures],
                         *[F.sum(m).over(everything).alias(f"total_{m}") for m in measures])
    ranged = into_ranges(df, by, value, target)
    per_range = ranged.groupBy(*by, "_range").agg(*[F.sum(m).alias(f"_r_{m}") for m in measures])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_range.select(
        *by, "_range",
        *[F.coalesce(F.sum(f"_r_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_r_{m}").over(whole).alias(f"total_{m}") for m in measures])
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(m).over(inside).alias(f"_i_{m}") for m in measures])
    joined = local.join(offsets, [*by, "_range"])
    return joined.select(*df.columns,
                         *[(F.col(f"_o_{m}") + F.col(f"_i_{m}")).alias(f"cum_{m}") for m in measures],
                         *[f"total_{m}" for m in measures])


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return (df.where(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str,
                    positions: dict[str, Column], target: int = TARGET) -> DataFrame:
    """Values at given 1-based positions of each sorted group, one column per name.

    A position is a Column over ``total_n``, the group size.
    """
    cum = running_totals(value_counts(df, by, value), by, value, ["n"], target)
    first = F.col("cum_n") - F.col("n")
    picks = [F.max(F.when((first < p) & (F.col("cum_n") >= p), F.col(value))).alias(name)
             for name, p in positions.items()]
    return cum.groupBy(*by).agg(*picks, F.max("total_n").alias("n"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles: the value at ``ceil(q * n)``."""
    n = F.col("total_n")
    return exact_quantiles(df, by, value,
                           {k: F.least(n, F.greatest(F.lit(1), F.ceil(F.lit(q) * n))) for k, q in probs.items()})


def exact_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Median per group: the mean of the two middle values."""
    n = F.col("total_n")
    q = exact_quantiles(df, by, value, {"_lo": F.floor((n + 1) / 2), "_hi": F.floor((n + 2) / 2)})
    return q.select(*by, ((F.col("_lo") + F.col("_hi")) / 2).alias(out), "n")


def competition_rank(df: DataFrame, by: Sequence[str], score: str, keep: str = "rank") -> DataFrame:
    """Rank 1 + number of strictly higher scores, plus the group size as ``total``.

    Scores are whole numbers from 0 to 100, so ranks are computed on at most 101 distinct
    scores per group and joined back; no range cut is needed.
    """
    df = cut(df)        # read for the counts and joined back to the ranks
    counts = value_counts(df, by, score)
    cum = running_totals(counts, by, score, ["n"], target=None)
    ranks = cum.select(*by, score, (F.col("total_n") - F.col("cum_n") + 1).alias(keep),
                       F.col("total_n").alias("total"))
    return df.join(ranks, [*by, score], "left")


def positions(df: DataFrame, key: str, out: str = "position", target: int = TARGET) -> DataFrame:
    """0-based position of every row in the order of a unique text key, without one global sort task."""
    one = df.select(key, F.lit(1).alias("_one"))
    cum = running_totals(one.select(F.lit(0).alias("_g"), key, "_one"), ["_g"], key, ["_one"], target)
    return df.join(cum.select(key, (F.col("cum__one") - 1).alias(out)), key)
