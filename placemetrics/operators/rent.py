"""Rent benchmark observations: parse, validate, link to districts, summarise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.money import half_up_div, wide
from placemetrics.functions.quarter import quarter_idx, quarter_label
from placemetrics.operators.quality import first_reason, missing_or

# Floor codes in display order, and the source's floor names.
FLOORS = ("NONE", "B1", "1F", "2F", "3F", "4F", "5F", "6F_PLUS")
FLOOR_NAMES = {"지하1층": "B1", "1층": "1F", "2층": "2F", "3층": "3F", "4층": "4F", "5층": "5F", "6층이상": "6F_PLUS"}
GROUP_ORDER = ("도심", "강남", "영등포신촌", "기타")
VALUE_SCALE = 12
NUMBER_PATTERN = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
OBSERVATION_KEY = ("building", "metric", "quarter", "region_path", "floor")


def lookup(code: Column, table: Mapping[str, str]) -> Column:
    """Value of a code in a fixed small table; null for an unknown code."""
    out = None
    for k, v in table.items():
        out = F.when(code == k, F.lit(v)) if out is None else out.when(code == k, F.lit(v))
    return out


def parse_rent(rows: DataFrame, table_defs: DataFrame, root: str, ignored_items: Sequence[str] = (),
               floor_names: Mapping[str, str] = FLOOR_NAMES) -> DataFrame:
    """Source rows -> observations with an ``issue``; rows of no defined table, OUT_OF_SCOPE and IGNORED rows are marked too.

    ``table_defs``: table_id, building, metric, item, unit (one row per source table).
    """
    j = rows.join(table_defs, "table_id", "left")
    floor_table = F.col("metric") == "FLOOR_RENT"
    path = F.trim(F.when(floor_table, F.col("group_name")).otherwise(F.col("class_name_full")))
    parts = F.split(path, ">")
    quarter = F.when(F.col("period").rlike(r"^\d{4}0[1-4]$"),
                     F.concat(F.substring("period", 1, 4), F.substring("period", 6, 1)))
    floor = F.when(floor_table, lookup(F.trim("class_name"), floor_names)).otherwise(F.lit("NONE"))
    cell = F.trim("value_text")
    blank = cell.isNull() | (cell == "")
    value = F.when(~blank & cell.rlike(NUMBER_PATTERN), cell.try_cast(f"decimal(24,{VALUE_SCALE})"))
    out = j.select(*rows.columns, "building", "metric", "item", "unit", path.alias("region_path"),
                   F.element_at(parts, -1).alias("region_name"), F.size(parts).alias("region_level"),
                   quarter.alias("quarter"), floor.alias("floor"), value.alias("value"), blank.alias("_blank"))
    in_scope = (F.col("region_path") == root) | F.col("region_path").startswith(f"{root}>")
    reason = first_reason([
        ("UNKNOWN_TABLE", F.col("metric").isNull()), ("OUT_OF_SCOPE", missing_or(in_scope)),
        ("IGNORED_ITEM", (F.col("metric") == "FLOOR_RENT") & F.col("item_name").isin(*ignored_items)),
        ("UNEXPECTED_ITEM", ~F.col("item_name").eqNullSafe(F.col("item"))),
        ("UNEXPECTED_UNIT", ~F.col("unit_name").eqNullSafe(F.col("unit"))),
        ("INVALID_PERIOD", F.col("quarter").isNull()),
        ("UNKNOWN_FLOOR", F.col("floor").isNull()),
        ("NON_NUMERIC_VALUE", ~F.col("_blank") & F.col("value").isNull()),
        ("NEGATIVE_VALUE", F.col("value") < 0),
        ("RATE_OVER_100", (F.col("metric") == "VACANCY_RATE") & (F.col("value") > 100))])
    return out.withColumn("issue", reason).drop("_blank")


def _scaled(value: Column) -> Column:
    """Exact integer ``value * 10^12``."""
    return wide(value.cast(f"decimal(24,{VALUE_SCALE})") * F.lit(10 ** VALUE_SCALE).cast("decimal(13,0)"))


def to_won(value: Column) -> Column:
    """Thousand won per square metre -> won, half up; null stays null."""
    return half_up_div(_scaled(value), F.lit(10 ** (VALUE_SCALE - 3)))


def to_percent_tenths(value: Column) -> Column:
    """Percent with one digit, half up, as a whole number of tenths."""
    return half_up_div(_scaled(value), F.lit(10 ** (VALUE_SCALE - 1)))


def monthly_reference(value: Column, area: Column, unit: Column) -> Column:
    """Rent x area in won with one rounding; a pyeong is exactly 400/121 square metres.

    ``area`` is decimal text with at most four decimals; anything else gives null.
    """
    ok = area.rlike(r"^\d+(\.\d{1,4})?$")
    tenk = wide(F.when(ok, area).try_cast("decimal(12,4)") * F.lit(10_000).cast("decimal(5,0)"))
    num = _scaled(value) * tenk
    den = 10 ** (VALUE_SCALE - 3 + 4)
    pyeong = half_up_div(num * 400, F.lit(den * 121))
    return F.when(tenk > 0, F.when(unit == "PYEONG", pyeong).otherwise(half_up_div(num, F.lit(den))))


def region_group(path: Column) -> Column:
    """Middle part of a three-level path."""
    parts = F.split(path, ">")
    return F.when(F.size(parts) == 3, F.get(parts, F.lit(1)))


def link_districts(regions: DataFrame, bridge: DataFrame, root: str) -> DataFrame:
    """(region_path, district_code) rows of surveyed places; only three-level paths are linked."""
    parts = F.split("region_path", ">")
    leaf = regions.where((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == root)).withColumn("_leaf", F.element_at(parts, -1))
    return (leaf.join(bridge.select(F.col("place").alias("_leaf"), "district_codes"), "_leaf")
                .select("region_path", F.explode("district_codes").alias("district_code")))


def unmapped_regions(regions: DataFrame, bridge: DataFrame, root: str) -> DataFrame:
    parts = F.split("region_path", ">")
    leaf = regions.where((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == root)).withColumn("_leaf", F.element_at(parts, -1))
    return leaf.join(bridge.select(F.col("place").alias("_leaf")), "_leaf", "left_anti").select("region_path")


def region_benchmarks(obs: DataFrame, latest_quarter: str) -> DataFrame:
    """Latest values, floors and the full rent trend per building and region, in one aggregate.

    Needs one row per observation key; a region then has one trend entry per quarter and one
    floor entry per floor code, so the collected arrays are short. The filter lets through the
    whole RENT series but only the newest quarter of the other metrics.
    """
    latest = F.col("quarter") == latest_quarter
    rows = obs.where((F.col("metric") == "RENT") | (F.col("metric").isin("FLOOR_RENT", "VACANCY_RATE") & latest))
    rent, won = F.col("metric") == "RENT", to_won(F.col("value"))
    floor_ord = F.array_position(F.array(*[F.lit(f) for f in FLOORS]), F.col("floor"))
    return rows.groupBy("building", "region_path").agg(
        F.max("region_name").alias("region_name"), F.max("region_level").alias("region_level"),
        F.max(F.when(rent & latest, won)).alias("latest_rent_won"),
        F.max(F.when(F.col("metric") == "VACANCY_RATE", to_percent_tenths(F.col("value")))).alias("vacancy_tenths"),
        F.array_sort(F.collect_list(F.when(F.col("metric") == "FLOOR_RENT", F.struct(
            floor_ord.alias("ord"), F.col("floor"), won.alias("won"))))).alias("floors"),
        F.array_sort(F.collect_list(F.when(rent, F.struct(
            F.col("quarter"), quarter_label(quarter_idx(F.col("quarter"))).alias("label"), won.alias("won"))))).alias("trend"),
    ).withColumn("group_name", region_group(F.col("region_path")))


def region_order(level: Column, name: Column, group: Column, group_order: Sequence[str] = GROUP_ORDER) -> list[Column]:
    """Sort keys: the whole city, then groups in fixed order (others by name), then level, then name."""
    g = F.when(level == 1, F.lit("")).when(level == 2, name).otherwise(F.coalesce(group, F.lit("")))
    pos = F.array_position(F.array(*[F.lit(x) for x in group_order]), g)
    rank = F.when(level == 1, -1).when(pos > 0, pos - 1).otherwise(len(group_order)).cast("int")
    return [rank.alias("group_rank"), g.alias("group_key"), level.alias("level_key"), name.alias("name_key")]
