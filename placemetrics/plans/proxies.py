"""Input tables of the registered queries, derived from the parquet tables of a data folder.

Each proxy is a DataFrame over whole tables; choices that look arbitrary are arithmetic on
keys, so that the same proxy can be written again, independently, in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from placemetrics.functions.money import cents
from placemetrics.functions.quarter import quarter_code, quarter_of_date

# Market segments as industries.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SUPPORTED = ("CS100002", "CS100004", "CS100005")
MIN_STORES = 3          # the small tables are thin; the library default stays 5
FIRST_YEAR, LAST_YEAR = 1995, 2001


class Tables:
    """Parquet tables of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row, dealt out to as many tasks as a shuffle has."""
        return getattr(self, name).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(self, name: str, key: str) -> DataFrame:
        """The same by a hash of a key, which sorts nothing: a small file of many rows is read by one task."""
        return getattr(self, name).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)


def industry_no(segment: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), segment).cast("int")


def industry_code(segment: Column) -> Column:
    return F.concat(F.lit("CS10000"), industry_no(segment).cast("string"))


def f_area(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("area_no"),
        F.substring(F.lit("ADRUX"), F.col("n_regionkey") + 1, F.lit(1)).alias("area_type"),
        (F.col("n_nationkey") + 3000000).cast("string").alias("area_code"),
        F.col("n_name").alias("area_name"),
        (F.col("n_regionkey") + 11000).cast("string").alias("district_code"),
        F.col("r_name").alias("district_name"))


def f_industry(t: Tables) -> DataFrame:
    code = industry_code(F.col("c_mktsegment"))
    return t.customer.select(code.alias("industry_code"), F.col("c_mktsegment").alias("industry_name"),
                             code.isin(*SUPPORTED).alias("supported")).distinct()


def f_customer(t: Tables) -> DataFrame:
    return (t.customer.join(f_area(t), F.col("c_nationkey") == F.col("area_no"))
             .select("c_custkey", "area_no", "area_type", "area_code",
                     industry_no(F.col("c_mktsegment")).alias("industry_no"),
                     industry_code(F.col("c_mktsegment")).alias("industry_code")))


def f_order(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.dayofweek("o_orderdate").alias("dow"),
                        quarter_of_date(F.col("o_orderdate")).alias("quarter_idx"))
    return o.join(f_customer(t), F.col("o_custkey") == F.col("c_custkey"))


KEY = ["area_type", "area_code", "industry_code", "quarter_idx"]


def _order_sales(t: Tables) -> DataFrame:
    """All lines with the keys of their order: settled ones at the customer's area, open and returned
    ones at the head office of its area type, which has sales but no stores.

    Lines are summed before the join: an order ships two rows at most, however many lines it has.
    """
    settled = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R")
    lines = t.lineitem.groupBy("l_orderkey", settled.alias("_settled")).agg(
        F.sum(cents(F.col("l_extendedprice"))).alias("_amount"), F.count(F.lit(1)).alias("_count"))
    j = lines.join(f_order(t), F.col("l_orderkey") == F.col("o_orderkey"))
    office = F.instr(F.lit("ADRUX"), F.col("area_type"))
    return j.withColumns({"area_no": F.when(F.col("_settled"), F.col("area_no")).otherwise(90 + office),
                          "area_code": F.when(F.col("_settled"), F.col("area_code")).otherwise(F.concat(F.lit("309999"), office.cast("string")))})


def f_sales(t: Tables) -> DataFrame:
    return (_order_sales(t).groupBy(*KEY, "area_no", "industry_no")
            .agg(F.sum("_amount").alias("sales_amount"), F.sum("_count").alias("sales_count")))


def f_stores(t: Tables) -> DataFrame:
    """Distinct customers per cell as stores. A customer has one row per quarter after the first
    aggregate, so the window over a customer is at most as long as the period."""
    cq = (t.orders.select(F.col("o_custkey").alias("c_custkey"), quarter_of_date(F.col("o_orderdate")).alias("quarter_idx"))
           .groupBy("c_custkey", "quarter_idx").agg(F.count(F.lit(1)).alias("_orders")))
    w = Window.partitionBy("c_custkey")
    life = cq.select("c_custkey", "quarter_idx", F.min("quarter_idx").over(w).alias("_first"),
                     F.max("quarter_idx").over(w).alias("_last"))
    j = life.join(f_customer(t), "c_custkey")
    franchise = F.col("c_custkey") % 5 == 0

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return j.groupBy(*KEY, "area_no", "industry_no").agg(
        n(~franchise).alias("store_count"), F.count(F.lit(1)).alias("similar_store_count"),
        n(franchise).alias("franchise_store_count"), n(F.col("_first") == F.col("quarter_idx")).alias("opened_store_count"),
        n(F.col("_last") == F.col("quarter_idx")).alias("closed_store_count"))


def f_sales_keyed(t: Tables) -> DataFrame:
    return f_sales(t).drop("area_no", "industry_no")


def f_stores_keyed(t: Tables) -> DataFrame:
    return f_stores(t).drop("area_no", "industry_no")


def f_panel(t: Tables) -> DataFrame:
    """Full panel of all industries, franchise counts blanked in places."""
    from placemetrics.operators.panel import build_panel

    stores = f_stores(t)
    hole = (F.col("area_no") * 7 + F.col("quarter_idx")) % 53 == 0
    stores = stores.withColumn("franchise_store_count",
                               F.when(~hole, F.col("franchise_store_count"))).drop("area_no", "industry_no")
    return build_panel(f_sales_keyed(t), stores)


def f_series(t: Tables) -> DataFrame:
    """Every area x industry."""
    codes = F.array(*[F.lit(f"CS10000{i + 1}") for i in range(len(SEGMENTS))])
    return f_area(t).select("area_type", "area_code", "area_name", F.explode(codes).alias("industry_code"))


def f_breakdown(t: Tables) -> DataFrame:
    """Long breakdown points: weekday and priority groups."""
    j = _order_sales(t)
    points = F.array(
        F.struct(F.lit("DAY").alias("grp"), F.col("dow").cast("string").alias("point")),
        F.struct(F.lit("PRIORITY").alias("grp"), F.substring("o_orderpriority", 1, 1).alias("point")))
    return (j.select(*KEY, "area_no", "industry_no", "_amount", "_count", F.explode(points).alias("_p"))
             .groupBy(*KEY, "area_no", "industry_no", F.col("_p.grp").alias("grp"), F.col("_p.point").alias("point"))
             .agg(F.sum("_amount").alias("amount"), F.sum("_count").alias("count")))


def _dirty_key() -> Column:
    return F.col("area_no") * 10000 + F.col("industry_no") * 1000 + (F.col("quarter_idx") - 7900)


def f_dirty_sales(t: Tables) -> DataFrame:
    """Sales rows as text, with defects at fixed keys and every 97th row repeated."""
    s = f_sales(t).withColumn("k", _dirty_key().cast("bigint")).join(
        f_area(t).select("area_code", "area_name"), "area_code", "left").withColumn("area_name", F.coalesce("area_name", F.lit("HEAD OFFICE")))
    m = F.col("k") % 97
    amount = F.col("sales_amount").cast("string")
    rows = s.select(
        "k",
        F.when(m == 6, F.lit("19950")).otherwise(quarter_code(F.col("quarter_idx"))).alias("quarter"),
        "area_type",
        F.when(m == 3, F.lit("3000999")).when(m == 7, F.lit("30001")).otherwise(F.col("area_code")).alias("area_code"),
        F.when(m == 8, F.concat(F.col("area_name"), F.lit("*"))).otherwise(F.col("area_name")).alias("area_name"),
        F.when(m == 5, F.lit("C100")).otherwise(F.col("industry_code")).alias("industry_code"),
        F.concat(F.lit("IND "), F.col("industry_no").cast("string"),
                 F.when(m == 9, F.lit(" renamed")).otherwise(F.lit(""))).alias("industry_name"),
        F.floor(F.col("quarter_idx") / 4).cast("int").alias("year"),
        F.when(m == 0, F.lit("-5")).when(m == 1, F.lit("")).when(m == 2, F.lit("x1"))
         .when(m == 10, F.concat(F.lit(" 00"), amount, F.lit(" "))).when(m == 11, F.lit("UNSAFE:9007199254740993"))
         .when(m == 12, F.lit("1234567890123456789")).otherwise(amount).alias("sales_amount"),
        F.when(m == 13, F.lit("99999999999999999")).when(m == 14, F.lit("-1")).when(m == 15, F.lit(" "))
         .otherwise(F.col("sales_count").cast("string")).alias("sales_count"),
        F.when(m == 4, 2).otherwise(1).alias("_copies"))
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(
        (F.col("k") * 10 + F.col("_copy")).alias("line"), *[c for c in rows.columns if c not in ("k", "_copies")])


def f_dirty_stores(t: Tables) -> DataFrame:
    """Store rows whose identity is broken at every 97th key."""
    s = f_stores(t).withColumn("k", _dirty_key().cast("bigint"))
    return s.withColumn("similar_store_count", F.col("similar_store_count") + F.when(F.col("k") % 97 == 0, 1).otherwise(0))
