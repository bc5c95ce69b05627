"""The relational operators that the document operators rest on, each shown on the star-schema tables.

Joins against tables that grow are left to the planner; only tables of fixed size are hinted. The range and as-of joins avoid
a nested loop: the one by buckets of the range, the other by one sort of both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.tables import load


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """``points`` within ``[low, high)`` of ``ranges``, by equi-join on buckets of ``width`` and a filter.

    A range is repeated for each bucket it touches, so ``width`` should be about the usual length of a range.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("bigint")
    left = points.withColumn("_b", bucket(at))
    right = ranges.withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    return left.join(right, "_b").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """For each left row the last right ``value`` at or before its ``at``; null if there is none.

    Both sides are sorted together once and the value is carried forward. Rows of one key go to one task: keys are expected to be
    many. Ties in ``at`` go to the greatest value.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    so_far = Window.partitionBy(*by).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(so_far)).where("_side = 1").drop("_side", "_v")


def top_per_group(df: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most)


def q_pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


def q_semi(spark: SparkSession, folder: str) -> DataFrame:
    late = load(spark, folder, "lineitem").where("l_returnflag = 'R'")
    orders = load(spark, folder, "orders")
    return orders.join(late, orders.o_orderkey == late.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def q_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without an urgent order that is done."""
    customers, orders = load(spark, folder, "customer"), load(spark, folder, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti").select("c_custkey", "c_name")


def q_star(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue per region: the two dimension tables of fixed size are broadcast."""
    nation = load(spark, folder, "nation").join(F.broadcast(load(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = load(spark, folder, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = load(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def q_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n")
    )


def q_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_suppkey").alias("n_suppliers")
    )


def q_running(spark: SparkSession, folder: str) -> DataFrame:
    so_far = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, folder, "orders").select(
        "o_orderkey", F.round(F.sum("o_totalprice").over(so_far.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.lag("o_orderkey").over(so_far).alias("before"),
    )


def q_top(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)


def q_range(spark: SparkSession, folder: str) -> DataFrame:
    """Parts counted per price band of their own size class."""
    parts = load(spark, folder, "part").select("p_partkey", "p_retailprice")
    bands = spark.range(0, 20).select(F.col("id").alias("band"), (F.col("id") * 120.0).alias("low"), (F.col("id") * 120.0 + 200.0).alias("high"))
    return range_join(parts, bands, "p_retailprice", "low", "high", 150.0).groupBy("band").agg(F.count("*").alias("n"))


def q_asof(spark: SparkSession, folder: str) -> DataFrame:
    """For every event the value of the user's last purchase or click of another kind up to then."""
    events = load(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    first = events.agg(F.min("event_type").alias("t"))
    right = events.join(F.broadcast(first), F.col("event_type") == F.col("t")).select("user_id", "ts", F.col("value").alias("last_value"))
    left = events.select("event_id", "user_id", "ts")
    return asof_join(left, right, ["user_id"], "ts", "last_value").select("event_id", "last_value")


def q_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "lineitem")
    returned = rows.where("l_returnflag = 'R'").select("l_partkey")
    open_ = rows.where("l_linestatus = 'O'").select("l_partkey")
    label = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return label(returned.intersect(open_), "intersect").unionByName(label(returned.subtract(open_), "except")).unionByName(
        label(returned.union(open_).distinct(), "union")
    )


QUERIES = {
    "rel_pricing_summary": q_pricing_summary, "rel_semi_join": q_semi, "rel_anti_join": q_anti, "rel_star_join": q_star, "rel_cube": q_grouping_sets,
    "rel_distinct": q_distinct, "rel_running": q_running, "rel_top_per_group": q_top, "rel_range_join": q_range, "rel_asof_join": q_asof, "rel_set_operations": q_sets,
}
SQL = {
    "rel_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "rel_semi_join": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY ALL",
    "rel_anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
    "rel_star_join": """SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "rel_cube": "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rel_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY ALL",
    "rel_running": """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER w AS before FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""",
    "rel_top_per_group": """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT o_custkey, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2""",
    "rel_range_join": "SELECT band, count(*) AS n FROM part JOIN (SELECT band, band * 120 AS low, band * 120 + 200 AS high FROM range(20) r(band)) ON p_retailprice >= low AND p_retailprice < high GROUP BY band",
    "rel_asof_join": """WITH r AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL)
  SELECT e.event_id, r.v AS last_value FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts""",
    "rel_set_operations": """SELECT 'intersect' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')
  UNION ALL SELECT 'except', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')
  UNION ALL SELECT 'union', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')""",
}
