"""Relational queries: joins of every kind, grouping sets, set operations, top-k, JSON and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table


@REGISTRY.add(
    "rel_pricing_summary",
    "2.4",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
)
def rel_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@REGISTRY.add(
    "rel_join_inner",
    "2.3",
    "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def rel_join_inner(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@REGISTRY.add("rel_join_left", "2.3", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def rel_join_left(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@REGISTRY.add("rel_join_full", "2.3", "SELECT coalesce(s_nationkey, c_nationkey) AS k, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM (SELECT * FROM supplier WHERE s_nationkey < 15) FULL JOIN (SELECT * FROM customer WHERE c_nationkey >= 10) ON s_nationkey = c_nationkey GROUP BY 1")
def rel_join_full(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_nationkey < 15").groupBy(F.col("s_nationkey").alias("k")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    c = table(spark, d, "customer").where("c_nationkey >= 10").groupBy(F.col("c_nationkey").alias("k")).agg(F.count_distinct("c_custkey").alias("customers"))
    return s.join(c, "k", "full").select("k", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@REGISTRY.add("rel_join_semi", "2.3", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def rel_join_semi(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(li, "o_orderkey", "left_semi").select("o_orderkey")


@REGISTRY.add("rel_join_anti", "2.3", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_join_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@REGISTRY.add(
    "rel_join_as_of",
    "2.3",
    "SELECT e.event_id, p.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts",
)
def rel_join_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last view at or before each purchase of the user: one sort per key instead of a range join."""
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "view"))
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(view.isNotNull(), F.struct("ts", view.alias("id")))).over(w)
    return e.select("event_id", "event_type", last["id"].alias("view_id")).where("event_type = 'purchase'").select("event_id", "view_id")


@REGISTRY.add(
    "rel_join_range",
    "2.3",
    "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'view' AND b.event_type = 'purchase'",
)
def rel_join_range(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within half an hour of a view: half-hour buckets make the range an equality join on two buckets."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    width = 1_800_000_000
    bucket = F.floor(F.col("t") / width)
    a = e.where("event_type = 'view'").select(F.col("event_id").alias("a"), "user_id", F.col("t").alias("ta"), F.explode(F.array(bucket, bucket + 1)).alias("k"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("b"), "user_id", F.col("t").alias("tb"), bucket.alias("k"))
    return a.join(b, ["user_id", "k"]).where((F.col("tb") > F.col("ta")) & (F.col("tb") <= F.col("ta") + width)).select("a", "b")


@REGISTRY.add("rel_cube", "2.4", "SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS BIGINT) AS g, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), F.sum("l_quantity").alias("q"))


@REGISTRY.add("rel_pivot", "2.4", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def rel_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@REGISTRY.add("rel_sets", "2.7", "SELECT 'union' AS op, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity < 3) UNION ALL SELECT 'except', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def rel_sets(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    union = table(spark, d, "supplier").select("s_nationkey").union(table(spark, d, "customer").select("c_nationkey")).distinct()
    both = li.where("l_quantity > 48").select("l_suppkey").intersect(li.where("l_quantity < 3").select("l_suppkey"))
    less = table(spark, d, "part").select("p_partkey").subtract(li.where("l_quantity > 40").select("l_partkey"))
    count = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return count("union", union).union(count("intersect", both)).union(count("except", less))


@REGISTRY.add("rel_top_per_group", "2.6", "SELECT c_nationkey, c_custkey, c_acctbal, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS k FROM customer) WHERE k <= 3")
def rel_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).alias("k")).where("k <= 3")


@REGISTRY.add("rel_dates", "2.8", "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def rel_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@REGISTRY.add("rel_json", "2.8", "SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL) GROUP BY 1")
def rel_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@REGISTRY.add("rel_windows_tumbling", "2.9", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def rel_windows_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("start"), "event_type", "n", "total")


@REGISTRY.add("rel_histogram_join", "2.3", "SELECT r_name, round(avg(c_acctbal), 4) AS balance, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def rel_histogram_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.avg("c_acctbal").alias("balance"), F.count("*").alias("n")), 4)
