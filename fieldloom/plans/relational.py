"""Queries over the catalogue: joins, windows, set operations, pages and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.plans.registry import query, table


@query("SELECT c_custkey, c_mktsegment, n_name, count(o_orderkey) AS jobs, round(coalesce(sum(o_totalprice), 0), 2) AS bytes FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def users_with_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their jobs and bytes, zero where there are none."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("jobs"), F.sum("o_totalprice").alias("bytes"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(o, "c_custkey", "left").select("c_custkey", "c_mktsegment", "n_name", F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs"), F.round(F.coalesce("bytes", F.lit(0.0)), 2).alias("bytes"))


@query("SELECT r_name, n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS longest FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("longest"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)")
def semi_join_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 200000))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def anti_join_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    return table(spark, sf_dir, "part").join(line, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT id, origin, price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY made DESC, origin) AS k FROM (SELECT o_orderkey AS id, 'a' AS origin, o_totalprice AS price, o_orderdate AS made FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'b', o_totalprice + 1, o_orderdate + to_days(CAST(o_orderkey % 5 - 2 AS INT)) FROM orders WHERE o_orderkey % 2 = 0)) WHERE k = 1")
def merge_newer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two report lists merged by id; the newer entry stays, the first list's on ties."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.col("o_orderdate").cast("date").alias("at"))
    a = o.where("id % 3 <> 0").select("id", F.lit("a").alias("origin"), F.col("o_totalprice").alias("price"), "at")
    b = o.where("id % 2 = 0").select("id", F.lit("b").alias("origin"), (F.col("o_totalprice") + 1).alias("price"), F.date_add("at", (F.col("id") % 5 - 2).cast("int")).alias("at"))
    k = F.row_number().over(W.partitionBy("id").orderBy(F.desc("at"), "origin"))
    return a.unionByName(b).withColumn("k", k).where("k = 1").select("id", "origin", "price")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 newest jobs before a moment: one page."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_orderdate")


@query("SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS period, count(*) AS requests, CAST(greatest(0, count(*) - 3) AS BIGINT) AS refused FROM events GROUP BY ALL")
def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user in fixed hours, and how many are over the limit of three."""
    period = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id", period.alias("period")).agg(F.count("*").alias("requests")).withColumn("refused", F.greatest(F.lit(0), F.col("requests") - 3).cast("long"))


BUCKETS = (10.0, 25.0, 50.0, 100.0, 250.0)


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{b:.0f}" for b in BUCKETS) + ", count(*) AS le_inf, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative bucket counts, as a monitoring page prints them."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(v <= b).alias(f"le_{b:.0f}") for b in BUCKETS], F.count("*").alias("le_inf"), F.round(F.sum("value"), 2).alias("total"))


@query("""
WITH x AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM x)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY ALL""")
def heartbeat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six hours of silence."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    gap = F.col("before").isNull() | (F.col("ts") - F.col("before") > F.expr("INTERVAL 6 HOURS"))
    x = x.withColumn("session", F.sum(gap.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"))


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k > 7")
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backups beyond the seven newest of each owner."""
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("k", k).where("k > 7").select("o_orderkey")


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    both, only = c.intersect(s), c.subtract(s)
    return both.agg(F.count("*").alias("n")).select(F.lit("both").alias("side"), "n").unionByName(only.agg(F.count("*").alias("n")).select(F.lit("customers").alias("side"), "n"))


@query("SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat_ws(':', '7', l_orderkey, l_linenumber, l_partkey)), l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 500")
def stratified_sample_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample without replacement of 500 cells of each class. The order has no equals but equal rows."""
    order = F.md5(F.concat_ws(":", F.lit("7"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]))
    k = F.row_number().over(W.partitionBy("l_returnflag").orderBy(order, "l_orderkey", "l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "lineitem").withColumn("k", k).where("k <= 500").select("l_returnflag", "l_orderkey", "l_linenumber")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 90")
