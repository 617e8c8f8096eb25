"""Queries that replay the events as a stream of files and return the final table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.registry import query, table
from fieldloom.session import shared_folder
from fieldloom.streaming import confirm, monitor


def replay(spark: SparkSession, source: DataFrame, transform, mode: str = "append", files: int = 8) -> DataFrame:
    """Writes a batch as files in the shared folder, streams at most `files` a trigger (0: all) through transform, and reads what came out."""
    at = f"{shared_folder(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    source.write.parquet(f"{at}/in")
    reader = spark.readStream.schema(source.schema)
    stream = transform((reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{at}/in"))
    job = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def replay_in_order(spark: SparkSession, source: DataFrame, at: str, transform, slices: int = 6) -> DataFrame:
    """Streams a batch by slices of time, one run of the stream for each, as a scheduler would start it: every run takes what is new, from the checkpoint of the last one.

    A run's rows are one slice, so state that sorts what it gets in a trigger holds no more than that; only the slices' bounds come to the driver.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    seconds = F.col(at).cast("timestamp").cast("double")
    bounds = source.agg(F.percentile_approx(seconds, [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    # A slice ends with its bound; the last one has none.
    edges = [-float("inf"), *sorted(set(bounds)), float("inf")]
    for low, high in zip(edges, edges[1:]):
        source.where((seconds > low) & (seconds <= high)).write.mode("append").parquet(f"{folder}/in")
        stream = transform(spark.readStream.schema(source.schema).parquet(f"{folder}/in"))
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("""
WITH x AS (SELECT user_id AS cell, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value / 100 END AS v FROM events),
c AS (SELECT cell, ts, v <= 0.4 AS low, row_number() OVER (PARTITION BY cell ORDER BY ts) AS i FROM x WHERE v IS NOT NULL),
r AS (SELECT *, i - row_number() OVER (PARTITION BY cell, low ORDER BY i) AS island FROM c),
k AS (SELECT cell, island, min(ts) AS since, min(CASE WHEN n = 2 THEN ts END) AS confirmed FROM (SELECT *, row_number() OVER (PARTITION BY cell, island ORDER BY i) AS n FROM r WHERE low) GROUP BY cell, island)
SELECT cell, since, confirmed FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY confirmed) AS first FROM k WHERE confirmed IS NOT NULL) WHERE first = 1""")
def confirmed_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose value fell by 0.2 or more below a reference of 0.6 at two consecutive clear observations, from a stream."""
    e = table(spark, sf_dir, "events")
    x = e.select(F.col("user_id").alias("cell"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") != "error", F.col("value") / 100).alias("value"), F.lit(0.6).alias("reference"))
    return replay_in_order(spark, x, "at", lambda s: confirm.confirm(s, drop=0.2)).select("cell", F.col("since").cast("timestamp_ntz").alias("since"), F.col("confirmed").cast("timestamp_ntz").alias("confirmed"))


@query("SELECT event_type, date_trunc('hour', ts) AS began, count(*) AS n FROM events GROUP BY ALL")
def windowed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each kind by the hour."""
    return confirm.windowed_counts(table(spark, sf_dir, "events")).select("event_type", F.col("began").cast("timestamp_ntz").alias("began"), "n")


@query("""
WITH x AS (SELECT user_id AS cell, ts, CAST(1 + month(ts) AS INT) AS version, CASE WHEN event_type = 'error' THEN NULL ELSE value / 100 END AS v FROM events),
c AS (SELECT cell, version, ts, v, v <= 0.4 AS low, row_number() OVER (PARTITION BY cell, version ORDER BY ts) AS i FROM x WHERE v IS NOT NULL),
r AS (SELECT *, i - row_number() OVER (PARTITION BY cell, version, low ORDER BY i) AS island FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY cell, version, island ORDER BY i) AS n, min(ts) OVER (PARTITION BY cell, version, island) AS since FROM r WHERE low)
SELECT cell, version, since, ts AS confirmed, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY cell, version ORDER BY ts) AS first FROM n WHERE n = 2) WHERE first = 1""")
def monitored_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed drops with a reference that is rebuilt each month, from a stream with versioned state."""
    monitor.stateful(spark)
    e = table(spark, sf_dir, "events")
    x = e.select(F.col("user_id").alias("cell"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") != "error", F.col("value") / 100).alias("value"), F.lit(0.6).alias("reference"), (1 + F.month("ts")).alias("version"))
    with monitor.one_trigger(spark):
        found = replay_in_order(spark, x, "at", lambda s: monitor.monitored(s))
    return found.select("cell", "version", F.col("since").cast("timestamp_ntz").alias("since"), F.col("confirmed").cast("timestamp_ntz").alias("confirmed"), "value")


@query("""
WITH x AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before, max(ts) OVER () AS newest FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM x)
SELECT user_id AS user, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= any_value(newest)""")
def silent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that six hours of silence ended, by session windows of a stream; those still open aren't there."""
    monitor.stateful(spark)
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("at"))
    found = replay_in_order(spark, x, "at", lambda s: monitor.ended_sessions(s))
    return found.select("user", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")
