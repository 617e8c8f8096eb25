"""Queries over text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.plans.registry import query, table

NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'n''t\\b', ' not', 'g'), '''(s|re|ve|ll|d|m)\\b', ' ', 'g'), '[^a-z0-9.-]+', ' ', 'g'))"
listed = lambda words: ", ".join(f"'{w}'" for w in words)
STEM = "CASE WHEN length(w) <= 4 THEN w " + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 3 THEN left(w, length(w) - {len(e)}){' || chr(121)' * (e == 'ies')}" for e in text.ENDINGS) + " ELSE w END"
TOKENS = f"tok AS (SELECT item_id AS id, {STEM} AS token FROM (SELECT item_id, regexp_replace(unnest(string_split({NORMAL.format('text')}, ' ')), '^[.-]+|[.-]+$', '', 'g') AS w FROM benchmark) WHERE (length(w) >= 3 OR w IN ({listed(text.SHORT_WORDS)}) OR regexp_matches(w, '^[0-9]')) AND w NOT IN ({listed(text.STOP_WORDS)}))"
TOPICS = [("speech", 1, "thation", 1.0), ("speech", 1, "ther", 1.0), ("speech", 2, "ering", 0.5), ("nature", 1, "here", 1.0), ("nature", 2, "stand", 2.0), ("travel", 1, "onthe", 1.0), ("travel", 1, "inwh", 1.0), ("travel", 3, "entio", 0.7)]


@query(f"WITH {TOKENS} SELECT id, count(*) AS n, count(DISTINCT token) AS n_distinct FROM tok GROUP BY id")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(text.tokens(F.col("text"))).alias("token"))
    return x.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_distinct"))


@query(f"""
WITH {TOKENS}, own AS (SELECT DISTINCT id, token AS asked FROM tok), t AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {b}, '{c}', {d})" for a, b, c, d in TOPICS)}) t(topic, grp, token, weight)),
b AS (SELECT id, topic, grp, token, weight, max(CASE WHEN asked = token THEN 1.0 WHEN least(length(asked), length(token)) >= 5 AND (starts_with(asked, token) OR starts_with(token, asked)) THEN 0.9 WHEN least(length(asked), length(token)) >= 5 AND damerau_levenshtein(asked, token) <= CASE WHEN least(length(asked), length(token)) >= 8 THEN 2 ELSE 1 END THEN 0.8 ELSE 0 END) AS m FROM own, t GROUP BY ALL),
s AS (SELECT id, topic, sum(m * weight) AS score FROM (SELECT id, topic, grp, weight, min(m) AS m FROM b GROUP BY ALL) GROUP BY ALL HAVING sum(m * weight) > 0)
SELECT id, topic, round(CAST(score AS DOUBLE), 6) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, topic) AS INT) AS rank FROM s""")
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(text.tokens(F.col("text"))).alias("token"))
    topics = spark.createDataFrame(TOPICS, "topic string, grp int, token string, weight double")
    return text.topic_scores(x, topics).select("id", "topic", F.round("score", 6).alias("score"), "rank")
