"""The queries of this subpackage, one for each operator, over the whole tables, and SQL that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import ann, brown_lm, importance, licenses, line_dedup, mixing, ngram_join, packing, prefix_trie, quality_rules, secrets, token_codes, url_filter
from fieldloom.llm.common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read(spark, sf_dir, "documents"), n=3, percent=90)


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.lm_scores(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(read(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mixing.mix_plan(read(spark, sf_dir, "documents"), [5, 2, 1])
    return x.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = line_dedup.line_dedup(read(spark, sf_dir, "documents"), short=True)
    return x.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op11_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.encoded_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"), rebuild=True)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        *(op1_license_scan, op2_ngram_join, op3_brown_lm, op4_quality_rules, op5_packing, op6_url_filter, op7_mixing, op8_nearest, op9_secret_scan, op10_line_dedup),
        *(op11_token_codes, op12_prefix_trie, op13_importance),
    )
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)

OP6 = rf"""
WITH x AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM x),
r AS (SELECT * FROM (VALUES {_RULES}) t(h, q, v)),
m AS (SELECT page_id, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(q) DESC) AS k FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1"""

OP7 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
o AS (SELECT *, md5(concat_ws(':', '42', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))) AS ord FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM o GROUP BY source),
w AS (SELECT source, source_size, CAST(CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(3 AS DOUBLE) * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS full_at, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(own, (full_at, source)) FROM f WHERE own <= full_at)) AS target FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
j AS (SELECT o.*, source_size, target, whole, target - whole * source_size AS rest, size > CAST(0.01 AS DOUBLE) * source_size AS big FROM o JOIN q ON o.source IS NOT DISTINCT FROM q.source),
b AS (SELECT *, sum(size) OVER (PARTITION BY source, big ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY source, big) AS held FROM j),
g AS (SELECT *, CASE WHEN big AND upto - size / 2.0 <= rest * held / source_size THEN 1 ELSE 0 END AS more FROM b),
k AS (SELECT *, coalesce(sum(CASE WHEN big THEN size * more ELSE 0 END) OVER (PARTITION BY source), 0) AS big_taken FROM g),
c AS (SELECT *, CAST(least(whole + CASE WHEN size = 0 THEN 0 WHEN big THEN more WHEN upto - size / 2.0 <= rest - big_taken THEN 1 ELSE 0 END, 3) AS BIGINT) AS copies FROM k)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM c"""



def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes: a byte is taken in, then eight steps of a bit each."""
    octets = f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: [CAST('0x' || x AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN v >= 0 THEN xor(c, v) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce({octets}, lambda c, v: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


OP12 = rf"""
WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, n, role, text FROM c JOIN t ON t.conv_id = base AND n <= h UNION ALL SELECT c.conv_id, 1, n, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND n > h),
p AS (SELECT conv_id, md5(role || '/' || md5(text)) AS own, len(regexp_extract_all(text, '[^ 	-]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS depth FROM r),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS words FROM c UNION ALL SELECT w.conv_id, p.depth, md5(w.node || p.own), w.node, p.words FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth = w.depth + 1),
e AS (SELECT *, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM w),
g AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
l AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (depth, node)),
o AS (SELECT e.depth, e.node, sum(l.saved) OVER below AS saved, sum(CASE WHEN l.n_children = 0 THEN 1 END) OVER below AS leaves FROM e LEFT JOIN l ON l.depth = e.depth AND l.node = e.node AND l.conv_id = e.conv_id WINDOW below AS (PARTITION BY e.conv_id ORDER BY e.depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT depth, node, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(leaves) AS BIGINT) AS n_leaves FROM o GROUP BY depth, node)
SELECT l.conv_id, l.depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens, l.ends_sha256 FROM l JOIN s USING (depth, node) LEFT JOIN l u ON u.depth = l.depth - 1 AND u.node = l.parent"""

OP13 = rf"""
WITH f AS (SELECT 1 AS own, doc_id, unnest(regexp_extract_all(translate(text, '{importance.UPPER}', '{importance.LOWER}'), '{importance.WORD}')) AS word FROM documents UNION ALL SELECT 0, NULL, unnest(regexp_extract_all(translate(text, '{importance.UPPER}', '{importance.LOWER}'), '{importance.WORD}')) FROM benchmark),
h AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM f)),
b AS (SELECT bucket, count(*) FILTER (own = 1) AS s, count(*) FILTER (own = 0) AS t FROM f JOIN h USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((s + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS gain FROM b),
d AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN h USING (word) JOIN g USING (bucket) WHERE own = 1 GROUP BY doc_id),
x AS (SELECT m.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || m.doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents m LEFT JOIN d ON d.doc_id = m.doc_id),
k AS (SELECT *, n_features >= 20 AS able, count(*) FILTER (n_features >= 20) OVER () AS many, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * many // 100 THEN place END AS rank FROM k"""

#: The other operators' results have no SQL: automata, components, fitted models, plans; tests compare them with plain versions.
ORACLES: dict[str, str] = {"op6_url_filter": OP6, "op7_mixing": OP7, "op12_prefix_trie": OP12, "op13_importance": OP13}
