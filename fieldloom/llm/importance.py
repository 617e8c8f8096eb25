"""Importance resampling towards a target distribution, by hashed n-gram features.

1. In each task DuckDB takes the texts a few megabytes at a time: SQL lower-cases A-Z, unnests the words, joins runs of up to `n` of them in
   windows over a text's words, hashes each distinct feature with a registered zlib CRC function, and counts buckets for each text.
2. A text's bucket counts are spilled to Parquet in the shared folder, once; nothing reads the texts again. Spark merges them into the
   buckets' counts over all documents and all target texts: tables of `buckets` rows, added up in each task before they are shuffled.
3. A bucket's gain is floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))). A document's weight is the floored mean of its features'
   gains, its score adds Gumbel noise from a seeded digest of its id, so that the highest scores are a draw without replacement in
   proportion to the weights' exponentials.
4. Documents of `least_words` words or more are put in order of their scores over ranges of the order, whose counts alone are added up in one
   place, and the first share of them is drawn.

The gains go to the tasks as one array, whose size `buckets` bounds.

Cases: a null or empty text has no features, weight 0 and is never drawn. Ties of scores go to the smaller id; equal rows are
interchangeable. A null id is seeded as an empty one and comes last among ties. Only the id and the text are read. Long texts are
handled whole, alone if they are long. An empty table gives no rows; empty targets give every bucket t = T = 0.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, chunked, materialize, text_bytes

BUCKETS = 10_000
#: Words of lower-cased texts: digits, small letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that DuckDB takes at a time, and its memory.
SLICE_BYTES, MEMORY = 4 << 20, "400MB"


def crc32s(x: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(v or b"") for v in x.cast(pa.binary()).to_pylist()], pa.int64())


def feature_sql(n: int, buckets: int) -> str:
    """SQL over texts (k, text): k, n_words, bucket counts as two lists."""
    runs = " UNION ALL ".join(
        ["SELECT k, word AS feature FROM words"]
        + [f"SELECT k, feature FROM (SELECT k, concat_ws(' ', {', '.join(['word', *(f'lead(word, {j}) OVER w' for j in range(1, m))])}) AS feature, lead(word, {m - 1}) OVER w AS last FROM words WINDOW w AS (PARTITION BY k ORDER BY place)) WHERE last IS NOT NULL" for m in range(2, n + 1)]
    )
    return f"""
WITH words AS (SELECT k, unnest(found) AS word, generate_subscripts(found, 1) AS place FROM (SELECT k, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS found FROM texts)),
features AS ({runs}),
counted AS (SELECT k, feature, count(*) AS n FROM features GROUP BY k, feature),
hashed AS (SELECT feature, crc(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted)),
sums AS (SELECT k, bucket, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN hashed USING (feature) GROUP BY k, bucket),
lists AS (SELECT k, list(CAST(bucket AS INTEGER) ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM sums GROUP BY k),
sizes AS (SELECT k, count(*) AS n_words FROM words GROUP BY k)
SELECT t.k, coalesce(n_words, 0) AS n_words, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts FROM texts t LEFT JOIN sizes USING (k) LEFT JOIN lists USING (k) ORDER BY t.k"""


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, buckets and counts (arrays alike in length) of each row of texts (id, text)."""
    sql = feature_sql(n, buckets)

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        con.create_function("crc", crc32s, ["VARCHAR"], "BIGINT", type="arrow")
        for b in batches:
            own = text_bytes(b.column(1))
            for i, j in chunked(own, SLICE_BYTES):
                con.register("texts", pa.table({"k": pa.array(range(j - i), pa.int32()), "text": pa.array(own[i:j], pa.binary()).cast(pa.string())}))
                found = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("texts")
                for x in found.to_batches():
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[x.column(c).cast(t) for c, t in ((1, pa.int64()), (2, pa.list_(pa.int32())), (3, pa.list_(pa.int64())))]], names=["id", "n_words", "buckets", "counts"])
        con.close()

    return texts.mapInArrow(run, "id long, n_words long, buckets array<int>, counts array<long>")


def merged(counted: DataFrame) -> dict[int, int]:
    """Count of each bucket over all rows; as many as there are buckets."""
    x = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("f")).groupBy("f.buckets").agg(F.sum("f.counts").alias("n"))
    return {r.buckets: r.n for r in x.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    s_all, t_all = sum(source.values()), sum(target.values())
    of = lambda s, t: math.floor(1000 * math.log((t + 1.0) * (s_all + float(buckets)) / ((s + 1.0) * (t_all + float(buckets)))))
    return [of(source.get(b, 0), target.get(b, 0)) for b in range(buckets)]


def ranked(x: DataFrame, scratch: Scratch, *order) -> DataFrame:
    """Adds rank (from 1) in the given order. Rows are numbered inside ranges of the order, kept in files; a range's count is one row."""
    x = scratch.keep(x.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before, out = 0, []
    for r in sorted(x.groupBy("part").agg(F.count("*").alias("c")).collect()):
        out.append((r.part, before))
        before += r.c
    starts = x.sparkSession.createDataFrame(out, "part int, before long")
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return x.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def importance_resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for those that aren't drawn."""
    with Scratch(docs.sparkSession) as scratch:
        own = scratch.keep(bucket_counts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n, buckets), "bucket-counts")
        aims = scratch.keep(bucket_counts(target.select(F.lit(0).cast("long").alias("id"), F.col(target_text).alias("text")), n, buckets), "target-counts")
        table = F.split(F.lit(",".join(map(str, gains(merged(own), merged(aims), buckets)))), ",").cast("array<long>")  # folded to a constant
        total = F.aggregate(F.arrays_zip("buckets", "counts"), F.lit(0).cast("long"), lambda s, f: s + f["counts"] * F.get(table, f["buckets"]))
        size = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
        x = own.select(F.col("id").alias("doc_id"), "n_words", size.alias("n_features"), total.alias("total"))
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
        x = x.withColumn("weight", weight.cast("long")).withColumn("score", (F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))).cast("long"))
        x = scratch.keep(x.drop("total"), "scores")
        able = x.where(F.col("n_words") >= least_words)
        draw = percent * able.count() // 100
        drawn = ranked(able, scratch, F.desc("score"), F.asc_nulls_last("doc_id"))
        rest = x.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
        out = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(rest)
        return materialize(out.select("doc_id", "n_features", "weight", "score", "rank"), "drawn")
