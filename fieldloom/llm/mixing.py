"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

The budget is the size of all sources. Each source should get it in proportion to its weight, but no source more than
`epochs` times its own size; what that leaves over goes to the rest by weight, until none is above. All targets together
are min(weight * level, cap) at one water level, which windows over the table of sources find without a loop. A source
whose target is 1.7 times its size is taken once whole, and 0.7 of it once more: its largest documents (over `large` of
the source, so at most 1 / large of them) in seeded order while that comes nearer, then others in seeded order up to what
then lacks. So the words taken differ from the target by half a document that is at most `large` of its source, or less,
unless a source has too few others.

Cases: a null text has size 0 and is never taken twice for its sake; a null source is a source of its own, ranked last.
Repeated rows are separate rows that share their fate when ids and sizes are equal up to the order among them. An empty table
gives an empty result. Sources of size 0 have target 0. Input columns are read by name; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.common import materialize, unused

WORD = r"[^\x20\x09-\x0D]+"


def words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, epochs: float = 3.0) -> DataFrame:
    """Adds target to a table of source, weight and source_size."""
    every, ranked = W.partitionBy(), W.orderBy("full_at", "source")
    x = sources.withColumns({"cap": epochs * F.col("source_size").cast("double")}).withColumn("full_at", F.col("cap") / F.col("weight"))
    x = x.withColumns({
        "below": F.coalesce(F.sum("cap").over(ranked.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(ranked.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "budget": F.sum("source_size").over(every).cast("double"),
    })
    # The level at which this source is the first that isn't full; the true one is the first that its own source can hold.
    x = x.withColumn("own", (F.col("budget") - F.col("below")) / F.col("open"))
    x = x.withColumn("level", F.first(F.when(F.col("own") <= F.col("full_at"), F.col("own")), ignorenulls=True).over(ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce("level", F.max("full_at").over(every)))
    return x.withColumn("target", target).drop("cap", "full_at", "below", "open", "budget", "own", "level")


def mix_plan(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: float = 3.0, seed: int = 42, large: float = 0.01, buckets: int = 64) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the document is taken) and taken (its words, repeats counted).

    weights repeat over the sources by code point, null last. buckets: parts into which each source's documents are dealt.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")).withColumn("order", order)
    # Hexadecimal digits of the order as a bucket: buckets are ranges of the order. Texts are read once.
    d = materialize(d.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 4), 16, 10).cast("long") * buckets / 65536)), "mix-sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = water_fill(sizes.withColumn("weight", F.get(cycle, F.pmod(n, F.lit(len(weights))))), epochs)
    sources = sources.withColumns({
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    }).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    dealt = sources.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<long>")))
    j = d.alias("d").join(dealt.alias("s"), [F.col("d.source").eqNullSafe(F.col("s.source")), F.col("d.bucket") == F.col("s.bucket")])
    j = j.select("d.doc_id", "d.source", "d.size", "d.order", "d.bucket", "s.source_size", "s.target", "s.whole", "s.rest")
    j = j.withColumn("big", F.col("size") > large * F.col("source_size"))
    # Large documents: at most 1 / large for each source.
    seeded = ["order", "doc_id"]
    big = j.where("big").withColumn("upto", F.sum("size").over(W.partitionBy("source").orderBy(*seeded).rowsBetween(W.unboundedPreceding, W.currentRow)))
    big = big.withColumn("quota", F.col("rest") * F.sum("size").over(W.partitionBy("source")) / F.col("source_size"))
    big = big.withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("quota")).cast("long"))
    taken = big.groupBy("source").agg(F.sum(F.col("size") * F.col("more")).alias("big_taken"))
    # Others: what all buckets before hold, then a running sum inside the bucket.
    small = j.where("not big")
    held = small.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    held = held.withColumn("before", F.sum("held").over(W.partitionBy("source").orderBy("bucket")) - F.col("held"))
    held = held.alias("h").join(taken.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")), "left").select("h.source", "h.bucket", "before", F.coalesce("big_taken", F.lit(0)).alias("big_taken"))
    small = small.alias("d").join(held.alias("h"), [F.col("d.source").eqNullSafe(F.col("h.source")), F.col("d.bucket") == F.col("h.bucket")]).select("d.*", "before", "big_taken")
    run = F.sum("size").over(W.partitionBy("source", "bucket").orderBy(*seeded).rowsBetween(W.unboundedPreceding, W.currentRow))
    small = small.withColumn("more", (F.col("before") + run - F.col("size") / 2 <= F.col("rest") - F.col("big_taken")).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "more"]
    both = small.select(*columns).unionByName(big.select(*columns))
    copies = F.least(F.col("whole") + F.when(F.col("size") > 0, F.col("more")).otherwise(0), F.lit(int(epochs)))
    return both.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it. Rows with equal id, source and size share their copies out among them, the first by text taking the most."""
    at, source, size, copies, place = unused(docs, "at", "its_source", "size", "copies", "place")
    plan = mix_plan(docs, weights, id_col, text_col, source_col, **settings).groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias(copies))
    plan = materialize(plan.where(F.get(copies, F.lit(0)) > 0).select(F.col("doc_id").alias(at), F.col("source").alias(source), F.col("size").alias(size), copies), "copies")
    same = docs[id_col].eqNullSafe(F.col(at)) & docs[source_col].eqNullSafe(F.col(source)) & (words(docs[text_col]) == F.col(size))
    times = lambda x, k: x.withColumn(place, F.explode(F.sequence(F.lit(1).cast("long"), F.get(copies, k)))).select(*docs.columns)
    out = times(docs.join(plan.where(F.size(copies) == 1), same), F.lit(0))
    if not plan.where(F.size(copies) > 1).limit(1).count():
        return out
    order = W.partitionBy(at, source, size).orderBy(text_col)
    several = docs.join(plan.where(F.size(copies) > 1), same).withColumn(place, F.row_number().over(order) - 1)
    return out.unionByName(times(several.where(F.get(copies, F.col(place)) > 0), F.col(place)))
