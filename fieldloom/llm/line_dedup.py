"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line (smaller document id, then smaller line number) is within one edit of it: equal, or one
character put in, left out or replaced. Equal lines meet first, so that a line that stands in a third of all documents is
one row afterwards. A distinct line can have a neighbour only if it shares its first or its last half with another
one; lines that do emit the hashed keys of their variants with at most one character deleted. Lines with an equal
variant are compared by their edit distance: first each with the earliest line of the variant, then those that are still
without a neighbour with the others. The hash of a variant is a sum over its characters, so that deleting equal characters
gives one key, and a line emits as many keys as it has different characters.

Cases: with `short`, every line with a word takes part in equality, and only the edit is for lines of `min_chars` characters
or more; one edit makes another number or word of a shorter one. Without it, shorter lines always stay. Lines without a word
always stay. A null text stays null; an empty one
stays empty. A null id comes first. Repeated rows: equal lines at equal places of rows with one id count as one place and stay
together. Any columns may be there; they are kept, and none is read but the id and the text. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, materialize, unused

MIN_CHARS = 24
#: A character of a word.
WORD = r"[^\x20\x09-\x0D]"
#: Characters by which lengths are banded for the halves.
BAND = 4
#: Characters up to which lines are compared by Spark's edit distance.
LONG = 256


def _halves() -> list[F.Column]:
    """Keys of the first and the last half in the line's band of lengths, and in the band below where a line there can be one shorter."""
    n = F.length("line")
    band = F.floor(n / BAND)
    half = lambda b: (b * BAND / 2).cast("int")
    keys = lambda b: [F.xxhash64(b, F.lit(0), F.substring(F.col("line"), F.lit(1), half(b))), F.xxhash64(b, F.lit(1), F.right(F.col("line"), half(b)))]
    own, below = keys(band), keys(band - 1)
    return [*own, *[F.when(n % BAND == 0, k) for k in below]]


def _place(*prefix: str) -> F.Column:
    p = "".join(prefix)
    return F.struct(F.col(p + "doc_id").alias("doc_id"), F.col(p + "pos").alias("pos"))


def _variants() -> F.Column:
    """Hashed keys of the line and of every variant with one character less outside the shared half: the half, the length, and a sum over pairs of neighbouring characters.

    c: the line's characters between two empty ones; pairs: hashes of neighbours there; total: their sum; n: how many characters, a column because a
    length found anew for each variant would make them quadratic; half: struct of the half's key, whether it is the last one, and its length.
    """
    n = F.col("n")
    low = lambda x, y: F.xxhash64(x, y).bitwiseAND(F.lit(0xFFFFFFFF))
    at = F.when(F.col("half.last"), F.sequence(F.lit(1), n - F.col("half.size"))).otherwise(F.sequence(F.col("half.size") + 1, n))
    less = F.transform(at, lambda i: F.xxhash64("half.key", n - 1, F.col("total") - F.get("pairs", i - 1) - F.get("pairs", i) + low(F.get("c", i - 1), F.get("c", i + 1))))
    return F.concat(F.array(F.xxhash64("half.key", n, F.col("total"))), F.array_distinct(less))


def _with_pairs(texts: DataFrame) -> DataFrame:
    end = F.array(F.lit(""))
    x = texts.withColumn("c", F.concat(end, F.split("line", ""), end))
    x = x.withColumn("pairs", F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(0xFFFFFFFF))))
    return x.withColumns({"total": F.aggregate("pairs", F.lit(0).cast("long"), lambda a, v: a + v), "n": F.size("c") - 2})


def within_one_edit(a: str, b: str) -> F.Column:
    """Whether two columns are at most one edit apart. Long ones are compared after their first difference, as the edit distance of Spark is quadratic even within a bound."""
    n, m = F.length(a), F.length(b)
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), False).cast("int")
    rest = lambda c, skip: F.substring(F.col(c), at + skip, F.lit(2**31 - 1))
    long = F.when(at == 0, True).when(n == m, rest(a, 1) == rest(b, 1)).when(n == m + 1, rest(a, 1) == rest(b, 0)).when(m == n + 1, rest(a, 0) == rest(b, 1)).otherwise(False)
    return F.when(F.greatest(n, m) <= LONG, F.levenshtein(a, b, 1).between(0, 1)).otherwise(long)


def line_drops(docs: DataFrame, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """doc_id and drops (array of struct pos, h1: line number and hash) for each document that loses lines. docs: doc_id, text."""
    with Scratch(docs.sparkSession) as scratch:
        lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        lines = lines.where(F.col("line").rlike(WORD) if short else F.length("line") >= min_chars)
        h1, h2 = F.xxhash64("line"), F.xxhash64(F.lit("second"), "line")
        lines = scratch.keep(lines.select("doc_id", "pos", h1.alias("h1"), h2.alias("h2"), *[F.when(F.length("line") >= min_chars, k).alias(f"k{i}") for i, k in enumerate(_halves())]), "lines")
        line = ["h1", "h2"]
        distinct = scratch.keep(lines.groupBy(*line, "k0", "k1", "k2", "k3").agg(F.min(_place()).alias("first"), F.count("*").alias("n")), "distinct-lines")
        keys = distinct.select(*line, "first", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("which", "key")).where("key is not null")
        shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
        near = keys.join(shared, "key", "left_semi").groupBy(*line, "first").agg(F.collect_set(F.struct("which", "key")).alias("halves"))
        # The texts of those lines, from their first places.
        wanted = near.groupBy(F.col("first.doc_id").alias("at")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h1", "h2", "halves")).alias("wanted"))
        found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("at"))).select("doc_id", "wanted", F.split("text", "\n").alias("all"))
        # Lines are taken while the text is one row: after the explode, it would be split again for each of them.
        found = found.select("doc_id", F.explode(F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["pos"].alias("pos"), F.get("all", w["pos"]).alias("line"), w["halves"].alias("halves")))).alias("w"))
        found = found.select("w.h1", "w.h2", F.struct("doc_id", "w.pos").alias("first"), "w.line", "w.halves")
        found = found.where((F.xxhash64("line") == F.col("h1")) & (F.xxhash64(F.lit("second"), F.col("line")) == F.col("h2")))
        texts = scratch.keep(found.dropDuplicates(["h1", "h2"]), "near-lines")
        band = F.floor(F.length("line") / BAND) - F.floor(F.col("half.which") / 2)
        halves = _with_pairs(texts).select(*line, "first", "line", "c", "pairs", "total", "n", F.explode("halves").alias("half"))
        halves = halves.withColumn("half", F.struct("half.key", (F.col("half.which") % 2 == 1).alias("last"), (band * BAND / 2).cast("int").alias("size")))
        variants = halves.select(*line, "first", F.explode(_variants()).alias("key"))
        lead = variants.groupBy("key").agg(F.min(F.struct("first", "h1", "h2")).alias("lead"), F.count("*").alias("m")).where("m > 1")
        groups = scratch.keep(variants.join(lead.select("key", "lead"), "key"), "variant-groups")

        def close(pairs: DataFrame) -> DataFrame:
            """Lines of pairs (h1, h2, o1, o2) that are within one edit of the other."""
            a, b = texts.select("h1", "h2", F.col("line").alias("a")), texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("b"))
            return pairs.distinct().join(a, line).join(b, ["o1", "o2"]).where(within_one_edit("a", "b")).select(*line).distinct()

        first = close(groups.where("first > lead.first").select(*line, F.col("lead.h1").alias("o1"), F.col("lead.h2").alias("o2")))
        first = scratch.keep(first, "near-first")
        open_ = groups.where("first > lead.first").join(first, line, "left_anti").select("key", *line, "first")
        others = groups.select("key", F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("of"), "lead").where("of > lead.first").drop("lead")
        rest = close(open_.join(others, "key").where("of < first").select(*line, "o1", "o2"))
        gone = first.unionByName(rest).distinct().withColumn("near", F.lit(True))
        verdict = distinct.select(*line, "first", "n").join(gone, line, "left").where("n > 1 or near").select(*line, "first", F.coalesce("near", F.lit(False)).alias("near"))
        # A hot line's occurrences and its one verdict meet in a sort-merge join, whose large partitions are split at run time.
        drops = lines.select("doc_id", "pos", *line).join(verdict, line).where(F.col("near") | (_place() > F.col("first")))
        return materialize(drops.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "h1")).alias("drops")), "line-drops")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """docs without the lines that go; columns as before, and two more at the end: counts of lines before and dropped, named n_lines and n_dropped or, where docs has these, with underscores before."""
    at, gone, all_, out, kept_, before, dropped = unused(docs, "at", "drops", "lines", "out", "kept", "n_lines", "n_dropped")
    drops = line_drops(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_chars, short).select(F.col("doc_id").alias(at), F.col("drops").alias(gone))
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops[at]), "left").withColumn(all_, F.split(F.col(text_col), "\n"))
    # Of rows that share an id, each drops the lines that it has. Differences of numbers take a set, so long texts stay linear.
    joined = joined.withColumn(out, F.transform(F.filter(gone, lambda d: F.xxhash64(F.get(all_, d["pos"])) == d["h1"]), lambda d: d["pos"]))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(out)), lambda i: F.get(all_, i))
    joined = joined.withColumn(kept_, F.when(F.size(out) > 0, kept))
    size = F.coalesce(F.size(all_), F.lit(0)).cast("long")
    return joined.withColumns({
        before: F.when(F.col(text_col).isNull(), 0).otherwise(size).cast("long"),
        dropped: F.when(F.col(kept_).isNull(), 0).otherwise(size - F.size(kept_)).cast("long"),
        text_col: F.coalesce(F.array_join(kept_, "\n"), F.col(text_col)),
    }).select(*docs.columns, before, dropped)
