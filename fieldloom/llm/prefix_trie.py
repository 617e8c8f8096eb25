"""The prefix trie of conversations: how many share each sequence of first turns, and what sharing saves.

A conversation is the sequence of its turns (role and text), ordered by turn, null first, turns alike by a hash of role and text. A
node is a distinct sequence of first turns; the root is the empty one.

1. Texts become two 64-bit hashes and a word count where they are read. A prefix is known by its depth and two exclusive-ors of its turns' hashes
   with their places, running along the conversation: 128 bits, taken for equality. Rows of a node are added up before they
   are shuffled, so that a prefix that a third of all conversations share is one row afterwards.
2. Nodes are hash-partitioned by the digest of their first turn. A subtrie of more than `most` nodes is cut: the levels that together
   have no more than that stay as its top (its first node at least), and what lies deeper is dealt again by the digest of the next turn. This is
   repeated until no subtrie is too large, so a round goes down many turns where a subtrie is narrow.
3. Bottom up, a bucket of subtries at a time, pointers from each node to its children are set up inside applyInPandas, and one
   postorder, with a stack of its own, sums leaves and savings. What a cut left below is summed by parent in Spark.
4. Members that end at a node are listed in numeric order. Lists of more than `most` are written in sorted pieces, which one
   task a node puts into the digest one after the other, as SHA-256 allows nothing else; it never holds more than a piece.

Cases: null roles and texts count as empty. Null turns come first; turns alike in number are ordered by hashes. Rows without
conv_id belong to no conversation. Repeated rows are turns of their own. A conversation without turns (after rebuilding) is a
member of the root alone. Only conv_id, turn, role and text are read. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, materialize

#: Nodes of a subtrie, and members in a list, at most.
MOST = 50_000
WORDS = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "a", "b"]


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, x, y (hashes of role and text) and words of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit("second"), role, text).alias("y"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Turns of the conversations whose first h = crc32(conv_id) % heads turns are replaced with those of conversation conv_id - conv_id % every. Adds place (from 1); each conversation has a row of place 0 as well.

    All turns of one `every` are dealt together, so that numbering, joining and what follows by conversation take one shuffle.
    """
    x = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).repartition("base")
    x = x.withColumn("n", F.row_number().over(W.partitionBy("base", "conv_id").orderBy(F.asc_nulls_first("turn"), "x", "y")))
    first = x.where((F.col("conv_id") == F.col("base")) & (F.col("n") < heads)).groupBy("base").agg(F.sort_array(F.collect_list(F.struct("n", "x", "y", "words"))).alias("first"))
    x = x.join(first.hint("merge"), "base", "left").withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    head = F.filter(F.coalesce("first", F.array().cast("array<struct<n:int,x:bigint,y:bigint,words:bigint>>")), lambda t: t["n"] <= F.col("h"))
    at = lambda place, t: F.struct(place.cast("int").alias("place"), t["x"].alias("x"), t["y"].alias("y"), t["words"].alias("words"))
    none = F.array().cast("array<struct<place:int,x:bigint,y:bigint,words:bigint>>")
    start = F.when(F.col("n") == 1, F.concat(F.array(F.struct(F.lit(0).alias("place"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("words"))), F.transform(head, lambda t: at(t["n"], t)))).otherwise(none)
    own = F.when(F.col("n") > F.col("h"), F.array(at(F.size(head) + F.col("n") - F.col("h"), {c: F.col(c) for c in ("x", "y", "words")}))).otherwise(none)
    return x.select("base", "conv_id", F.explode(F.concat(start, own)).alias("t")).select("base", "conv_id", "t.*")


def as_they_are(turns: DataFrame) -> DataFrame:
    """Turns of the conversations themselves, with place, in the form of rebuilt()."""
    x = turns.withColumn("base", F.col("conv_id")).repartition("base")
    x = x.withColumn("place", F.row_number().over(W.partitionBy("base", "conv_id").orderBy(F.asc_nulls_first("turn"), "x", "y")))
    zero = F.lit(0).cast("long")
    both = F.array(F.struct("place", "x", "y", "words"), F.when(F.col("place") == 1, F.struct(F.lit(0).alias("place"), zero.alias("x"), zero.alias("y"), zero.alias("words"))))
    return x.select("base", "conv_id", F.explode(F.array_compact(both)).alias("t")).select("base", "conv_id", "t.*")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (the prefix), up_a, up_b (the prefix without its last turn), words of that turn, and whether the conversation ends here."""
    own = [F.when(F.col("place") > 0, F.xxhash64(F.lit(k), "place", c)).otherwise(0).cast("long") for k, c in enumerate(("x", "y"))]
    along = W.partitionBy("base", "conv_id").orderBy("place")
    x = rows.withColumns({"p": own[0], "q": own[1]})
    x = x.withColumns({"a": F.bit_xor("p").over(along.rowsBetween(W.unboundedPreceding, 0)), "b": F.bit_xor("q").over(along.rowsBetween(W.unboundedPreceding, 0)), "ends": F.lead("place").over(along).isNull()})
    return x.select("conv_id", F.col("place").cast("long").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("p")).alias("up_a"), F.col("b").bitwiseXOR(F.col("q")).alias("up_b"), "words", "ends")


def listed_ends(ends: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """depth, a, b and ends_sha256 for each node at which conversations end. ends: depth, a, b, conv_id."""
    many = scratch.keep(ends.groupBy(*NODE).agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n"), "long-lists")
    # Long lists: no more of them than ends / most.
    short = ends.join(F.broadcast(many), NODE, "left_anti").groupBy(*NODE).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ","), 256).alias("ends_sha256"))
    names = [*NODE, "first", "piece"]

    def pieces(batches):
        for x in batches:
            for key, own in x.groupby(NODE, sort=False):
                yield pd.DataFrame([(*key, int(own.conv_id.iloc[0]), ",".join(map(str, own.conv_id.tolist())))], columns=names)

    def digests(batches):
        at, state = None, None
        for x in batches:
            for r in x.itertuples(index=False):  # a row a piece
                key = (r.depth, r.a, r.b)
                if key != at:
                    if at is not None:
                        yield pd.DataFrame([(*at, state.hexdigest())], columns=[*NODE, "ends_sha256"])
                    at, state = key, hashlib.sha256(r.piece.encode())
                else:
                    state.update(b"," + r.piece.encode())
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    long = ends.join(F.broadcast(many), NODE).repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").select(*NODE, "conv_id")
    long = long.mapInPandas(pieces, "depth long, a long, b long, first long, piece string")
    long = long.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(digests, "depth long, a long, b long, ends_sha256 string")
    return short.unionByName(long)


def dealt(nodes: DataFrame, rows: DataFrame, scratch: Scratch, most: int) -> list[DataFrame]:
    """The nodes below the root in rounds: each with top_a and top_b, the prefix at which its subtrie begins, and top, that prefix's depth. Subtries have `most` nodes at most.

    nodes: depth, a, b, conv_id (a member); rows: conv_id, depth, a, b of all prefixes.
    """

    def below(x: DataFrame, depth: str) -> DataFrame:
        """x with the prefix that its member has at the given depth."""
        at = rows.select(F.col("conv_id").alias("of"), F.col("depth").alias("top"), F.col("a").alias("top_a"), F.col("b").alias("top_b"))
        return x.withColumn("top_at", F.expr(depth)).join(at, (F.col("conv_id") == F.col("of")) & (F.col("top_at") == F.col("top"))).drop("of", "top_at")

    out, open_ = [], scratch.keep(below(nodes.where("depth > 0"), "1L"), "subtries")
    top = ["top", "top_a", "top_b"]
    while True:
        large = scratch.keep(open_.groupBy(*top).agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n"), "large-subtries")
        if not large.limit(1).count():
            return [*out, open_]
        # A large subtrie has more than `most` nodes, so their table is small; and so is that of its levels.
        levels = open_.join(F.broadcast(large), top).groupBy(*top, "depth").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy(*top).orderBy("depth"))
        cut = levels.withColumn("upto", upto).groupBy(*top).agg(F.greatest(F.max(F.when(F.col("upto") <= most, F.col("depth"))), F.first("top")).alias("cut"))
        cut = scratch.keep(cut, "cuts")
        x = open_.join(F.broadcast(cut), top, "left")
        out.append(scratch.keep(x.where("cut is null or depth <= cut").drop("cut"), "subtries"))
        open_ = scratch.keep(below(x.where("depth > cut").drop(*top), "cut + 1").drop("cut"), "subtries")


def summed(nodes: pd.DataFrame) -> pd.DataFrame:
    """Nodes of whole subtries, or tops of them, with parent_conv_id where the parent is among them, n_children, n_leaves and saved_tokens.

    below_children, below_leaves and below_saved are the sums of what a cut left below a node.
    """
    nodes = nodes.sort_values("depth", kind="stable").reset_index(drop=True)
    at = {k: i for i, k in enumerate(zip(nodes.depth.tolist(), nodes.a.tolist(), nodes.b.tolist(), strict=True))}
    parent = [at.get(k, -1) for k in zip((nodes.depth - 1).tolist(), nodes.up_a.tolist(), nodes.up_b.tolist(), strict=True)]
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parent):
        if p >= 0:
            children.setdefault(p, []).append(i)
    n_children = [len(children.get(i, ())) + int(k) for i, k in enumerate(nodes.below_children.tolist())]
    leaves = [int(k) if n else 1 for k, n in zip(nodes.below_leaves.tolist(), n_children, strict=True)]
    saved = [int(x) for x in nodes.below_saved + (nodes.n_convs - 1) * nodes.words]
    stack = [(i, False) for i, p in enumerate(parent) if p < 0]
    while stack:
        i, done = stack.pop()
        if not done:
            stack.append((i, True))
            stack += [(k, False) for k in children.get(i, ())]
        elif parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    conv = nodes.conv_id.to_numpy()
    above = np.array(parent, np.int64)
    known = pd.array(np.where(above >= 0, conv[np.maximum(above, 0)], 0), "Int64")
    known[above < 0] = pd.NA
    return nodes[[*NODE, "up_a", "up_b", "conv_id", "n_convs"]].assign(parent_conv_id=known, n_children=n_children, n_leaves=leaves, saved_tokens=saved, is_top=above < 0)


SUMMED = "depth long, a long, b long, up_a long, up_b long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, is_top boolean"


def trie(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The nodes of the trie of all conversations; rows as from rebuilt() or as_they_are()."""
    with Scratch(rows.sparkSession) as scratch:
        prefix = scratch.keep(prefixes(rows), "prefixes")
        nodes = prefix.groupBy(*NODE).agg(*[F.any_value(c).alias(c) for c in ("up_a", "up_b", "words")], F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        nodes = scratch.keep(nodes, "trie-nodes")
        ends = scratch.keep(listed_ends(prefix.where("ends").select(*NODE, "conv_id"), scratch, most), "ends")
        done, below = [], None
        for x in reversed(dealt(nodes, prefix.select("conv_id", *NODE), scratch, most)):
            zero = F.lit(0).cast("long")
            if below is None:
                x = x.withColumns({"below_children": zero, "below_leaves": zero, "below_saved": zero})
            else:
                x = x.join(below, NODE, "left").fillna(0, ["below_children", "below_leaves", "below_saved"])
            buckets = max(1, -(-2 * x.count() // most))
            x = x.drop("top").withColumn("bucket", F.pmod(F.xxhash64("top_a", "top_b"), F.lit(buckets)))
            x = x.groupBy("bucket").applyInPandas(summed, SUMMED)
            done.append(scratch.keep(x, "summed"))
            up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
            # A round's subtries were cut from the round before, so their sums go there.
            found = done[-1].where("is_top and depth > 1").groupBy(*up).agg(F.count("*").alias("below_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"))
            below = scratch.keep(found, "below")
        every = done[0]
        for x in done[1:]:
            every = every.unionByName(x)
        # Parents beyond a cut: the root's id is one number, others are looked up.
        known = nodes.select(*NODE, F.col("conv_id").alias("above"))
        up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
        root = nodes.where("depth = 0")
        least = root.select("conv_id").collect()  # one row, or none
        if not least:
            return materialize(_result(every.withColumn("ends_sha256", F.lit(""))), "trie")
        tops = every.where("is_top")
        far = tops.where("depth > 1").select(*NODE, *[c.alias(f"up_{i}") for i, c in enumerate(up)])
        far = far.join(known.withColumnsRenamed({"depth": "up_0", "a": "up_1", "b": "up_2"}), ["up_0", "up_1", "up_2"]).select(*NODE, "above")
        every = every.join(far, NODE, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above", F.lit(least[0].conv_id)))
        totals = tops.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
        root = root.join(F.broadcast(totals)).withColumn("parent_conv_id", F.lit(None).cast("long"))  # one row and one row
        names = [*NODE, "conv_id", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"]
        out = every.select(*names).unionByName(root.select(*names)).join(ends, NODE, "left")
        return materialize(_result(out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))), "trie")


def _result(x: DataFrame) -> DataFrame:
    return x.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, rebuild: bool = False, most: int = MOST) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node. rebuild: of the rebuilt conversations."""
    turns = hashed_turns(conversations)
    return trie(rebuilt(turns) if rebuild else as_they_are(turns), most)
