"""N-gram Jaccard join with a token-group matrix: components of documents whose word n-gram sets overlap enough.

Documents of one n-gram set are one node. Two sets of a link differ in at most d tokens, a bound that follows from their sizes,
so if the range of token hashes is cut into more than d parts, at most d of them differ. Each node has a key for each part (and
for the parts of the next smaller size band where a link reaches there), and must share as many of them as it has above d.
Nodes that share fewer, with whatever other nodes, link with nothing.

1. Leaders: each node is compared with one leader of its keys' posting lists, the one it shares most keys with. Links give
   components, so that lists which hold one component need nothing more. Nodes of one leader are a cluster.
2. Token-group matrix: nodes in lists that hold several components are partitioned, by cluster and size, into groups of about
   GROUP nodes and GROUP_TOKENS tokens. A group's row has the bits of its token union. Two groups meet if they share a key.
   For each node of the one, the tokens whose bits the other's row lacks bound its overlap with every member there.
3. Only pairs of groups in which nodes of both sides qualify are opened: the exact union bounds them once more, and the nodes
   left are compared by whole sets, as a product of two matrices over the tokens that both groups hold. Of the links found, those
   that join components are kept.

All pairs of nodes that share a key are compared or bounded, unless they are in one component already, so the components are
those of all links. Hashes of tokens and of sets have 64 bits; equal hashes are taken for equality.

Cases: a null, empty or blank text has no set, links with nothing and is its own component. Repeated rows and copies share a
node; each row is returned. Texts are read whole. A null id never stands for others: a component without any other id is
null. Only the id and the text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, Words, as_signed, batch, chunked, materialize, mix, text_bytes, unused

#: Ratio between the bounds of size bands.
BAND = 1.5
#: Rows of two numbers up to which a table is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bits of a node's row: four a token, between these bounds.
OWN_BITS = (1024, 1 << 16)
#: Nodes and tokens of a group of the matrix, about.
GROUP, GROUP_TOKENS = 48, 1 << 15


def sets_of(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, one text after the other, and how many each text has."""
    keys, many = Words(texts, lower=True).shingles(n)
    owner = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.bincount(owner[new], minlength=len(many))


def band_of(size: int) -> int:
    b = int(math.log(size) / math.log(BAND))
    while math.ceil(BAND ** (b + 1)) <= size:
        b += 1
    while math.ceil(BAND**b) > size:
        b -= 1
    return b


def parts_of(band: int, percent: int) -> tuple[int, int, int]:
    """Tokens by which a set of this band and one that links with it differ at most, parts into which such sets are cut, and the largest size that can link."""
    largest = math.ceil(BAND ** (band + 1)) - 1
    reach = 100 * largest // percent
    apart = (100 - percent) * (largest + reach) // (100 + percent)
    return apart, apart + 3 + apart // 5, reach


def keys_of(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The node's keys, hashes of band, part and the tokens in the part, and how many of them it shares at least with a node that links.

    Of the filled parts of the set that fills more, at most `apart` differ in the other one. Empty parts have keys only where no more than
    `apart` are filled; such a set shares those with another of its kind, and one filled part at least with any other.
    """
    if not len(tokens):
        return np.empty(0, np.uint64), 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens))])
    own, out, least = band_of(len(tokens)), [], []
    for band in (own, own - 1):
        if band < 0:
            continue
        apart, parts, reach = parts_of(band, percent)
        if len(tokens) > reach:
            continue
        edges = np.concatenate([[0], np.searchsorted(tokens, (np.arange(1, parts) * (2.0**64 / parts)).astype(np.uint64)), [len(tokens)]])
        keys = mix(sums[edges[1:]] - sums[edges[:-1]] + mix(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 32)))
        filled = edges[1:] > edges[:-1]
        many = int(filled.sum())
        out.append(keys[filled] if many > apart else keys)
        least.append(max(many - apart, 1))
    return np.concatenate(out), min(least)


def nodes_of(tokens: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A hash of each set; the sets follow each other and hold many tokens each, none of them 0 tokens."""
    start = np.cumsum(many) - many
    both = mix(np.bitwise_xor.reduceat(mix(tokens + np.uint64(0x5851F42D4C957F2D)), start)) + mix(np.add.reduceat(tokens, start))
    return as_signed(mix(both + many.astype(np.uint64)))


def node_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set), keys, and least (keys that it shares with any that links) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("least", pa.int64())])

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column(1))
            for i, j in chunked(texts):
                tokens, many = sets_of(texts[i:j], n)
                node = np.zeros(len(many), np.int64)
                node[many > 0] = nodes_of(tokens, many[many > 0]) if len(tokens) else 0
                keys = [keys_of(tokens[e - m : e], percent) for e, m in zip(np.cumsum(many), many, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(k) for k, _ in keys)]).astype(np.int32)), pa.array(as_signed(np.concatenate([k for k, _ in keys]))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(many), pa.array(node, mask=many == 0), lists, pa.array([x for _, x in keys], pa.int64())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, keys array<long>, least long")


def own_bits(tokens: np.ndarray) -> np.ndarray:
    """A row of bits in which the hashes of the tokens are set."""
    bits = min(max(1 << (4 * len(tokens) - 1).bit_length(), OWN_BITS[0]), OWN_BITS[1])
    row = np.zeros(bits, np.uint8)
    row[(mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(row, bitorder="little").view(np.int64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(x.reshape(-1, words))


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two rows differ, the longer one folded to the other's length; each stands for a token that only one has."""
    few = min(len(x), len(y))
    return int(np.bitwise_count((folded(x, few) ^ folded(y, few)).view(np.uint64)).sum())


def token_sets(docs: DataFrame, n: int) -> DataFrame:
    """node, size, bits and sorted tokens for each row of docs (text, expected node) that has the expected node."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("bits", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            texts, wanted = text_bytes(b.column(0)), b.column(1).to_pylist()
            for i, j in chunked(texts):
                tokens, many = sets_of(texts[i:j], n)
                if len(tokens):
                    ends = np.cumsum(many)[many > 0]
                    found = zip([w for w, m in zip(wanted[i:j], many, strict=True) if m], nodes_of(tokens, many[many > 0]).tolist(), ends - many[many > 0], ends, strict=True)
                    own = [(w, tokens[a:e]) for w, got, a, e in found if w == got]
                    yield batch(schema, [w for w, _ in own], [len(x) for _, x in own], [own_bits(x) for _, x in own], [as_signed(x) for _, x in own])

    return docs.mapInArrow(run, "node long, size long, bits array<long>, tokens array<long>")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table with a hint to broadcast it if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def linked(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes that link: by their sizes and bits first, then by their whole sets. Where one of a pair has many partners, it should be b."""

    def rough(batches):
        for t in batches:
            left, right = t.column(3), t.column(5)
            apart = np.array([bits_apart(left[i].values.to_numpy(), right[i].values.to_numpy()) for i in range(t.num_rows)], np.int64)
            sizes = t.column(2).to_numpy() + t.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(apart <= (100 - percent) * sizes // (100 + percent)))

    def exact(batches):
        for t in batches:
            left, right = t.column(2), t.column(3)
            keep = []
            for i in range(t.num_rows):
                x, y = left[i].values.to_numpy(zero_copy_only=False), right[i].values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def both_sides(pairs: DataFrame, *columns: str) -> DataFrame:
        pairs = small(pairs)
        left = sets.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns]).join(pairs, "a")
        right = sets.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns]).join(pairs.select("b"), "b", "left_semi")
        return left.hint("merge").join(right, "b")

    x = both_sides(pairs, "size", "bits").where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    near = scratch.keep(x.select("a", "b", "size_a", "bits_a", "size_b", "bits_b").mapInArrow(rough, "a long, b long"), "near-pairs")
    return both_sides(near, "tokens").select("a", "b", "tokens_a", "tokens_b").mapInArrow(exact, "a long, b long")


def _members(x: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Nodes, components, sizes and lists of numbers of a group."""
    m = x.values
    return (*(m.field(i).to_numpy() for i in range(3)), m.field(3))


def qualify(percent: int):
    """Keeps pairs of groups in which, by the bits of the token unions, each side has a node that the other leaves room for a link."""

    def room(size: np.ndarray, bits: list[np.ndarray], row: np.ndarray) -> bool:
        for n, x in zip(size, bits, strict=True):
            few = min(len(x), len(row))
            missing = int(np.bitwise_count((folded(x, few) & ~folded(row, few)).view(np.uint64)).sum())
            if 100 * (n - missing) >= percent * n:
                return True
        return False

    def run(batches):
        for t in batches:
            keep = []
            for i in range(t.num_rows):
                (_, _, s, x), (_, _, r, y) = _members(t.column(2)[i]), _members(t.column(3)[i])
                x, y = ([v.values.to_numpy() for v in z] for z in (x, y))
                few = min(map(len, [*x, *y]))
                union = lambda z: np.bitwise_or.reduce([folded(v, few) for v in z])  # noqa: B023, E731
                keep.append(room(s, x, union(y)) and room(r, y, union(x)))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["p", "q"]).filter(pa.array(keep, pa.bool_()))

    return run


def links_between(left: tuple, right: tuple, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links between nodes of two groups join, no more than it takes to join them. A group: nodes, components, sizes, lists of sorted tokens."""
    sides = []
    for (node, of, size, tokens), (_, _, _, other) in ((left, right), (right, left)):
        flat, union = tokens.flatten().to_numpy().view(np.uint64), np.unique(other.flatten().to_numpy().view(np.uint64))
        at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
        shared = np.add.reduceat((union[at] == flat).astype(np.int64), np.cumsum(size) - size)
        sides.append((node, of, size, flat, np.repeat(np.arange(len(size)), size), 100 * shared >= percent * size))
    common = np.intersect1d(sides[0][3], sides[1][3])
    if not len(common):
        return []
    grids = []
    for node, of, size, flat, owner, open_ in sides:
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = (common[at] == flat) & open_[owner]
        grid = np.zeros((len(size), len(common)), np.float32)
        grid[owner[hit], at[hit]] = 1
        grids.append(grid[open_])
    (of_a, n_a), (of_b, n_b) = ((of[o], size[o]) for _, of, size, _, _, o in sides)
    both = (grids[0] @ grids[1].T).astype(np.int64)
    hits = np.argwhere((100 * both >= percent * (n_a[:, None] + n_b[None] - both)) & (of_a[:, None] != of_b[None]))
    out, root = [], {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i, j in hits:
        x, y = find(int(of_a[i])), find(int(of_b[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(of_a[i]), int(of_b[j])))
    return out


def open_groups(percent: int):
    def run(batches):
        for t in batches:
            found = [x for i in range(t.num_rows) for x in links_between(_members(t.column(2)[i]), _members(t.column(3)[i]), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and group (the smallest node that links reach) for each node; hubs and leaves are relabelled until nothing changes."""
    both = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    groups = scratch.keep(both.select(F.col("a").alias("node")).distinct().withColumn("group", F.col("node")), "groups")
    # All tables of a round have a row a linked node at most, so they are broadcast together or shuffled together.
    few = F.broadcast if groups.count() <= BROADCAST_ROWS else lambda df: df
    while True:
        around = both.join(few(groups.select(F.col("node").alias("b"), "group")), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("least"))
        step = around.join(few(groups), "node").select("node", F.col("group").alias("was"), F.least("group", "least").alias("group"))
        step = scratch.keep(step, "step")
        # A group's own label may have moved on: tell the group's namesake what was found, and follow it.
        found = step.groupBy(F.col("was").alias("node")).agg(F.min("group").alias("found"))
        told = scratch.keep(step.join(few(found), "node", "left").select("node", "was", F.least("group", F.coalesce("found", "group")).alias("group")), "told")
        jump = told.join(few(told.select(F.col("node").alias("group"), F.col("group").alias("over"))), "group").select("node", "was", F.least("group", "over").alias("group"))
        jump = scratch.keep(jump, "jump")
        groups = jump.select("node", "group")
        if not jump.where("group <> was").limit(1).count():
            break
    return nodes.join(few(groups), "node", "left").select("node", F.coalesce("group", "node").alias("group"))


def joined(docs: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, node, component_id, n_copies and stands (whether the node is the one that stands for its component) of each row of docs (doc_id, text)."""
    keyed = scratch.keep(node_table(docs, n, percent), "keyed-nodes")
    rows = scratch.keep(keyed.drop("keys"), "nodes")
    nodes = scratch.keep(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.min("least").alias("least")), "distinct-nodes")
    # A node's keys from the row of its smallest id; rows of other ids are copies.
    least = nodes.where("n_copies > 1").select("node", F.col("doc_id").alias("at"))
    copies = rows.select("node", "doc_id").join(least, "node").where(~F.col("doc_id").eqNullSafe(F.col("at"))).select(F.col("node").alias("n"), F.col("doc_id").alias("d")).distinct()
    copies = small(scratch.keep(copies, "copies"))
    first = keyed.where("node is not null").join(copies, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_anti")
    # Both the lists' ends and the lists come from one shuffle.
    posted = first.select("node", F.explode("keys").alias("key")).repartition("key")
    shared = posted.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    met = scratch.keep(posted.join(shared, "key").select("key", "node").distinct(), "met-keys", free=True)
    scratch.drop("keyed-nodes", "copies")
    near = met.groupBy("node").agg(F.count("*").alias("met")).join(nodes.select("node", "least"), "node").where("met >= least").select("node")
    near = scratch.keep(near, "near-nodes")
    lists = met.join(small(near), "node", "left_semi")
    lists = lists.join(lists.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("high")).where("lead < high").drop("high"), "key")
    lists = scratch.keep(lists, "posting-lists", free=True)
    scratch.drop("met-keys")
    wanted = small(scratch.keep(nodes.join(near, "node", "left_semi").select(F.col("doc_id").alias("at"), "node"), "wanted"))
    sets = scratch.keep(token_sets(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("at"))).select("text", "node"), n), "token-sets")
    if sets.count() > near.count():  # repeated rows of one id
        sets = scratch.keep(sets.dropDuplicates(["node"]), "distinct-token-sets")

    # Leaders.
    pairs = lists.where("node <> lead").groupBy(F.col("node").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("m"))
    led = scratch.keep(pairs.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b")), "led")
    links = scratch.keep(linked(led, sets, percent, scratch), "links", free=True)
    groups = scratch.keep(components(near, links, scratch), "groups")

    # Token-group matrix, over nodes of lists with several components.
    labelled = lists.select("key", "node").join(small(groups), "node")
    mixed = labelled.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
    labelled = scratch.keep(labelled.join(small(scratch.keep(mixed, "mixed-lists")), "key", "left_semi"), "open-lists")
    apart = labelled.select("node", "group").distinct().join(small(led).withColumnsRenamed({"a": "node", "b": "lead"}), "node", "left")
    apart = sets.select("node", "size").join(small(scratch.keep(apart, "apart")), "node").select("node", "group", "size", F.coalesce("lead", "node").alias("lead"), F.floor(F.log2("size") * 2).alias("band"))
    apart = scratch.keep(apart, "apart")
    parts = apart.groupBy("lead", "band").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("size") / GROUP_TOKENS)).alias("parts"))
    member = apart.join(parts, ["lead", "band"]).select("node", "group", F.xxhash64("lead", "band", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    member = small(scratch.keep(member, "members"))
    held = labelled.drop("group").join(member, "node").groupBy("key", "block").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    held = scratch.keep(held, "lists-of-groups")
    other = held.select(F.col("key").alias("k"), F.col("block").alias("q"), F.col("low").alias("l"), F.col("high").alias("h"))
    meet = held.join(other, (F.col("key") == F.col("k")) & (F.col("block") <= F.col("q")) & (F.least("low", "l") < F.greatest("high", "h"))).select(F.col("block").alias("p"), "q").distinct()
    meet = scratch.keep(meet, "met-groups")

    def groups_of(column: str, pairs: DataFrame) -> DataFrame:
        """block and its members, with a column of sets, for the groups of pairs."""
        asked = small(scratch.keep(pairs.select("p").union(pairs.select("q")).distinct().withColumnRenamed("p", "block"), "asked"))
        own = sets.select("node", "size", column).join(small(scratch.keep(member.join(asked, "block", "left_semi"), "asked-members")), "node")
        return scratch.keep(own.groupBy("block").agg(F.collect_list(F.struct("node", "group", "size", column)).alias("members")), "token-groups")

    def paired(pairs: DataFrame, held: DataFrame) -> DataFrame:
        left = held.select(F.col("block").alias("p"), F.col("members").alias("x")).join(small(pairs), "p")
        return left.hint("merge").join(held.select(F.col("block").alias("q"), F.col("members").alias("y")), "q").select("p", "q", "x", "y")

    opened = scratch.keep(paired(meet, groups_of("bits", meet)).mapInArrow(qualify(percent), "p long, q long"), "opened-groups")
    more = scratch.keep(paired(opened, groups_of("tokens", opened)).mapInArrow(open_groups(percent), "a long, b long").distinct(), "links", free=True)
    over = scratch.keep(components(more.select(F.col("a").alias("node")).union(more.select("b")).distinct(), more, scratch), "over")
    groups = groups.join(small(over.select(F.col("node").alias("group"), F.col("group").alias("over"))), "group", "left").select("node", F.coalesce("over", "group").alias("group"))
    groups = scratch.keep(groups, "groups")
    scratch.drop("token-groups", "token-sets", "distinct-token-sets", "open-lists", "posting-lists", "lists-of-groups")

    named = nodes.drop("least").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node"))).alias("least"))
    # Only nodes of several rows or several members need a look-up; a hot node's rows are dealt by document.
    known = named.join(least, "group").select("node", "doc_id", F.col("least.id").alias("component_id"), "n_copies", (F.col("node") == F.col("least.node")).alias("stands"))
    known = known.where("n_copies > 1 or not stands").drop("doc_id")
    salts = 16
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).join(known, ["node", "salt"], "left")
    found = F.col("n_copies").isNotNull()
    return out.select("doc_id", "n_shingles", "node", F.when(found, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(found, F.col("n_copies")).when(F.col("n_shingles") > 0, 1).otherwise(0).cast("long").alias("n_copies"), F.when(found, F.col("stands")).otherwise(True).alias("stands"))


def jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) and n_copies (rows of the same set), one row a row of docs."""
    with Scratch(docs.sparkSession) as scratch:
        x = joined(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), n, percent, scratch)
        return materialize(x.select("doc_id", "n_shingles", "component_id", "n_copies"), "components")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: those of the smallest id, null last. Of rows alike in id and set one stays; of rows without a set, one of each id and text."""
    own, rows, node, many = unused(docs, "id", "rows", "node", "many")
    with Scratch(docs.sparkSession) as scratch:
        x = scratch.keep(joined(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), n, percent, scratch), "components")
        stay = x.where(F.col("stands") & (F.col("node").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))))
        stay = stay.groupBy("doc_id").agg(F.collect_set("node").alias(node))
        stay = stay.join(x.groupBy("doc_id").agg(F.count("*").alias(rows)).withColumnRenamed("doc_id", own), F.col("doc_id").eqNullSafe(F.col(own))).select(own, rows, node)
        stay = materialize(stay, "representatives")
    few = small(stay)
    kept = docs.join(few, docs[id_col].cast("long").eqNullSafe(F.col(own)))
    once = kept.where(F.col(rows) == 1).select(*docs.columns)
    if not stay.where(F.col(rows) > 1).limit(1).count():
        return once
    # Rows that share an id: their sets tell which of them stay.
    text = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts, found = text_bytes(b.column(text)), []
            for i, j in chunked(texts):
                tokens, sizes = sets_of(texts[i:j], n)
                x = np.zeros(len(sizes), np.int64)
                x[sizes > 0] = nodes_of(tokens, sizes[sizes > 0]) if len(tokens) else 0
                found.append(pa.array(x, mask=sizes == 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.chunked_array(found, pa.int64()).combine_chunks()], names=[*b.schema.names, many])

    several = kept.where(F.col(rows) > 1).drop(own, rows)
    several = several.mapInArrow(run, several.withColumn(many, F.lit(None).cast("long")).schema)
    sets = several.where(F.array_contains(node, F.col(many))).dropDuplicates([id_col, many])
    blank = several.where(F.col(many).isNull()).dropDuplicates([id_col, text_col])
    return once.unionByName(sets.select(*docs.columns)).unionByName(blank.select(*docs.columns))
