"""Packing documents into sequences by cutting-stock column generation.

A document's tokens and one end token are cut into full sequences and a shorter rest, and a rest over half a sequence into
that half and what remains: items of at most a half leave little padding. These are the items of a cutting-stock
problem over length classes of `step` tokens: a linear program over patterns (how many items of each class fill one sequence)
starts from patterns of one class; its dual prices value the classes, a knapsack dynamic program finds the pattern worth most,
and that pattern enters the program until none is worth more than a sequence. Patterns are then used their rounded number of
times, and what that leaves is filled first-fit, largest first. The plan depends on the histogram alone, so its size
is bounded by the number of classes. Documents are ranked inside their class, and a rank range of a class belongs to
one pattern, so that every item finds its sequence in a join with the plan's ranges.

Tokens: word-like pieces of a text are found on code points for many texts at a time, each distinct piece is encoded once
in a chunk, and frequent ones once a worker. Texts in which a special token is spelled go through the tokenizer itself.

Cases: a null or empty text is the end token alone. A text of any length is cut into as many sequences as it needs. Repeated
rows are packed as often as they stand there; rows alike in all that ranks them are interchangeable. Only the id and the text
are read. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.common import materialize, mix, weights

LENGTH = 2048
#: Tokens by which lengths are classed for the plan.
STEP = 4
#: Pieces of text that a worker remembers with their ids.
CACHED = 300_000
#: Code points handled at a time.
CHUNK_CHARS = 1 << 21

SPACE, LETTER, NUMBER, OTHER = range(4)
# Endings that the pattern of byte-level tokenizers splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _kind(c: int) -> int:
    x = chr(c)
    if x.isspace() and not 0x1C <= c <= 0x1F:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(x)[0], OTHER)


_ASCII = np.array([_kind(c) for c in range(128)], np.uint8)


def kinds(codes: np.ndarray) -> np.ndarray:
    out = _ASCII[np.minimum(codes, 127)]
    rare = np.flatnonzero(codes > 127)
    if len(rare):
        own, at = np.unique(codes[rare], return_inverse=True)
        out[rare] = np.array([_kind(int(c)) for c in own], np.uint8)[at]
    return out


def cuts(codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces of the texts begin. codes: code points of texts that follow each other; texts: where each begins."""
    n = len(codes)
    kind = kinds(codes)
    begin = np.zeros(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[texts] = True
    ends = np.zeros(n + 1, bool)
    ends[texts], ends[n] = True, True
    # The last character of white space before other text is a piece of its own, or belongs to that text if it is a space.
    runs = np.flatnonzero(begin & (kind != SPACE))
    runs = runs[(runs > 0)]
    runs = runs[~ends[runs] & (kind[runs - 1] == SPACE)]
    begin[runs - 1] = True
    begin[runs[codes[runs - 1] == 32]] = False
    # Apostrophes that are a whole piece take an ending from the letters that follow.
    lone = np.flatnonzero((codes == 39) & begin)
    for p in lone[(lone + 1 < n)]:
        if begin[p + 1] and not ends[p + 1] and kind[p + 1] == LETTER:
            two = "".join(chr(c) for c in codes[p + 1 : min(p + 3, n)])
            if len(two) == 2 and ends[p + 2]:
                two = two[:1]
            took = next((len(e) for e in ENDINGS if two.startswith(e)), 0)
            if took:
                begin[p + 1] = False
                if p + 1 + took < n and not begin[p + 1 + took] and kind[p + 1 + took] == LETTER:
                    begin[p + 1 + took] = True
    return np.flatnonzero(begin)


_CODES = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Encoder:
    """Ids of texts by the byte-level BPE in a tokenizer file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        before = x["pre_tokenizer"] or {}
        plain = x["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.special = [a["content"] for a in x["added_tokens"]]
        self.pieces = None
        if plain and not x["model"].get("ignore_merges"):
            visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
            ranks = {bytes(letters[c] for c in t): i for t, i in x["model"]["vocab"].items() if t not in self.special}
            self.pieces = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = np.empty(0, np.uint64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts are handled about CHUNK_CHARS at a time."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= CHUNK_CHARS:
                size += len(texts[end])
                end += 1
            out += self._chunk(texts[at:end])
            at = end
        return out

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        plain = [bool(x) and self.pieces is not None and not any(s in x for s in self.special) for x in texts]
        own = [x for x, p in zip(texts, plain, strict=True) if p]
        found = iter(self._pieces(own) if own else [])
        return [next(found) if p else np.array(self.whole.encode(x, add_special_tokens=False).ids, np.uint32) for x, p in zip(texts, plain, strict=True)]

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.zeros(len(texts), np.int64)
        np.cumsum([len(x) for x in texts[:-1]], out=starts[1:])
        begin = cuts(codes, starts)
        lengths = np.diff(np.append(begin, len(codes)))
        place = np.arange(len(codes)) - np.repeat(begin, lengths)
        keys = mix(np.add.reduceat(_CODES[codes] * weights(place), begin))
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        hit = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~hit)
        a, b = begin[first[new]].tolist(), (begin + lengths)[first[new]].tolist()
        got = [self.pieces(joined[i:j]) for i, j in zip(a, b, strict=True)]
        sizes = np.zeros(len(distinct), np.int64)
        sizes[hit] = np.diff(self.first)[place[hit]]
        sizes[new] = [len(x) for x in got]
        new_ids = np.fromiter((i for x in got for i in x), np.uint32)
        # A table of ids: those remembered, then the new ones.
        table = np.concatenate([self.ids, new_ids])
        at = np.zeros(len(distinct), np.int64)
        at[hit] = self.first[place[hit]]
        at[new] = len(self.ids) + np.cumsum(sizes[new]) - sizes[new]
        many = sizes[inverse]
        ends = np.cumsum(many)
        ids = table[np.repeat(at[inverse] - (ends - many), many) + np.arange(ends[-1])]
        bounds = np.append(np.searchsorted(begin, starts), len(begin))
        cut = np.concatenate([[0], ends])[bounds]
        if len(self.known) < CACHED and len(new):
            self._remember(distinct[new], got)
        return [ids[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def _remember(self, keys: np.ndarray, got: list[list[int]]) -> None:
        keys, got = keys[: CACHED - len(self.known)], got[: CACHED - len(self.known)]
        every = np.concatenate([self.known, keys])
        sizes = np.concatenate([np.diff(self.first), [len(x) for x in got]]).astype(np.int64)
        table = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.uint32)])
        at = np.cumsum(sizes) - sizes
        order = np.argsort(every)
        sizes = sizes[order]
        ends = np.cumsum(sizes)
        self.ids = table[np.repeat(at[order] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.known, self.first = every[order], np.append(0, ends)


def cut_points(n: int, length: int) -> list[tuple[int, int]]:
    """Full sequences, then half of one if more than that remains, then the rest."""
    at = list(range(0, n, length))
    if n - at[-1] < length and n - at[-1] > length // 2:
        at.append(at[-1] + length // 2)
    return list(zip(at, [*at[1:], n], strict=True))


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most length tokens: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for."""
    fields = [("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens")], *[("ids", pa.list_(pa.uint32()))] * with_ids]
    schema = pa.schema([(k, pa.list_(pa.int64()) if k == "ids" else t) for k, t in fields])

    def run(batches):
        encoder = Encoder(tokenizer)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for s, e in cut_points(len(ids), length):
                    x = ids[s:e]
                    rows.append((doc, s, len(x), zlib.crc32(x.tobytes()), len(ids), *[x.astype(np.int64)] * with_ids))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern worth most in a room, by dynamic programming over its size. sizes ascend."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        k = fits[c]
        if k:
            x = best[c - sizes[:k]] + values[:k]
            i = int(x.argmax())
            if x[i] > best[c] + 1e-12:
                best[c], took[c] = x[i], i
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 2e-4, most: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often each is used in the linear program, within gap of its optimum."""
    m = len(sizes)
    fill = room // sizes
    basis = np.diag(fill).astype(np.int64)
    inverse = np.diag(1.0 / fill)
    use = demand / fill
    for _ in range(most):
        worth, pattern = price(inverse.sum(axis=0), sizes, room)
        if worth <= 1 + gap:
            break
        u = inverse @ pattern
        ratio = np.where(u > 1e-9, use / np.where(u > 1e-9, u, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        use -= step * u
        use[r] = step
        np.maximum(use, 0, out=use)
        inverse[r] /= u[r]
        rest = u.copy()
        rest[r] = 0
        changed = np.flatnonzero(np.abs(rest) > 1e-12)
        inverse[changed] -= np.outer(rest[changed], inverse[r])
        basis[:, r] = pattern
    return basis.T, use[:m]


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (items of each class) and how many sequences use each; all items of the histogram, by class size, are placed."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes])
    patterns, use = column_generation(sizes, demand.astype(float), room)
    left, out = demand.copy(), []
    for k in np.argsort(-use):
        own = patterns[k] > 0
        times = min(int(np.floor(use[k] + 1e-6)), int((left[own] // patterns[k][own]).min())) if own.any() else 0
        if times > 0:
            left -= times * patterns[k]
            out.append(({int(s): int(n) for s, n in zip(sizes[own], patterns[k][own], strict=True)}, times))
    while left.any():
        space, pattern = room, {}
        for i in np.flatnonzero(left)[::-1]:
            n = min(int(left[i]), space // int(sizes[i]))
            if n:
                pattern[int(sizes[i])] = n
                space -= n * int(sizes[i])
        own = np.array([pattern.get(int(s), 0) for s in sizes])
        times = int((left[own > 0] // own[own > 0]).min())
        left -= times * own
        out.append((pattern, times))
    return out


def pack(pieces: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """Adds sequence_id and offset to pieces; offsets leave no gap from 0."""
    spark = pieces.sparkSession
    salts = 64
    x = pieces.withColumns({"class": F.ceil(F.col("length") / step).cast("long"), "salt": F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts))})
    counts = materialize(x.groupBy("class", "salt").agg(F.count("*").alias("n")), "class-counts")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # a row a class
    ranges, base, seen = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in plan(histogram, length // step):
        for c, n in pattern.items():
            ranges.append((c, seen[c], seen[c] + n * times, n, base))
            seen[c] += n * times
        base += times
    table = spark.createDataFrame(ranges, "class long, low long, high long, each long, base long")
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("class").orderBy("salt")) - F.col("n")).select("class", "salt", "before")
    order = ["doc_id", "start", "ids_crc32"]
    ranked = x.withColumn("own", F.row_number().over(W.partitionBy("class", "salt").orderBy(*order)) - 1)
    # Both tables are bounded by the number of classes (512), salts and patterns.
    ranked = ranked.join(F.broadcast(before), ["class", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    placed = ranked.alias("x").join(F.broadcast(table).alias("r"), (F.col("x.class") == F.col("r.class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.select("x.*", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long").alias("sequence_id"))
    own = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    return placed.withColumn("offset", F.sum("length").over(own) - F.col("length")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset there."""
    return pack(materialize(token_pieces(docs, tokenizer, end_id, length, id_col, text_col), "pieces"), length, step)
