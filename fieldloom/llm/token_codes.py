"""Token ids in files of directly addressable codes: any id can be read without decoding its neighbours.

An id is split into chunks of bits, the lowest first. Level 0 holds the first chunk of every id and a bitmap that says which ids
go on; level 1 holds the next chunks of those alone, and so on. How many earlier ids go on, which a directory of counts
per 512 bits and a few popcounts tell, is where an id's next chunk stands. The widths of the levels are those that
need the fewest bits for the segment's own histogram of bit lengths.

A file is a sequence of segments, each of whole documents and about SEGMENT_IDS ids, with one separator byte after it:

    magic, bytes of the segment, part, ids of the part before the segment, documents, ids, levels      (7 x 8 bytes)
    document ids (8 bytes each), flags of null ids (1 byte each, padded), ends of documents (8 bytes each)
    for each level: width, values; bitmap and directory (unless it is the last); chunks               (all padded to 8 bytes)

Documents are dealt to tasks by ranges of their ids, so parts, files and segments follow ascending document ids. Spark's own writer
commits the files (its text source writes a value's bytes as they are), so a lost or repeated task leaves no broken
or double file, and any store that Spark reaches will do.

Ids: a text is encoded word by word, each distinct word once, because the tokenizers that this is for drop white space and never
join what it separates; `whole=True` encodes whole texts, for any other tokenizer.

Cases: a null or empty text is the end id alone. A document of any length is one segment at most, alone if it is long. Rows that
share an id follow each other by a hash of the text; equal rows are interchangeable. Null ids come first.
Only the id and the text are read. An empty table gives no documents.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, Words, chunked, materialize, text_bytes

MAGIC = int.from_bytes(b"idcodes1", "little")
#: Ids of a segment, about; a file has FILE_SEGMENTS of them at most.
SEGMENT_IDS, FILE_SEGMENTS = 1 << 18, 64
#: Bits of the bitmap for each count of the directory.
BLOCK = 512
#: Distinct words whose ids a worker remembers.
CACHED = 1_000_000
HEAD = struct.Struct("<QQqQQQQ")


class WordEncoder:
    """Ids of texts by a tokenizer of the tokenizers library that drops white space; distinct words are encoded once."""

    def __init__(self, path: str, whole: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        if self.whole:
            return self._encoded(texts)
        words = Words(texts, lower=False)
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHED:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            bytes_ = words.buffer.tobytes()
            ids, size = self._encoded([bytes_[words.starts[k] : words.ends[k]] for k in first[new]])
            self.first = np.insert(self.first, at[new], len(self.ids) + np.cumsum(size) - size)
            self.size = np.insert(self.size, at[new], size)
            self.known = np.insert(self.known, at[new], distinct[new])
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.known, distinct)
        size = self.size[at][inverse]
        end = np.cumsum(size)
        out = self.ids[np.repeat(self.first[at][inverse] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        upto = np.concatenate([[0], end])[np.cumsum([0, *words.counts])]
        return out, np.diff(upto)


@functools.cache
def encoder_of(path: str, whole: bool = False) -> WordEncoder:
    """The encoder of this worker, which later tasks go on with."""
    return WordEncoder(path, whole)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    return np.frexp(ids.astype(np.float64))[1].astype(np.int64)


def best_widths(ids: np.ndarray) -> list[int]:
    """Widths of levels that need the fewest bits; those of the earlier levels count one more, for the bitmap."""
    counts = np.bincount(np.maximum(bit_lengths(ids), 1), minlength=2)
    top = len(counts) - 1
    more = np.append(np.cumsum(counts[::-1])[::-1][1:], 0)  # ids longer than k bits
    more[0] = len(ids)
    cost, then = [0] * (top + 1), [top] * (top + 1)
    for k in range(top - 1, -1, -1):
        cost[k], then[k] = min((int(more[k]) * (e - k + (e < top)) + cost[e], e) for e in range(k + 1, top + 1))
    out, k = [], 0
    while k < top:
        out.append(then[k] - k)
        k = then[k]
    return out


def _padded(x: np.ndarray) -> bytes:
    b = x.tobytes()
    return b + b"\0" * (-len(b) % 8)


def packed(values: np.ndarray, width: int) -> bytes:
    bits = (values[:, None] >> np.arange(width, dtype=values.dtype)) & values.dtype.type(1)
    return _padded(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")) + bytes(8)  # a spare word, so that two can always be read


def segment(part: int, before: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a segment of some documents; ids are those of all, one document after the other."""
    widths = best_widths(ids)
    body = [_padded(np.array([x or 0 for x in doc_ids], np.int64)), _padded(np.array([x is None for x in doc_ids], np.uint8)), _padded(np.cumsum(counts))]
    rest = ids.astype(np.uint64)
    for k, width in enumerate(widths):
        body.append(struct.pack("<QQ", width, len(rest)))
        more = rest >> np.uint64(width)
        if k < len(widths) - 1:
            on = more > 0
            words = np.frombuffer(_padded(np.packbits(on, bitorder="little")), np.uint64)
            each = np.bitwise_count(words).astype(np.int64)
            blocks = np.add.reduceat(each, np.arange(0, len(each), BLOCK // 64)) if len(each) else each
            body += [words.tobytes(), _padded((np.cumsum(blocks) - blocks).astype(np.uint32))]
        body.append(packed(rest & np.uint64((1 << width) - 1), width))
        if k < len(widths) - 1:
            rest = more[on]
    size = HEAD.size + sum(map(len, body))
    return HEAD.pack(MAGIC, size, part, before, len(doc_ids), len(ids), len(widths)) + b"".join(body)


class Segment:
    """A segment at some place of a buffer: its documents, all its ids, and any id by itself."""

    def __init__(self, buffer: bytes, at: int = 0) -> None:
        magic, self.size, self.part, self.before, docs, self.n_ids, levels = HEAD.unpack_from(buffer, at)
        if magic != MAGIC or at + self.size > len(buffer):
            raise ValueError(f"no whole segment of token ids at byte {at}")
        self.at, at = at, at + HEAD.size

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(buffer, kind, n, at)
            at += -(-x.nbytes // 8) * 8
            return x

        self.doc_ids, self.null, self.ends = take(np.int64, docs), take(np.uint8, docs).astype(bool), take(np.int64, docs)
        self.levels = []
        for k in range(levels):
            width, n = (int(x) for x in take(np.uint64, 2))
            last = k == levels - 1
            words = None if last else take(np.uint64, -(-n // 64))
            counts = None if last else take(np.uint32, -(-n // BLOCK))
            self.levels.append((width, n, words, counts, take(np.uint64, -(-width * n // 64) + 1)))

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one chunk of each level that it reaches."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for width, _, words, counts, chunks in self.levels:
            word, bit = divmod(i * width, 64)
            value |= (((int(chunks[word + 1]) << 64 | int(chunks[word])) >> bit) & ((1 << width) - 1)) << shift
            shift += width
            if words is None:
                break
            word, bit = divmod(i, 64)
            if not int(words[word]) >> bit & 1:
                break
            block = i // BLOCK
            i = int(counts[block]) + int(np.bitwise_count(words[block * BLOCK // 64 : word]).sum()) + (int(words[word]) & ((1 << bit) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        out = np.zeros(self.n_ids, np.uint32)
        at, shift = np.arange(self.n_ids), 0
        for width, n, words, _, chunks in self.levels:
            bits = np.unpackbits(chunks.view(np.uint8), count=n * width, bitorder="little").reshape(n, width)
            values = np.zeros(n, np.uint32)
            for k in range(width):
                values |= bits[:, k].astype(np.uint32) << np.uint32(k)
            out[at] |= values << np.uint32(shift)
            shift += width
            if words is not None:
                at = at[np.unpackbits(words.view(np.uint8), count=n, bitorder="little").astype(bool)]
        return out


def segments(buffer: bytes) -> Iterator[Segment]:
    """All segments of a file."""
    at = 0
    while at < len(buffer):
        x = Segment(buffer, at)
        yield x
        at += x.size + 1


def write_codes(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents, each followed by end_id, to files below path."""

    def run(batches):
        encoder = encoder_of(tokenizer, whole)
        part, before = TaskContext.get().partitionId(), 0
        doc_ids, counts, held, many = [], [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(part, before, doc_ids, counts, np.concatenate(held))], pa.binary())], names=["value"])

        for b in batches:
            texts, own = text_bytes(b.column(1)), b.column(0).to_pylist()
            for i, j in chunked(texts):
                ids, size = encoder.encode(texts[i:j])
                for doc, x in zip(own[i:j], np.split(ids, np.cumsum(size)[:-1]), strict=True):
                    doc_ids.append(doc)
                    counts.append(len(x) + 1)
                    held += [x, np.array([end_id], np.uint32)]
                    many += len(x) + 1
                    if many >= SEGMENT_IDS:
                        yield closed()
                        before += many
                        doc_ids, counts, held, many = [], [], [], 0
        if doc_ids:
            yield closed()

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    x = x.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    coded = x.select("doc_id", "text").mapInArrow(run, "value binary")
    coded.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, start (ids of the part before it), n_tokens, ids_crc32 and ids (array) of each document in the files."""
    names = ["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def run(batches):
        for b in batches:
            for content in b.column(1):
                for s in segments(content.as_py()):
                    ids, start = s.ids(), np.append(0, s.ends[:-1])
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(start, s.ends, strict=True)]
                    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, s.ends)), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
                    columns = [np.full(len(start), s.part), pa.array(s.doc_ids, mask=s.null), s.before + start, s.ends - start, np.array(crc, np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names=names)

    return _files(spark, path).mapInArrow(run, "part long, doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """path, at (byte of the file), start (ids of all segments before it) and n_ids of each segment."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = [(s.part, name, s.at, s.before, s.n_ids) for s in segments(content.as_py())]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["part", "path", "at", "before", "n_ids"]), preserve_index=False)

    x = materialize(_files(spark, path).mapInArrow(run, "part long, path string, at long, before long, n_ids long"), "directory")
    return x.join(F.broadcast(_bases(x, "n_ids")), "part").select("path", "at", (F.col("base") + F.col("before")).alias("start"), "n_ids")


def _bases(x: DataFrame, count: str) -> DataFrame:
    """part and base (ids of all parts before it); a row for each task that wrote."""
    rows, base, out = sorted(x.groupBy("part").agg(F.sum(count).alias("n")).collect()), 0, []
    for r in rows:
        out.append((r.part, base))
        base += r.n
    return x.sparkSession.createDataFrame(out, "part long, base long")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """position and id for each distinct position (0 is the first id of the first document) that the files have."""
    block = lambda c: F.shiftright(c, SEGMENT_IDS.bit_length() - 1)
    known = directory(spark, path).where("n_ids > 0").withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("n_ids") - 1))))
    asked = places.select(F.col("position").cast("long")).distinct().withColumn("block", block(F.col("position")))
    asked = asked.join(known, "block").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_ids"))).select("path", "at", "position", (F.col("position") - F.col("start")).alias("inside"))

    def run(wanted: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        found = []
        for content in files.content:
            for at, own in wanted.groupby("at"):
                s = Segment(content, int(at))
                found.append(pd.DataFrame({"position": own.position, "id": [s[int(i)] for i in own.inside]}))
        return pd.concat(found) if found else pd.DataFrame({"position": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64")})

    return asked.groupBy("path").cogroup(_files(spark, path).groupBy("path")).applyInPandas(run, "position long, id long")


def encoded_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from files that are written, read back and then deleted."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        path = scratch.path("token-codes")
        write_codes(docs, path, tokenizer, end_id, whole, id_col, text_col)
        x = scratch.keep(read_documents(spark, path).drop("ids"), "coded-documents")
        return materialize(x.join(F.broadcast(_bases(x, "n_tokens")), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"), "documents")
