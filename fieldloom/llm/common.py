"""Shared parts: materialising through the shared folder, and vectorised words over byte buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space and \t \n \v \f \r.
SPACE = b" \t\n\v\f\r"
#: Bytes of text handled at a time in Python; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, from spark.checkpoint.dir."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df once to the shared folder and reads it back, so that lineage ends at files any executor can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that an operator needs for a while only: keep() writes one, drop() deletes those of a name, clear() all.

    As a context manager it clears at the end, also after a failure.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def path(self, name: str) -> str:
        """A new path that is deleted with the tables of that name."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.setdefault(name, []).append(path)
        return path

    def keep(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """df, written and read back. free: let Spark drop the shuffle files of what was written now, not when the driver next collects garbage."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if free:
            del df
            self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for x in [x for n in names for x in self.paths.pop(n, [])]:
            path = jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)

    def clear(self) -> None:
        self.drop(*list(self.paths))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of df, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for x in names:
        while x.lower() in taken:
            x = f"_{x}"
        out.append(x)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The column's values in UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunked(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of the list that hold about `most` bytes each."""
    start = total = 0
    for i, x in enumerate(texts):
        if i > start and total + len(x) > most:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and ranges of the values are as good as random."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Weights:
    """A random odd number for each place in a word or piece; as many as the longest one so far needs."""

    def __init__(self) -> None:
        self.known = np.empty(0, U64)

    def __call__(self, places: np.ndarray) -> np.ndarray:
        most = int(places.max(initial=-1)) + 1
        if most > len(self.known):
            self.known = mix(np.arange(1, max(4096, 2 * most) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        return self.known[places]


weights = _Weights()
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


class Words:
    """The words of some texts: 64-bit hashes, byte positions and the text that each stands in.

    hashes, starts, ends: one entry a word, in order; counts: words of each text; buffer: the texts' bytes, a line
    feed after each; offsets: where each text begins in it. Equal words have equal hashes in every process.
    """

    def __init__(self, texts: list[bytes], lower: bool) -> None:
        self.buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts], out=self.offsets[1:])
        space = _IS_SPACE[self.buffer]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.starts, self.ends = edge[::2], edge[1::2]
        table = _BYTES[_LOWER] if lower else _BYTES
        inside = np.flatnonzero(~space)
        lengths = self.ends - self.starts
        if len(self.starts):
            first = np.zeros(len(lengths), np.int64)
            np.cumsum(lengths[:-1], out=first[1:])
            place = np.arange(len(inside)) - np.repeat(first, lengths)
            self.hashes = mix(np.add.reduceat(table[self.buffer[inside]] * weights(place), first))
        else:
            self.hashes = np.empty(0, U64)
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of n words inside one text, and how many each text has; the k-th window of a text starts at its k-th word. Shorter texts with words give one window of all of them."""
        firsts = np.cumsum(self.counts) - self.counts
        many = np.maximum(self.counts - n + 1, np.minimum(self.counts, 1))
        at = np.repeat(firsts, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size = np.repeat(np.minimum(self.counts, n), many)
        total = np.zeros(len(at), U64)
        padded = np.concatenate([self.hashes, np.zeros(n, U64)])
        for k in range(n):
            step = mix(padded[at + k] + U64((k + 1) * 0x632BE59BD9B4E019 % 2**64))
            total += step if k == 0 else np.where(size > k, step, U64(0))
        return mix(total + size.astype(U64)), many


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def hash_order(*columns) -> F.Column:
    """A seeded order that DuckDB's md5() can repeat."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in columns]))
