"""Approximate nearest neighbours by largest inner product, with a hash-prefix forest over blocks of the rows.

Rows are dealt into blocks of `block_rows` and queries into blocks of `query_rows`; each pair of blocks is one group, so a
task holds two blocks of bounded size however many rows there are and however many are alike. In a block, equal vectors
are one entry with the smallest ids that a result can need. An entry gets one extra coordinate that makes all entries equally
long, so that the nearest by angle is the nearest by inner product; each of `trees` trees sorts the entries by a string of 32
random hyperplane signs. A query descends to its longest matching prefix in every tree, then all trees ascend together, one sign
at a time, until they hold `probe` times the block's entries, repeats counted, and at least FLOOR * k different ones (or all).
Entries that hold nothing but the query's own id count for neither. These candidates are scored exactly, in double precision,
and the best of all blocks are merged.

No row is left out of the index and no bucket has a cap. Cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor does a row without an id; a query meets only vectors of its own length; other rows with the
query's id count as its own. Ties go to the smaller id. An empty table, or one without queries, gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIGNS = 32
#: Different entries that a query meets at least, as a multiple of k: blocks of fewer are compared whole.
FLOOR = 16
DDL = "query_id long, vec_id long, score double"


class Forest:
    """Sorted sign strings of the rows of x, one array a tree."""

    def __init__(self, x: np.ndarray, trees: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        squares = (x * x).sum(axis=1)
        self.planes = rng.standard_normal((x.shape[1] + 1, trees * SIGNS)).astype(np.float32)
        longest = squares.max()
        extra = np.sqrt(np.maximum(0, longest - squares))
        self.size = len(x)
        strings = self._strings(np.column_stack([x, extra]))
        self.order = np.argsort(strings, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(strings.T, self.order, axis=1))
        self.place = np.argsort(self.order, axis=1).astype(np.int32)

    def _strings(self, x: np.ndarray) -> np.ndarray:
        """Sign strings as 32-bit numbers: a row each row of x, a column each tree."""
        out = np.empty((len(x), self.planes.shape[1] // SIGNS), np.uint32)
        for i in range(0, len(x), 4096):
            signs = (x[i : i + 4096].astype(np.float32) @ self.planes) > 0
            packed = np.packbits(signs, axis=1)
            out[i : i + 4096] = packed.view(">u4").astype(np.uint32)
        return out

    def candidates(self, queries: np.ndarray, want: float, least: int, whose: np.ndarray, own_entry: np.ndarray) -> list[np.ndarray]:
        """For each query, the entries that the trees hold when, ascending together, they first hold `want` of them and `least` different ones.

        whose, own_entry: pairs of a query and an entry that only holds the query's id; such entries are neither counted nor given.
        """
        strings = self._strings(np.column_stack([queries, np.zeros(len(queries))])).T
        trees, n = strings.shape
        open_, closed = np.arange(n), np.zeros(n, bool)
        held, out = np.zeros(self.size, bool), [np.empty(0, np.int64)] * n
        first = np.searchsorted(whose, np.arange(n + 1))
        # Longest match in any tree: with one of the two neighbours in sorted order.
        reach = np.zeros(n, np.int64)
        for t in range(trees):
            at = np.searchsorted(self.sorted[t], strings[t])
            for k in (np.maximum(at - 1, 0), np.minimum(at, self.size - 1)):
                differ = (self.sorted[t][k] ^ strings[t]).astype(np.float64)
                reach = np.maximum(reach, SIGNS - np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1))) + 1, 0).astype(np.int64))
        for depth in range(int(reach.max(initial=0)), -1, -1):
            own = open_[reach[open_] >= depth]
            if not len(own):
                continue
            below = np.uint32((1 << (SIGNS - depth)) - 1)
            a, b = np.empty((trees, len(own)), np.int64), np.empty((trees, len(own)), np.int64)
            for t in range(trees):
                q = strings[t][own]
                a[t], b[t] = np.searchsorted(self.sorted[t], q & ~below), np.searchsorted(self.sorted[t], q | below, side="right")
            total = (b - a).sum(axis=0)
            mine = np.flatnonzero(np.isin(whose, own))
            at, place = np.searchsorted(own, whose[mine]), self.place[:, own_entry[mine]]
            np.subtract.at(total, at, ((place >= a[:, at]) & (place < b[:, at])).sum(axis=0))
            full = np.flatnonzero((total >= min(want, trees * self.size)) | (depth == 0))
            for c in full.tolist():
                q = own[c]
                for t, i, j in zip(range(trees), a[:, c].tolist(), b[:, c].tolist(), strict=True):
                    held[self.order[t, i:j]] = True
                held[own_entry[first[q] : first[q + 1]]] = False
                got = np.flatnonzero(held)
                held[got] = False
                if len(got) >= least or depth == 0:
                    out[q] = got
                    closed[q] = True
            open_ = open_[~closed[open_]]
            if not len(open_):
                break
        return out


def _matrix(rows: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by length: their row numbers and a matrix."""
    sizes = np.array([len(v) for v in rows])
    return {int(d): (np.flatnonzero(sizes == d), np.stack(rows[sizes == d].to_list()).astype(float)) for d in np.unique(sizes)}


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int, trees: int, probe: float, seed: int) -> pd.DataFrame:
    """The k best that one block of rows holds for each query of one block."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    index = _matrix(rows["vector"]) if len(rows) else {}
    for d, (qs, q) in (_matrix(queries["vector"]) if len(queries) else {}).items():
        if d not in index:
            continue
        at, x = index[d]
        ids = rows["vec_id"].to_numpy()[at]
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order]) + 0.0
        _, first, which = np.unique(x.view(f"V{8 * d}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(which, kind="stable")
        start = np.append(np.searchsorted(which[by], np.arange(len(first))), len(by))
        distinct = x[first]
        forest = Forest(distinct, trees, seed)
        rough, longest = distinct.astype(np.float32), np.sqrt((distinct * distinct).sum(axis=1).max())
        # Entries of one id only, by that id, and the queries of that id.
        low, high = ids[by[start[:-1]]], ids[by[start[1:] - 1]]
        single = np.flatnonzero(low == high)
        single = single[np.argsort(low[single], kind="stable")]
        asked = queries["vec_id"].to_numpy()[qs]
        a, b = np.searchsorted(low[single], asked), np.searchsorted(low[single], asked, side="right")
        whose = np.repeat(np.arange(len(qs)), b - a)
        mine = single[np.arange(len(whose)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
        for i, own in enumerate(forest.candidates(q, probe * len(first), FLOOR * k, whose, mine)):
            if len(own) > k + 1:
                # Single precision leaves out those that are too far by more than its error.
                near = rough[own] @ q[i].astype(np.float32)
                least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                own = own[near >= least - 1e-5 * d * longest * np.sqrt((q[i] * q[i]).sum())] if np.isfinite(near).all() else own
            scores = (distinct[own] * q[i]).sum(axis=1)
            # Each entry stands for its ids, of which the k + 1 smallest can matter.
            many = np.minimum(start[own + 1] - start[own], k + 1)
            who = ids[by[np.repeat(start[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]]
            value = np.repeat(scores, many)
            query = queries["vec_id"].iloc[qs[i]]
            who, value = who[who != query], value[who != query]
            best = np.lexsort((who, -value))[:k]
            out.append((np.full(len(best), query), who[best], value[best]))
    if not out:
        return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(math.inf)))
    return x.where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda e: e != 0))


def nearest(vectors: DataFrame, query_every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 64, probe: float = 1.2, block_rows: int = 8192, query_rows: int = 4096, seed: int = 42) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose id is divisible by query_every."""
    x = usable(vectors, id_col, vector_col)
    q = x.where(F.col("vec_id") % query_every == 0)
    n, m = x.agg(F.count("*"), F.count(F.when(F.col("vec_id") % query_every == 0, 1))).first()
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    rows = x.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")).withColumn("part", spread(parts))
    asked = q.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(parts)).cast("int")).withColumn("block", spread(blocks))

    def group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_block(left, right, k, trees, probe, seed)

    found = rows.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(group, DDL)
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
