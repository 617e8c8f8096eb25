"""Quality rules with an isolation forest over rule statistics.

Statistics of every whole text are counted first; fixed rules reject the plainest failures. For the rest, a forest of
random splits isolates texts whose statistics are unusual: the shorter the mean path to a leaf, the higher the anomaly
score. About `fit_rows` labelled rows are taken by a seeded hash of the id. The forest is fitted on the rows of good quality
in one half of them, and its threshold is calibrated on the other half: of all thresholds that keep at least `keep` of
the good rows, the one with the best balanced accuracy.

Cases: a null or empty text has no words and fails the base rules. Without labelled rows of good quality, the base
rules alone decide. Repeated rows give repeated rows. Only the id and text columns are read, so others may have any
name. Null ids are kept as rows and never match a label.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Words, batch, chunked, materialize, text_bytes

# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

STATS = pa.schema([("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_stops")]])
STATS_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_digits long, n_stops long"


def _marks(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SYMBOL, _DIGIT, _STOP = _marks(SYMBOLS), _marks(b"0123456789"), _marks(b".!?")
_STARTS = np.arange(256) & 0xC0 != 0x80
_BLANK = _marks(b" \t\n\v\f\r")


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return len(lines), len(lines) - len(set(lines))


def repeated(words: Words, n: int = 3) -> np.ndarray:
    """Which words stand in a window of n that its text has twice or more."""
    hit = np.zeros(len(words.hashes) + n, bool)
    doc = words.text_of_word()
    at = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, np.int64)
    if len(at):
        keys, many = words.shingles(n)
        keys = keys[np.repeat(words.counts >= n, many)] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(n):
            hit[at[twice] + k] = True
    return hit[: len(words.hashes)]


def _counts(texts: list[bytes]) -> list[np.ndarray]:
    w = Words(texts, lower=False)
    sums = lambda flags: np.add.reduceat(flags, w.offsets[:-1], dtype=np.int64)
    firsts = np.concatenate([[0], np.cumsum(w.counts)])
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[firsts])
    lines = [_lines(x) for x in texts]
    return [w.counts, sums(_STARTS[w.buffer] & ~_BLANK[w.buffer]), sums(_SYMBOL[w.buffer]), [x[1] for x in lines], total(repeated(w)), [x[0] for x in lines], sums(_DIGIT[w.buffer]), sums(_STOP[w.buffer])]


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each row of docs."""

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column(1))
            for i, j in chunked(texts):
                yield batch(STATS, b.column(0).slice(i, j - i), *_counts(texts[i:j]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STATS_DDL)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(x: pd.DataFrame) -> np.ndarray:
    """Shares and means, so that a long clean text looks like a short clean one."""
    words, lines = np.maximum(x["n_words"].to_numpy(float), 1), np.maximum(x["n_lines"].to_numpy(float), 1)
    chars = np.maximum(x["word_chars"].to_numpy(float), 1)
    return np.column_stack([
        np.log1p(x["n_symbols"].to_numpy(float) / words * 20),
        x["n_repeat_words"].to_numpy(float) / words,
        x["n_dup_lines"].to_numpy(float) / lines,
        chars / words,
        np.log1p(x["n_digits"].to_numpy(float) / chars * 50),
        np.log1p(x["n_stops"].to_numpy(float) / words * 5),
    ])


class IsolationForest:
    """Trees of random splits. A node draws a feature and a cut from the range of its rows widened by `margin` times the feature's spread on each side, so that empty space beyond the fitted rows is cut off early."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42, margin: float = 1.0) -> None:
        rng = np.random.default_rng(seed)
        self.sample = max(2, min(sample, len(rows)))
        self.spread = margin * np.maximum(np.ptp(rows, axis=0), 1e-9) if len(rows) else np.ones(rows.shape[1])
        self.depth = max(1, math.ceil(math.log2(self.sample)))
        self.trees = [self._grow(rows[rng.permutation(len(rows))[: self.sample]], rng) for _ in range(trees)]

    @staticmethod
    def usual(n: float) -> float:
        """Mean path of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n < 3 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        feature, cut, below, length = [], [], [], []
        todo = [(rows, 0, rows.min(axis=0) - self.spread, rows.max(axis=0) + self.spread)]
        while todo:
            own, depth, low, high = todo.pop(0)
            at = len(feature)
            if depth >= self.depth or len(own) <= 1:
                feature.append(-1), cut.append(0.0), below.append(-1), length.append(depth + self.usual(len(own)))
                continue
            k = int(rng.integers(own.shape[1]))
            x = float(rng.uniform(low[k], high[k]))
            feature.append(k), cut.append(x), below.append(at + len(todo) + 1), length.append(0.0)
            left, right = own[own[:, k] < x], own[own[:, k] >= x]
            upper, lower = high.copy(), low.copy()
            upper[k], lower[k] = x, x
            todo += [(left, depth + 1, low, upper), (right, depth + 1, lower, high)]
        return {"feature": np.array(feature), "cut": np.array(cut), "below": np.array(below), "length": np.array(length)}

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; higher: isolated sooner."""
        total = np.zeros(len(rows))
        for t in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                k = t["feature"][at]
                go = k >= 0
                if not go.any():
                    break
                right = rows[np.arange(len(rows)), np.maximum(k, 0)] >= t["cut"][at]
                at = np.where(go, t["below"][at] + right, at)
            total += t["length"][at]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(self.usual(self.sample), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, keep: float) -> float:
    """The threshold above which rows are rejected."""
    if not good.any():
        return math.inf
    least = float(np.quantile(scores[good], keep, method="higher"))
    if good.all():
        return max(least, float(scores.max()))
    cuts = np.unique(scores[scores >= least])
    cuts = cuts[:: max(1, len(cuts) // 2000)]
    kept = np.array([(scores[good] <= c).mean() + (scores[~good] > c).mean() for c in cuts])
    return float(cuts[len(kept) - 1 - int(np.argmax(kept[::-1]))])


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = 20_000, keep: float = 0.998, seed: int = 42) -> tuple[IsolationForest, float] | None:
    """The forest from half, and its threshold from the other half, of about fit_rows labelled rows of stats (all, if fewer): those whose seeded order is below a share of its range."""
    own = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long"), "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = own.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    share = min(1.0, fit_rows / max(1, own.count()))
    if share < 1:
        own = own.where(F.col("order") < f"{int(share * 16**8):08x}")
    rows = stats.where(~base_failed()).join(own, "doc_id").toPandas().sort_values(["order", *STATS.names], kind="stable", ignore_index=True)
    good = rows["quality"].to_numpy() > 0
    if not good.any():
        return None
    x, fitted = features(rows), rows["order"].str[-1].isin(list("02468ace")).to_numpy()
    if not (good & fitted).any() or not (good & ~fitted).any():  # too few to keep some apart
        fitted[:] = True
        held = fitted
    else:
        held = ~fitted
    forest = IsolationForest(x[good & fitted], seed=seed)
    return forest, calibrate(forest.scores(x[held]), good[held], keep)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 20_000, keep: float = 0.998, seed: int = 42) -> DataFrame:
    """Statistics of each row of docs, base_failed, the forest's anomaly score and kept."""
    stats = materialize(rule_statistics(docs, id_col, text_col), "rule-statistics")
    model = fit(stats, labels, fit_rows, keep, seed)
    forest, threshold = model or (None, math.inf)

    def score(parts):
        for x in parts:
            yield x.assign(anomaly=forest.scores(features(x)) if forest else 0.0)

    scored = stats.mapInPandas(score, STATS_DDL + ", anomaly double")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 20_000, keep: float = 0.998, seed: int = 42) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps. Rows are judged where they are, without a join."""
    model = fit(materialize(rule_statistics(docs, id_col, text_col), "rule-statistics"), labels, fit_rows, keep, seed)
    forest, threshold = model or (None, math.inf)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column(at))
            for i, j in chunked(texts):
                x = pd.DataFrame(dict(zip(STATS.names[1:], _counts(texts[i:j]), strict=True)))
                failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
                good = ~failed.to_numpy() & (forest.scores(features(x)) <= threshold if forest else True)
                yield b.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
