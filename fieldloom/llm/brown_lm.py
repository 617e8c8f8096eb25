"""Language-model scores by Brown's class-based n-grams, beside smoothed unigrams.

Word counts come from all training texts. Exchange clustering has two steps. First the OWN_UNITS most frequent words, the units
of shapes (last two bytes and length, hashed into SHAPES units, one of which holds any other word) and the end of a text: each
unit in turn moves to the class that raises the likelihood of the class bigrams most, by bigrams of units over all training
texts. Then every other word that occurs `least_count` times or more moves, all at once, from its shape's class to its own best one, by
the classes before and after each of its places in the training texts; Spark gathers these per word and decides in its tasks. The
clustered words so grow with the corpus. Class bigrams are then counted anew. The probability of a word is that of its class after
the class before, times that of the word in its class, each smoothed; a word without a class of its own shares its shape's part by
counts.

Counts of the most frequent words, at most `sent_words` of them (8 + 2 + 8 + 2 bytes each), go to every worker. All other words of
a text meet their counts in a join, and so do their classes: where words of `least_count` places or more are left beyond that bound
(far words), Spark gathers their contexts by word, and class bigrams and steps of a text that touch a word unknown to the workers
meet the far words' classes in joins. So nothing that grows with the vocabulary beyond the bound is broadcast, no word is left out,
and the scores don't depend on the bound. Words are told apart by 64-bit hashes.

Cases: a null or empty text is its end token alone. Without training texts every count is 0 and all scores are those of the
smoothing. A null id trains. Repeated rows count and score as often as they stand there. Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import _LOWER, Words, as_signed, chunked, materialize, mix, text_bytes

SENT_WORDS = 1 << 19
OWN_UNITS, SHAPES, CLASSES = 768, 256, 48
#: Places that a word needs for a class of its own.
LEAST_COUNT = 8
UNITS = SHAPES + OWN_UNITS + 1
END = UNITS - 1
#: Distinct words that a task gathers before it hands them on.
GATHERED = 1_000_000


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def shapes_of(w: Words, at: np.ndarray) -> np.ndarray:
    """The shape unit of the words at the given places."""
    last, length = w.ends[at] - 1, w.ends[at] - w.starts[at]
    before = np.where(length > 1, _LOWER[w.buffer[np.maximum(last - 1, 0)]], 0)
    x = _LOWER[w.buffer[last]] | before << 8 | np.minimum(length, 12) << 16
    return (mix(x.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), shape and count over all rows' texts."""
    schema = pa.schema([("word", pa.int64()), ("shape", pa.int16()), ("n", pa.int64())])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            word, shape, n = (np.concatenate(x) for x in zip(*held, strict=True))
            own, first, inverse = np.unique(word, return_index=True, return_inverse=True)
            return own, shape[first], np.bincount(inverse, weights=n, minlength=len(own)).astype(np.int64)

        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(as_signed(x[0])), pa.array(x[1], pa.int16()), pa.array(x[2])], schema=schema)

        size = 0
        for b in batches:
            raw = text_bytes(b.column(0))
            for i, j in chunked(raw):
                w = Words(raw[i:j], lower=True)
                own, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
                held.append((own, shapes_of(w, first), n))
                size += len(own)
                if size > GATHERED:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(merged())

    parts = texts.select("text").mapInArrow(run, "word long, shape short, n long")
    return parts.groupBy("word", "shape").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of frequent words, sorted by hash, and units of the most frequent ones; moving: the others that get classes of their own."""

    def __init__(self, word: np.ndarray, shape: np.ndarray, n: np.ndarray, least_count: int = LEAST_COUNT) -> None:
        top = np.lexsort((word, -n))[:OWN_UNITS]
        self.least = (int(n[top[-1]]), int(word[top[-1]])) if len(top) else (0, 0)
        self.top_counts = n[top]
        unit = shape.astype(np.int64)
        unit[top] = SHAPES + np.arange(len(top))
        hashes = word.view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.counts, self.unit = hashes[order], n[order], unit[order].astype(np.int16)
        self.moving = (self.unit < SHAPES) & (self.counts >= least_count)

    def look_up(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, unit and count of each word; entry and count -1 where the word isn't among the frequent ones."""
        own, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        entry, unit, count = np.full(len(own), -1), shapes_of(w, first), np.full(len(own), -1)
        if len(self.hashes) and len(own):
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            hit = self.hashes[at] == own
            entry[hit], unit[hit], count[hit] = at[hit], self.unit[at[hit]], self.counts[at[hit]]
        return entry[inverse], unit[inverse], count[inverse]


def with_ends(values: np.ndarray, counts: np.ndarray, end) -> np.ndarray:
    """The values of texts that follow each other, with one more after each text."""
    out = np.full(len(values) + len(counts), end, values.dtype)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(counts + 1) - 1] = False
    out[inside] = values
    return out


def unit_bigrams(texts: DataFrame, vocabulary) -> DataFrame:
    """pair (unit before * UNITS + unit) and count over all rows' texts; at most UNITS**2 rows."""

    def run(batches):
        total = np.zeros(UNITS * UNITS, np.int64)
        for b in batches:
            raw = text_bytes(b.column(0))
            for i, j in chunked(raw):
                w = Words(raw[i:j], lower=True)
                unit = with_ends(vocabulary.value.look_up(w)[1], w.counts, END)
                total += np.bincount(np.concatenate([[END], unit[:-1]]) * UNITS + unit, minlength=len(total))
        pair = np.flatnonzero(total)
        for i in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 100_000]), pa.array(total[pair[i : i + 100_000]])], names=["pair", "n"])

    return texts.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(grid: np.ndarray, row: np.ndarray, col: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What the likelihood gains when units join each class, a row each unit.

    grid: class bigrams without the unit; row, col: how often each class follows and precedes it; own: how often it follows itself.
    """
    # Whatever class it joins, its bigrams with the others' classes count there.
    left, right = grid.sum(axis=2) + col, grid.sum(axis=1) + row
    base, d = _f(grid), np.diagonal(grid, axis1=1, axis2=2)
    gain = (_f(grid + row[:, None, :]) - base).sum(axis=2) + (_f(grid + col[:, :, None]) - base).sum(axis=1)
    gain += _f(d + row + col + own[:, None]) - _f(d + row) - _f(d + col) + _f(d)
    out, into = (x.sum(axis=1, keepdims=True) + own[:, None] for x in (row, col))
    gain -= _f(left + out) - _f(left) + _f(right + into) - _f(right)
    gain[:, 0] = -np.inf
    return gain


def exchange(bigrams: np.ndarray, classes: int, passes: int = 8) -> np.ndarray:
    """The class of each unit. The last unit, the end, keeps class 0 to itself."""
    units = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-weight[:-1], kind="stable")
    of = np.zeros(units, np.int64)
    of[order] = 1 + np.arange(units - 1) % (classes - 1)
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    grid = member.T @ bigrams @ member
    for _ in range(passes):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, own = of[u], float(bigrams[u, u])
            row = np.bincount(of, weights=bigrams[u], minlength=classes)
            col = np.bincount(of, weights=bigrams[:, u], minlength=classes)
            row[a] -= own
            col[a] -= own
            grid[a] -= row
            grid[:, a] -= col
            grid[a, a] -= own
            gain = gains(grid[None], row[None], col[None], np.array([own]))[0]
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[u] = b
            grid[b] += row
            grid[:, b] += col
            grid[b, b] += own
        if not moved:
            break
    return of


def contexts(texts: DataFrame, vocabulary, of: np.ndarray) -> DataFrame:
    """entry, contexts (class after; classes + class before) and their counts, of the words that move, over all rows' texts; a row each task, mostly, for an entry."""
    classes = int(of.max()) + 1

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, v = 0, vocabulary.value

        def merged():
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            own, inverse = np.unique(key, return_inverse=True)
            return own, np.bincount(inverse, weights=n, minlength=len(own)).astype(np.int64)

        def out(x):
            key, n = x
            entry = key // (2 * classes)
            edge = np.append(np.flatnonzero(np.diff(entry, prepend=-1)), len(entry))
            for i in range(0, len(edge) - 1, 50_000):
                cut = edge[i : i + 50_001]
                inside, offsets = slice(cut[0], cut[-1]), pa.array((cut - cut[0]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[inside])) for v in ((key % (2 * classes)).astype(np.int16), n)]
                yield pa.RecordBatch.from_arrays([pa.array(entry[cut[:-1]].astype(np.int32)), *lists], names=["entry", "contexts", "n"])

        for b in batches:
            raw = text_bytes(b.column(0))
            for i, j in chunked(raw):
                w = Words(raw[i:j], lower=True)
                entry, unit, _ = v.look_up(w)
                c, entry = of[with_ends(unit, w.counts, END)], with_ends(entry, w.counts, -1)
                at = np.flatnonzero((entry >= 0) & v.moving[entry]) if len(v.moving) else np.empty(0, np.int64)
                # A text ends with its end, so a word's place has one after it; before the first is an end.
                before = np.where(at > 0, c[at - 1], of[END])
                own, n = np.unique(np.concatenate([entry[at] * 2 * classes + c[at + 1], (entry[at] * 2 + 1) * classes + before]), return_counts=True)
                held.append((own, n))
                size += len(own)
                if size > GATHERED:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(merged())

    return texts.select("text").mapInArrow(run, "entry int, contexts array<short>, n array<long>")


def best_classes(part: np.ndarray, a: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The best class of each word, given the counts of its contexts (classes after, then before) and its class so far."""
    classes, each = len(grid), np.arange(len(part))
    row, col = part[:, :classes], part[:, classes:]
    without = np.repeat(grid[None], len(part), axis=0)
    without[each, a] -= row
    without[each, :, a] -= col
    gain = gains(np.maximum(without, 0), row, col, np.zeros(len(part)))
    best = gain.argmax(axis=1)
    return np.where(gain[each, best] > gain[each, a] + 1e-9, best, a)


def moves(met: DataFrame, grid: np.ndarray, start: np.ndarray) -> DataFrame:
    """entry and its best class, for each entry of contexts(). grid: class bigrams; start: the class of each entry so far.

    A task adds up its share of the entries in one table of 2 * classes counts an entry, which the vocabulary's bound limits.
    """
    classes = len(grid)
    sent = met.sparkSession.sparkContext.broadcast((grid, start))  # classes squared, and the bounded vocabulary

    def run(batches):
        grid, start = sent.value
        place, entries, table, known = np.full(len(start), -1), np.empty(1024, np.int32), np.zeros((1024, 2 * classes)), 0
        for b in batches:
            entry, seen = b.column(0).to_numpy(), b.column(1)
            new = np.unique(entry[place[entry] < 0])
            while known + len(new) > len(table):
                entries, table = np.concatenate([entries, np.empty_like(entries)]), np.concatenate([table, np.zeros_like(table)])
            place[new] = known + np.arange(len(new))
            entries[known : known + len(new)] = new
            known += len(new)
            line = np.repeat(place[entry], np.diff(seen.offsets.to_numpy()))
            np.add.at(table.reshape(-1), line * 2 * classes + seen.flatten().to_numpy(), b.column(2).flatten().to_numpy())
        for i in range(0, known, 128):
            entry, part = entries[i : min(i + 128, known)], table[i : min(i + 128, known)]
            best = best_classes(part, start[entry].astype(np.int64), grid)
            yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(best.astype(np.int16))], names=["entry", "class"])

    return met.repartition("entry").mapInArrow(run, "entry int, class short")


def class_of(vocabulary: Vocabulary, entry: np.ndarray, unit: np.ndarray, of: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each word: its entry's, else its shape's."""
    known = entry >= 0
    return np.where(known, classes[np.where(known, entry, 0)], of[unit]) if len(classes) else of[unit]


#: A step of a text to a token from the one before it, where one of the two is a word that workers don't know: words (null: known) and classes (of shapes, for those words), and the shape of the token.
STEP = "word_before long, before int, word long, class int, shape int"


def open_steps(w: Words, entry: np.ndarray, unit: np.ndarray, c: np.ndarray, first: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Which tokens of texts with their ends are met by an open step, and the columns of STEP. c: classes; first: that of an end."""
    unknown = with_ends(entry < 0, w.counts, False)
    was = np.concatenate([[False], unknown[:-1]])
    open_ = unknown | was
    word, at = with_ends(as_signed(w.hashes), w.counts, 0), np.flatnonzero(open_)
    before = np.concatenate([[first], c[:-1]])
    columns = [pa.array(word[at - 1], mask=~was[at]), pa.array(before[at].astype(np.int32)), pa.array(word[at], mask=~unknown[at]), pa.array(c[at].astype(np.int32)), pa.array(with_ends(unit, w.counts, 0)[at].astype(np.int32))]
    return open_, columns


def far_steps(texts: DataFrame, vocabulary, of: np.ndarray, classes) -> DataFrame:
    """The open steps of all rows' texts; classes: those of the vocabulary's entries."""

    def run(batches):
        for b in batches:
            raw = text_bytes(b.column(0))
            for i, j in chunked(raw):
                w = Words(raw[i:j], lower=True)
                entry, unit, _ = vocabulary.value.look_up(w)
                c = with_ends(class_of(vocabulary.value, entry, unit, of, classes.value), w.counts, of[END])
                yield pa.RecordBatch.from_arrays(open_steps(w, entry, unit, c, of[END])[1], names=[x.split()[0] for x in STEP.split(", ")])

    return texts.select("text").mapInArrow(run, STEP)


def far_moves(steps: DataFrame, far: DataFrame, grid: np.ndarray, of: np.ndarray) -> DataFrame:
    """word, class and n of each far word (word, shape, n), by the open steps with classes so far; contexts are added up by Spark, so a word is one row of 2 * classes counts at most."""
    classes = len(grid)
    sent = far.sparkSession.sparkContext.broadcast((grid, of))
    after = steps.where("word_before is not null").select(F.col("word_before").alias("word"), F.col("class").alias("context"))
    before = steps.where("word is not null").select("word", (F.col("before") + classes).alias("context"))
    seen = after.unionByName(before).groupBy("word", "context").agg(F.count("*").alias("times"))
    met = seen.join(far, "word").groupBy("word", "shape", "n").agg(F.collect_list("context").alias("contexts"), F.collect_list("times").alias("times"))

    def run(batches):
        grid, of = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 128):
                x = b.slice(i, 128)
                part = np.zeros((x.num_rows, 2 * classes))
                contexts, times = x.column(3), x.column(4)
                line = np.repeat(np.arange(x.num_rows), np.diff(contexts.offsets.to_numpy()))
                part[line, contexts.flatten().to_numpy()] = times.flatten().to_numpy()
                best = best_classes(part, of[x.column(1).to_numpy()].astype(np.int64), grid)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(best.astype(np.int32)), x.column(2)], names=["word", "far", "n"])

    return met.mapInArrow(run, "word long, far int, n long")


def with_far(steps: DataFrame, far: DataFrame) -> DataFrame:
    """Open steps with the far words' (word, far, n) own classes, and whether the token is one."""
    here, there = far.select("word", "far"), far.select(F.col("word").alias("word_before"), F.col("far").alias("far_before"))
    x = steps.join(here, "word", "left").join(there, "word_before", "left").withColumn("own", F.col("far").isNotNull())
    return x.withColumns({"class": F.coalesce("far", "class"), "before": F.coalesce("far_before", "before")})


def class_bigrams(texts: DataFrame, vocabulary, of: np.ndarray, classes, far: bool = False) -> DataFrame:
    """pair (class before * number of classes + class) and count over all rows' texts; far: without open steps."""
    many = int(of.max()) + 1

    def run(batches):
        total = np.zeros(many * many, np.int64)
        for b in batches:
            raw = text_bytes(b.column(0))
            for i, j in chunked(raw):
                w = Words(raw[i:j], lower=True)
                entry, unit, _ = vocabulary.value.look_up(w)
                c = with_ends(class_of(vocabulary.value, entry, unit, of, classes.value), w.counts, of[END])
                pair = np.concatenate([[of[END]], c[:-1]]) * many + c
                total += np.bincount(pair[~open_steps(w, entry, unit, c, of[END])[0]] if far else pair, minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    return texts.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class ClassModel:
    """log10 probabilities: of a class after another, of an entry in its class, and of a shape in its class over the smoothed counts of its words.

    grid: class bigrams; of: the class of each unit; classes: that of each entry of the vocabulary; shape_total, shape_words: count of
    places and of words of each shape, of words without a class of their own; ends: count of ends; far: smoothed counts of the far words of each class.
    """

    def __init__(self, grid: np.ndarray, of: np.ndarray, vocabulary: Vocabulary, classes: np.ndarray, shape_total: np.ndarray, shape_words: np.ndarray, ends: int, smooth: float = 2.0, far: np.ndarray | None = None) -> None:
        self.of, self.classes, many = of, classes, len(grid)
        share = (grid.sum(axis=0) + 0.5) / (grid.sum() + 0.5 * many)
        self.after = np.log10((grid + smooth * many * share) / (grid.sum(axis=1, keepdims=True) + smooth * many))
        self.single = vocabulary.moving | (vocabulary.unit >= SHAPES)
        n = vocabulary.counts + 0.5
        mass = np.bincount(of[:SHAPES], weights=shape_total + 0.5, minlength=many)
        mass += np.bincount(classes[self.single], weights=n[self.single], minlength=many)
        mass[of[END]] += ends + 0.5
        if far is not None:
            mass += far
        self.mass = np.log10(mass)
        self.entry = np.log10(n / mass[classes]) if len(n) else np.empty(0)
        self.shape = np.log10((shape_total + 0.5) / mass[of[:SHAPES]]) - np.log10(shape_total + 0.5 * (shape_words + 1))
        self.end = np.log10((ends + 0.5) / mass[of[END]])

    def step_part(self, before: np.ndarray, c: np.ndarray, word: np.ndarray, own: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """What open steps add to known_part: the class after the class before and, where the token is an unknown word, its part of its class without its count."""
        return self.after[before, c] + np.where(word, np.where(own, -self.mass[c], self.shape[np.minimum(shape, SHAPES - 1)]), 0.0)

    def known_part(self, vocabulary: Vocabulary, entry: np.ndarray, unit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is known of each token's log10 probability without its count, for texts that follow each other, with their ends; and the words whose count is still to add."""
        single = (entry >= 0) & self.single[entry] if len(self.single) else np.zeros(len(entry), bool)
        emit = np.where(single, self.entry[np.where(single, entry, 0)] if len(self.entry) else 0.0, self.shape[np.minimum(unit, SHAPES - 1)])
        c = with_ends(class_of(vocabulary, entry, unit, self.of, self.classes), counts, self.of[END])
        return self.after[np.concatenate([[self.of[END]], c[:-1]]), c] + with_ends(emit, counts, self.end), ~single


_ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

_STEP_NAMES = [x.split()[0] for x in STEP.split(", ")]
_STEPS = pa.field("steps", pa.list_(pa.struct([(x, pa.int64() if x.startswith("word") else pa.int32()) for x in _STEP_NAMES])))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_words: int = SENT_WORDS, classes: int = CLASSES, least_count: int = LEAST_COUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    training = docs.where(~held_out())
    counts = materialize(word_counts(training), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    # The frequent words: all above a count that at most sent_words words reach.
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    reached, least = 0, 1 << 62
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("m"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():  # a few hundred rows at most
        reached += r["m"]
        if reached > sent_words:
            break
        least = r["least"]
    sent = counts.where(F.col("n") >= least).toArrow()
    vocabulary = Vocabulary(*(np.ascontiguousarray(sent.column(c).to_numpy()) for c in ("word", "shape", "n")), least_count)
    spread = spark.sparkContext.broadcast(vocabulary)
    n, w = vocabulary.least
    # Words that would move but are beyond what is sent.
    far = counts.where((F.col("n") < least) & (F.col("n") >= least_count))
    beyond = bool(far.limit(1).count())
    shaped = counts.where(F.col("n") < least_count)
    if len(vocabulary.top_counts):
        shaped = shaped.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > w)))
    shape_total, shape_words = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in shaped.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # at most SHAPES rows
        shape_total[r["shape"]], shape_words[r["shape"]] = r["n"], r["v"]
    pairs = unit_bigrams(training, spread).toArrow()
    bigrams = np.zeros(UNITS * UNITS)
    bigrams[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    bigrams = bigrams.reshape(UNITS, UNITS)
    of = exchange(bigrams, classes)
    member = np.zeros((UNITS, int(of.max()) + 1))
    member[np.arange(UNITS), of] = 1
    entry_class = of[vocabulary.unit].astype(np.int16)
    if vocabulary.moving.any():
        moved = moves(contexts(training, spread, of), member.T @ bigrams @ member, entry_class).toArrow()  # at most sent_words rows
        entry_class = entry_class.copy()
        entry_class[moved.column("entry").to_numpy()] = moved.column("class").to_numpy()
    many = member.shape[1]
    grid, far_mass = np.zeros(many**2), None
    own_classes = spark.sparkContext.broadcast(entry_class)
    pairs = class_bigrams(training, spread, of, own_classes, beyond)
    if beyond:
        so_far = far_steps(training, spread, of, spark.sparkContext.broadcast(of[vocabulary.unit].astype(np.int16)))
        far = materialize(far_moves(so_far, far, member.T @ bigrams @ member, of), "far-words")
        far_mass = np.zeros(many)
        for r in far.groupBy("far").agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():  # at most a row for a class
            far_mass[r["far"]] = r["mass"]
        steps = with_far(far_steps(training, spread, of, own_classes), far).groupBy((F.col("before").cast("long") * many + F.col("class")).alias("pair")).agg(F.count("*").alias("n"))
        pairs = pairs.unionByName(steps).groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = pairs.toArrow()
    grid[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    model = spark.sparkContext.broadcast(ClassModel(grid.reshape(many, -1), of, vocabulary, entry_class, shape_total, shape_words, ends, far=far_mass))

    def run(batches):
        log_end = np.log10(ends + 0.5)
        for b in batches:
            raw = text_bytes(b.column(3))
            for i, j in chunked(raw):
                w = Words(raw[i:j], lower=True)
                entry, unit, count = spread.value.look_up(w)
                starts = np.cumsum(w.counts + 1) - w.counts - 1
                sums = lambda x: np.add.reduceat(x, starts)
                by_text = lambda x: sums(with_ends(x, w.counts, 0))  # noqa: E731, B023
                logs = np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0)
                known, open_ = model.value.known_part(spread.value, entry, unit, w.counts)
                steps = []
                if beyond:
                    # Tokens of open steps get their part when the far words' classes are known.
                    c = with_ends(class_of(spread.value, entry, unit, of, own_classes.value), w.counts, of[END])
                    later, columns = open_steps(w, entry, unit, c, of[END])
                    known = np.where(later, with_ends(np.zeros(len(entry)), w.counts, model.value.end), 0.0) + np.where(later, 0.0, known)
                    emitted = later & ~with_ends(entry < 0, w.counts, True)
                    known[emitted] += model.value.entry[with_ends(entry, w.counts, 0)[emitted]]
                    ends_of = np.concatenate([[0], np.cumsum(later)[np.cumsum(w.counts + 1) - 1]]).astype(np.int32)
                    steps = [pa.ListArray.from_arrays(pa.array(ends_of), pa.StructArray.from_arrays(columns, names=_STEP_NAMES))]
                model_sum = sums(known) + by_text(np.where(open_, logs, 0.0))
                # Words that aren't among the frequent ones, each once for a text.
                rare = np.flatnonzero(count < 0)
                owner, word = w.text_of_word()[rare], as_signed(w.hashes[rare])
                order = np.lexsort((word, owner))
                owner, word = owner[order], word[order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(word)))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(w.counts)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int64))) for x in (word[at], times)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(w.counts + 1), pa.array(by_text((count > 0).astype(np.int64)) + int(ends > 0)), pa.array(by_text(logs) + log_end), pa.array(model_sum), *lists, *steps], schema=_ROWS.append(_STEPS) if beyond else _ROWS)

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text")
    rows = materialize(keyed.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, words array<long>, times array<long>" + (f", steps array<struct<{STEP.replace(' ', ':').replace(',:', ',')}>>" if beyond else "")), "scores")
    asked = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rest = counts.where(F.col("n") < least).select("word", "n")
    met = asked.join(rest, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("logs"),
    )
    if beyond:

        def added(batches):
            for b in batches:
                before, c, word, own, shape = (b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.step_part(before, c, word, own, shape))], names=["row", "part"])

        steps = with_far(rows.select("row", F.explode("steps").alias("s")).select("row", "s.*"), far)
        parts = steps.select("row", "before", "class", F.col("word").isNotNull().alias("word"), "own", "shape").mapInArrow(added, "row long, part double")
        rows = rows.drop("steps").join(parts.groupBy("row").agg(F.sum("part").alias("part")), "row", "left").withColumn("model", F.col("model") + F.coalesce("part", F.lit(0.0))).drop("part")
    nothing = float(np.log10(tokens + 0.5 * (distinct + 1)))
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.drop("words", "times").join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * nothing).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
