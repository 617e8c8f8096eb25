"""Operators do the whole job on inputs that a cut would hide in: small blocks, copies, short lines, frequent words."""

import random

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from llm.helpers import WORD

from fieldloom.llm import ann, brown_lm, line_dedup


@pytest.mark.parametrize(("n", "copies"), [(1, 1), (10, 1), (30, 1), (100, 1), (200, 1), (500, 1), (3, 5), (6, 40)])
def test_neighbours_of_unit_vectors_in_small_blocks(n, copies):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x = np.repeat(x / np.linalg.norm(x, axis=1)[:, None], copies, axis=0)
    rows = pd.DataFrame({"vec_id": np.arange(len(x)), "vector": list(x)})
    got = ann.search_block(rows, rows, 20, 64, 1.2, 42)
    hits = whole = 0
    for q in range(len(x)):
        s = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        own = got[got.query_id == q]
        assert len(own) == len(want) == min(20, len(x) - 1) and q not in set(own.vec_id)
        hits, whole = hits + len(set(own.vec_id) & set(want)), whole + len(want)
    assert hits >= 0.95 * whole


def test_equal_short_lines_go(spark):
    long = "a line of more than enough characters {}"
    texts = ["All rights reserved.\nHome\n" + long.format(1), "Home\n\nHome\nHone\n \nAll rights reserved.", long.format(2) + "\nMenu 1", "Menu 2\n\n\nMenu 1\nx", "Home\nx", "\t\nHome\n\t", None, "", "new \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for x in (t or "").split("\n"):
            if not WORD.search(x) or not (x in seen or (x.startswith("a line") and any(y.startswith("a line") for y in seen))):
                kept.append(x)
            seen.append(x)
        want[i] = None if t is None else "\n".join(kept)
    got = {r.doc_id: r for r in line_dedup.line_dedup(df, short=True).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert {i: r["n_dropped"] for i, r in got.items()} == {0: 0, 1: 3, 2: 1, 3: 1, 4: 2, 5: 1, 6: 0, 7: 0, 8: 0}
    docs = df.selectExpr("*", "'en' AS lang", "'a' AS source", "0L AS n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.lines(spark, docs, "").collect()) == [0, 1, 2, 3, 8]


def likelihood(of, bigrams):
    """Log-likelihood of class bigrams times what classes give their units, up to what no class changes."""
    grid = np.zeros((max(of) + 1,) * 2)
    np.add.at(grid, (np.repeat(of, len(of)), np.tile(of, len(of))), bigrams.ravel())
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(grid) - f(grid.sum(axis=0)) - f(grid.sum(axis=1)), grid


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(3)
    bigrams = rng.integers(0, 6, (12, 12)).astype(float)
    of = np.append(rng.integers(1, 5, 11), 0)
    of[:4] = 1, 2, 3, 4
    of[8:11] = 1, 2, 3
    u = 5
    values = []
    for k in range(1, 5):
        to = of.copy()
        to[u] = k
        values.append(likelihood(to, bigrams)[0])
    rest = bigrams.copy()
    rest[u], rest[:, u] = 0, 0
    row, col, own = bigrams[u].copy(), bigrams[:, u].copy(), bigrams[u, u]
    row[u] = col[u] = 0
    by_class = lambda x: np.bincount(of, weights=x, minlength=5)
    gain = brown_lm.gains(likelihood(of, rest)[1][None], by_class(row)[None], by_class(col)[None], np.array([own]))[0]
    assert np.allclose(gain[1:] - gain[1], np.array(values) - values[0])


def test_words_beyond_the_units_get_classes(spark):
    """Two kinds of 900 words each, of one shape, take turns; the model learns the turns from words that aren't units, as held-out texts show."""
    rng = random.Random(4)
    kinds = [[f"{k}{i:04d}zz" for i in range(900)] for k in "ab"]
    texts = [" ".join(rng.choice(kinds[(i + j) % 2]) for j in range(60)) for i in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gained = lambda **k: [r.score - r.base_score for r in brown_lm.lm_scores(df, **k).where("held_out").select("score", "base_score").collect()]
    own, shapes = np.mean(gained()), np.mean(gained(least_count=10**9))
    # One of two kinds known at each of 60 places: at most 60 * log10(2) = 18.
    assert 12 < own < 18.1 and own > shapes + 5


def test_scores_do_not_depend_on_how_many_words_are_sent(spark):
    """Of 1,800 words some 1,000 are sent and the others, all frequent enough for a class, meet theirs in joins; so do words of one place, none of which is."""
    rng = random.Random(6)
    kinds = [[f"{k}{i:04d}zz" for i in range(900)] for k in "ab"]
    texts = [" ".join([rng.choice(kinds[(i + j) % 2]) for j in range(60)] + [f"once{i}"] * (i % 3)) for i in range(700)] + [None, "", "never seen"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = lambda **k: {r.doc_id: (r.n_known, r.base_score, r.score) for r in brown_lm.lm_scores(df, **k).collect()}
    whole, few = scores(), scores(sent_words=1200)
    assert whole.keys() == few.keys()
    for i, x in whole.items():
        assert few[i] == pytest.approx(x, rel=1e-9), i


def test_class_model_is_a_distribution():
    rng = np.random.default_rng(5)
    words = np.arange(1, 1201, dtype=np.int64)
    n = rng.integers(1, 40, 1200)
    n[:768] += 100
    shape = rng.integers(0, brown_lm.SHAPES, 1200).astype(np.int16)
    v = brown_lm.Vocabulary(words, shape, n)
    classes = 6
    of = np.append(rng.integers(1, classes, brown_lm.UNITS - 1), 0)
    each = of[v.unit].astype(np.int16)
    each[v.moving] = rng.integers(1, classes, v.moving.sum())
    left = ~(v.moving | (v.unit >= brown_lm.SHAPES))
    total, many = (np.bincount(v.unit[left], weights=w, minlength=brown_lm.SHAPES) for w in (v.counts[left], np.ones(left.sum())))
    m = brown_lm.ClassModel(rng.integers(0, 50, (classes, classes)).astype(float), of, v, each, total, many, 30)
    assert np.allclose((10**m.after).sum(axis=1), 1)
    inside = np.bincount(each[~left], weights=10 ** m.entry[~left], minlength=classes) + np.bincount(of[v.unit[left]], weights=10 ** m.shape[v.unit[left]] * (v.counts[left] + 0.5), minlength=classes)
    # Each shape keeps half a count for words never seen.
    unseen = np.bincount(of[: brown_lm.SHAPES], weights=10**m.shape * 0.5, minlength=classes)
    inside[0] += 10**m.end
    assert np.allclose(inside + unseen, 1)
