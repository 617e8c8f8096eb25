"""Token codes, the trie of conversations and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm.helpers import DDL, WORD, corpus, lower
from tokenizers import Tokenizer

from fieldloom.llm import importance, prefix_trie, token_codes
from fieldloom.session import shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["áb  ́c", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "it's we'LL 3rd\x00\x1c \u0085z", "ÀÉ İ\t\n\r\v\f x", "漢字かな交じり", "x" * 70_000, "12 345,6"]


# --- Token codes.


def plain_codes(rows):
    whole, out, start = Tokenizer.from_file(TOKENIZER), [], 0
    for doc, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_codes_of_documents(spark, monkeypatch):
    monkeypatch.setattr(token_codes, "SEGMENT_IDS", 500)
    rows = [(i, t) for i, t, *_ in corpus(30)] + [(900 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in random.Random(2).sample(rows, len(rows))], "doc_id long, text string, part long, start long, value string").repartition(5)
    want = plain_codes(rows)
    got = sorted(tuple(r) for r in token_codes.encoded_documents(df, TOKENIZER).collect())
    assert got == [x[:4] for x in want]
    path = f"{shared_folder(spark)}/codes-test"
    token_codes.write_codes(df, path, TOKENIZER)
    ids = [i for x in want for i in x[4]]
    files = token_codes.read_documents(spark, path).select("doc_id", "ids").collect()
    assert {r.doc_id: r.ids for r in files} == {x[0]: x[4] for x in want}
    places = [0, len(ids) - 1, len(ids), -1, *random.Random(3).sample(range(len(ids)), 300), 5, 5]
    found = token_codes.tokens_at(spark, path, spark.createDataFrame([(p,) for p in places], "position long")).collect()
    assert {(r.position, r.id) for r in found} == {(p, ids[p]) for p in places if 0 <= p < len(ids)} and len(found) == len({r.position for r in found})


def test_codes_without_documents_with_null_ids_and_repeats(spark):
    df = spark.createDataFrame([], DDL)
    assert token_codes.encoded_documents(df, TOKENIZER).collect() == []
    df = spark.createDataFrame([(None, "b"), (3, "c d"), (3, "c d"), (3, None), (-1, "")], "doc_id long, text string")
    got = [tuple(r) for r in token_codes.encoded_documents(df, TOKENIZER).orderBy("start").collect()]
    assert [x[0] for x in got] == [None, -1, 3, 3, 3] and [x[1] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1].tolist()]
    assert Counter(x[2] for x in got) == {2: 1, 1: 2, 3: 2}


@pytest.mark.parametrize("kind", ["small", "mixed", "equal", "wide", "one", "none"])
def test_segments_give_any_id(kind):
    rng = np.random.default_rng(1)
    ids = {"small": rng.integers(0, 2, 3000), "mixed": rng.integers(0, 1 << rng.integers(1, 17, 5000)), "equal": np.full(700, 49_407), "wide": rng.integers(0, 2**32, 900), "one": np.array([7]), "none": np.array([])}[kind].astype(np.uint32)
    x = token_codes.Segment(b"ab" + token_codes.segment(4, 9, [1, None], [len(ids), 0], ids), 2)
    assert (x.ids() == ids).all() and [x[i] for i in range(0, len(ids), 7)] == ids[::7].tolist() and (x.part, x.before, x.n_ids, x.null.tolist()) == (4, 9, len(ids), [False, True])
    with pytest.raises(IndexError):
        x[len(ids)]
    with pytest.raises(ValueError):
        token_codes.Segment(b"x" * 200)


def test_widths_need_the_fewest_bits():
    rng = np.random.default_rng(2)
    for top in (1, 3, 6):
        ids = rng.integers(0, 1 << rng.integers(1, top + 1, 400)).astype(np.uint32)
        size = lambda widths: sum(int((ids >> np.uint32(sum(widths[:k])) > 0).sum() if k else len(ids)) * (w + (k < len(widths) - 1)) for k, w in enumerate(widths))  # noqa: B023, E731
        bits = max(int(ids.max()).bit_length(), 1)
        every = [[b - a for a, b in zip((0, *c), (*c, bits), strict=True)] for c in ([k + 1 for k in range(bits - 1) if m >> k & 1] for m in range(1 << (bits - 1)))]
        assert size(token_codes.best_widths(ids)) == min(map(size, every))


# --- The trie.


def plain_trie(rows, rebuild):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    turns = {c: own.get(c - int(math.fmod(c, 20)), [])[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :] if rebuild else v for c, v in own.items()}
    nodes = {}
    for c, v in turns.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for k, m in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        ends = sorted(c for c in m if len(turns[c]) == len(k))
        children = sum(len(x) == len(k) + 1 for x in below)
        leaves = sum(not any(y[:-1] == x and y for y in below) for x in below)
        saved = sum((len(nodes[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children, leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "", "d  e\nf"])) for c in range(-3, 60) if c not in (20, 41) for t in range(rng.randint(1, 6))]
    rows += [(c, None, "user", "first of all") for c in (3, 5, 7)] + [(None, 1, "user", "nobody's")]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 140) for t in range(3 + c % 7)]  # copies, and prefixes of each other
    rows += [(200, t, "user", f"{t} long") for t in range(90)]
    return rng.sample(rows, len(rows))


@pytest.mark.parametrize(("most", "rebuild"), [(50_000, True), (7, True), (7, False), (40, False)])
def test_trie(spark, most, rebuild):
    rows = talks(4)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, base long, a string")
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df, rebuild, most).collect()), key=str)
    assert got == plain_trie(rows, rebuild)


def test_trie_of_nothing_and_of_repeated_rows(spark):
    ddl = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], ddl), True).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], ddl)).collect() == []
    rows = [(1, 0, "user", "x y")] * 3 + [(2, 0, "user", "x y")]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, ddl)).collect()), key=str)
    assert got == plain_trie(rows, False) and len(got) == 4
    # Conversation 3 takes all its turns, two at most, from conversation 0, which is absent, so that it is a member of the root alone.
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 20)}
    rows = [(c, t, "user", "x") for c in h for t in range(min(h[c], 2))]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, ddl), True).collect()), key=str)
    assert got == plain_trie(rows, True) and any(r[1] == 0 and r[3] > 1 for r in got)


# --- Importance resampling.


def plain_draw(docs, aims, n, buckets=10_000, least=20):
    def features(text):
        w = re.findall(importance.WORD, lower(text))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for m in range(1, n + 1) for i in range(len(w) - m + 1))

    own, source, target = [(i, *features(t)) for i, t in docs], Counter(), Counter()
    for _, _, c in own:
        source.update(c)
    for t in aims:
        target.update(features(t)[1])
    s, t = source.total(), target.total()
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, words, c in own:
        weight = sum(gain[b] * m for b, m in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: 10 * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_draw(spark, n):
    rows = [(i, t) for i, t, *_ in corpus(60)] + [(300, "Ünï É-2x, o'clock 3.5\x00z " * 9), (301, "a b c d e f g h i j k l m n o p q r s t"), (None, "x " * 30)] + [(400 + i, t) for i, t in enumerate(ODD)]
    aims = ["gámma delta zeta", None, "", "alpha alpha b c d"]
    df = spark.createDataFrame([(*r, 3, 4, 5) for r in rows], "doc_id long, text string, id long, n_words long, rank long")
    got = importance.importance_resample(df, spark.createDataFrame([(t,) for t in aims], "text string"), n)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_draw(rows, aims, n)


def test_draw_without_documents_or_targets_and_with_repeats(spark):
    none = spark.createDataFrame([], DDL)
    assert importance.importance_resample(none, none).collect() == []
    rows = [(i % 40, f"word{i % 40} " * 25) for i in range(120)]
    got = importance.importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), none).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_draw(rows, [], 1) and sum(r["rank"] is not None for r in got) == 12


def test_features_are_counted_by_slices(spark, monkeypatch):
    rows = [(i, t) for i, t, *_ in corpus(20)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    want = sorted(tuple(r) for r in importance.bucket_counts(df).collect())
    monkeypatch.setattr(importance, "SLICE_BYTES", 100)
    assert sorted(tuple(r) for r in importance.bucket_counts(df).collect()) == want
