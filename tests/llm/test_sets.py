"""Joins, line dedup, mixing, packing, URL rules, language model and neighbours against plain versions."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from llm.helpers import DDL, corpus, words
from tokenizers import Tokenizer

from fieldloom.llm import ann, brown_lm, line_dedup, mixing, ngram_join, packing, url_filter
from fieldloom.llm.common import Words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def grams(t, n):
    w = words(t)
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_components(rows, n, percent):
    sets = [grams(r[1], n) for r in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                group[max(p, q)] = min(p, q)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components(spark, n, percent):
    rows = corpus(25)
    rows += rows[:3] + [(500 + k, rows[-1][1], "en", "a", 1) for k in range(4)]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS node", "2 AS keys", "3 AS component_id")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(df, n, percent).collect())
    assert got == plain_components(rows, n, percent)
    if n == 5:
        one = ngram_join.one_of_each(df)
        assert one.columns == df.columns and sorted(r.doc_id for r in one.collect()) == sorted({d for d, _, c in got if d == c})


def linked_pairs(seed, n):
    """Pairs of sets that link, of many sizes, tokens in all of the hash range or crowded in a part of it, and what they need to be alike in percent."""
    rng = np.random.default_rng(seed)
    for k in range(n):
        percent, size = (80, 90)[k % 2], int(rng.integers(1, 13) if k % 3 else rng.integers(1, 300 if k % 7 == 0 else 60))
        low = rng.random() * 0.9
        crowd = lambda m, low=low, high=low + rng.random() * (1 - low): (rng.uniform(low, high, m) * 2.0**64 * 0.999999).astype(np.uint64)
        x = np.unique(crowd(size) if k % 5 else rng.integers(0, 2**64, size, dtype=np.uint64))
        apart = int(len(x) * (100 - percent) / 100 + 2)
        rest = rng.permutation(x)[min(int(rng.integers(0, apart)), len(x) - 1) :]
        y = np.unique(np.concatenate([rest, (crowd if k % 2 else lambda m: rng.integers(0, 2**64, m, dtype=np.uint64))(int(rng.integers(0, apart)))]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= percent * (len(x) + len(y) - both):
            yield percent, x, y


def test_links_have_a_common_key():
    found = 0
    for percent, x, y in linked_pairs(3, 40_000):
        (a, least), (b, other) = ngram_join.keys_of(x, percent), ngram_join.keys_of(y, percent)
        assert len(set(a.tolist()) & set(b.tolist())) >= max(1, least, other)
        found += 1
    assert found > 10_000


def test_links_of_all_fillings_of_parts():
    """Small sets by how many tokens fall into each part: every way to fill them, and every token that may be missing."""
    for percent in (80, 90):
        for size in range(1, 13):
            apart, parts, _ = ngram_join.parts_of(ngram_join.band_of(size), percent)
            for filling in itertools.islice(itertools.combinations_with_replacement(range(parts), size), 3000):
                many = Counter(filling)
                x = np.sort(np.array([int((p + (k + 0.5) / 16) * 2**64 / parts) for p, m in many.items() for k in range(m)], np.uint64))
                a, least = ngram_join.keys_of(x, percent)
                own = set(a.tolist())
                for lost in range(len(x)) if 100 * (size - 1) >= percent * size else ():
                    b, other = ngram_join.keys_of(np.delete(x, lost), percent)
                    assert len(own & set(b.tolist())) >= max(1, least, other)


def test_short_documents_keep_their_links(spark):
    rng = random.Random(9)
    rows = [(1, "cfhma bnbjg mmfdm ggemo enaio gichn noggk ibgfl"), (2, "cfhma bnbjg mmfdm ggemo enaio gichn noggk ibgfl dnlej")]
    for k in range(1000):
        w = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(rng.randint(3, 14))]
        rows += [(10 + 2 * k, " ".join(w)), (11 + 2 * k, " ".join(w[rng.randint(0, 1) :] + [f"x{k}"] * rng.randint(0, 1)))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect())
    assert got[1] == (2, 5, 1) and got == plain_components(rows, 5, 80)


def test_long_lines_take_linear_time(spark):
    took = {}
    for n in (10_000, 10_000, 100_000, 1_000_000):
        x = "".join(f"{i:x} " for i in range(n // 4))[:n]
        rows = [(1, x + "a"), (2, "other line that is long enough\n" + x + "b"), (3, x[:-3] + "x" + x[-2:] + "b"), (4, x[1:] + "a"), (5, x + "bcd")]
        began = time.time()
        got = {r.doc_id: r["n_dropped"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect()}
        took[n] = time.time() - began
        assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}
    assert took[1_000_000] < 12 * (took[100_000] + 2)


def test_texts_of_many_lines_take_linear_time(spark):
    x = "\n".join(f"a line with a number of its own {i}x{i * 7919}" for i in range(20_000))
    began = time.time()
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame([(1, x), (2, x)], "doc_id long, text string"), short=True).collect()}
    assert got == {1: got[1], 2: 20_000} and time.time() - began < 60


def test_one_edit_of_long_lines(spark):
    rng, rows = random.Random(4), []
    for _ in range(300):
        a = "".join(rng.choice("abü漢") for _ in range(rng.randint(0, 8))) * rng.choice([1, 60])
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice([[], ["x"], ["a"]])
        rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.within_one_edit("a", "b").alias("near")).collect()

    def plain(a, b):
        return a == b or any(a[:k] + a[k + 1 :] == b for k in range(len(a))) or any(b[:k] + b[k + 1 :] == a for k in range(len(b))) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)

    assert all(r.near == plain(r.a, r.b) for r in got) and {r.near for r in got} == {True, False}


def test_long_words_stay_apart(spark):
    for n in (4095, 4096, 9000):
        one, two = f"x{'a' * n}y", f"y{'a' * n}x"
        rows = [(0, f"{one} b c"), (1, f"{two} b c"), (2, f"{one} b c"), (None, two)]
        if n == 4095:
            got = sorted(tuple(r)[:3] for r in ngram_join.jaccard_join(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect())
            assert got == [(0, 1, 0), (1, 1, 1), (2, 1, 0)]
        assert len({*Words([one.encode(), two.encode()], lower=True).hashes.tolist()}) == 2
        whole, own = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
        assert [x.tolist() for x in own.encode([one, two])] == [whole.encode(t, add_special_tokens=False).ids for t in (one, two)]


def test_links_between_groups_join_components():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
    sets = [np.sort(np.concatenate([np.delete(base, rng.choice(60, k, replace=False)), rng.integers(0, 2**64, k, dtype=np.uint64)])) for k in [0, 1, 2, 3, 4, 6, 9, 20] * 2]
    group = lambda at: (np.array(at), np.array(at), np.array([len(sets[i]) for i in at]), pa.array([sets[i].view(np.int64) for i in at]))
    for left, right in (([*range(8)], [*range(8, 16)]), ([*range(16)], [*range(16)])):
        got = ngram_join.links_between(group(left), group(right), 90)
        want = {(i, j) for i in left for j in right if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
        assert set(got) <= want

        def parts(pairs):
            label = list(range(16))
            for _ in range(16):
                for a, b in pairs:
                    label[a] = label[b] = min(label[a], label[b])
            return label

        assert parts(got) == parts(want)


def test_one_of_each_with_repeated_and_null_ids(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z "
    rows = [(1, text), (1, "other words " * 9), (1, text), (2, text + "end"), (None, text), (None, "alone in the world of ids"), (3, None), (3, ""), (3, ""), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS id", "1 AS rows", "2 AS Node")
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    want = [(1, text), (1, "other words " * 9), (None, "alone in the world of ids"), (3, None), (3, ""), (4, " ")]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(want, key=key)


def test_empty_join(spark):
    assert ngram_join.jaccard_join(spark.createDataFrame([], DDL)).count() == 0


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def test_line_dedup(spark):
    rng = random.Random(4)
    line = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 40)))
    pool = [line() for _ in range(30)]
    for x in pool[:20]:
        k = rng.randrange(len(x))
        pool += [x[:k] + "Z" + x[k + rng.choice([0, 1]) :], x[:k] + x[k + 1 :]]
    rows = [(i, "\n".join(rng.choice([*pool, "short", ""]) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n")]
    df = spark.createDataFrame([(i, t, 1, "k", "d") for i, t in rows], "doc_id long, text string, pos int, line string, drops string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    before = []
    for i, t in rows:
        kept = []
        for x in (t or "").split("\n"):
            if len(x) < line_dedup.MIN_CHARS or not any(near(x, y) for y in before):
                kept.append(x)
            if len(x) >= line_dedup.MIN_CHARS:
                before.append(x)
        assert got[i].text == (None if t is None else "\n".join(kept)), i
        assert got[i]["n_dropped"] == (0 if t is None else t.count("\n") + 1 - len(kept))
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([1, 5, 20, 400]), "en", rng.choice(["a", "b", "c", "d", "e", None, "big", "big", "big"]), 1) for i in range(900)] + [(5000, None, "en", "z", 0), (5001, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS size", "2 AS bucket", "3 AS target")
    got = mixing.mix_plan(df, [5, 2, 1]).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    names = [*sorted(x for x in size if x is not None), None]
    weight = {x: [5, 2, 1][i % 3] for i, x in enumerate(names)}
    total, full, target = sum(size.values()), set(), {}
    while True:
        left = total - sum(3 * size[x] for x in full)
        target = {x: 3.0 * size[x] if x in full else left * weight[x] / sum(weight[y] for y in names if y not in full) for x in names}
        over = {x for x in names if x not in full and target[x] > 3 * size[x]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.source_size == size[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[x] - target[x]) <= max(0.011 * size[x], 210) for x in names)
    again = {(r.doc_id, r.taken) for r in mixing.mix_plan(df.repartition(7), [5, 2, 1]).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    mixed = mixing.mix(df, [5, 2, 1])
    assert mixed.columns == df.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mix_plan(df.limit(0), [5, 2, 1]).count() == 0


ODD = ["", "a", "don't we'll 's  'sx it's'", "  lead  two\n\nx  ", "'re\n'll 've'd a'm", "123abc 45 é中文字 ½", "a<|endoftext|>b", "!!! ??' 't", "\x1c\x1d a", "\u0085x", "I'M 'S", "''s", "'"]


def test_encoder_is_the_tokenizer():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\t'aslltre1é.- ") for _ in range(rng.randint(1, 40))) for _ in range(800)] + ["word " * 30_000]
    whole, own = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_round_trip(spark):
    rows = corpus(40)
    rows += rows[:2]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS start", "2 AS salt", "3 AS sequence_id")
    pieces = packing.pack_documents(df, TOKENIZER).collect()
    whole = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in rows:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for p in {(p.start, p.length) for p in pieces if p.doc_id == r[0]}:
            want[r[0], *p, zlib.crc32(np.array(ids[p[0] : p[0] + p[1]], "<u4").tobytes()), len(ids)] += 1
        assert sum(p.length for p in pieces if p.doc_id == r[0]) == len(ids) * sum(x[0] == r[0] for x in rows)
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(df.limit(0), TOKENIZER).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(2)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 129, 20_000), return_counts=True), strict=True)}
    plan = packing.plan(histogram, 256)
    placed = Counter()
    for pattern, times in plan:
        assert sum(c * n for c, n in pattern.items()) <= 256 and times > 0
        for c, n in pattern.items():
            placed[c] += n * times
    assert placed == histogram
    assert sum(t for _, t in plan) <= 1.005 * sum(c * n for c, n in histogram.items()) / 256 + 2


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h), len(p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "http://COM", "http://com/", "https://www.Example.com/en/x?y#z", "http://example.com/en", "http://example.com/en/", "http://a.b.example.com/en/q/r/s", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/fr/?a", "http://x.net#/fr/", "http://x.net?/fr/", "ftp://.com/", "x://y://com/", "http://a.com//en/", "http://" + "a." * 300 + "com/" + "b/" * 3000]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, salt int")
    got = url_filter.url_filter(df, url_filter.rules_table(spark)).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert tuple(r)[1:] == plain_rule(urls[r.page_id])
    odd = url_filter.url_filter(df, url_filter.rules_table(spark, [("com", "/e", "block"), ("com", "", "allow")]))
    assert {r.rule for r in odd.collect() if r.page_id in (6, 7)} == {"com/e"} and all(r.rule == "com" for r in odd.collect() if r.page_id == 4)
    assert {r.verdict for r in url_filter.url_filter(df, url_filter.rules_table(spark).limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("sent", [1 << 19, 5])
def test_language_model(spark, sent):
    rows = corpus(40)
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS row", "2 AS n_tokens")
    count, ends = Counter(), 0
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 5 != 1:
            count.update(words(r[1]))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    got = brown_lm.lm_scores(df, sent_words=sent).collect()
    for r in got:
        w = words(rows[r.doc_id][1])
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert brown_lm.lm_scores(df.limit(0)).count() == 0


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(0)
    bigrams = np.zeros((21, 21))
    for _ in range(8000):
        a = rng.integers(0, 10)
        bigrams[a, 10 + rng.integers(0, 10)] += 1
        bigrams[10 + rng.integers(0, 10), rng.integers(0, 10)] += 1
    of = brown_lm.exchange(bigrams, 3)
    assert len(set(of[:10])) == len(set(of[10:20])) == 1 and of[0] != of[10] and of[20] == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (1500, 16)) * rng.uniform(0.2, 3, (1500, 1))
    x[200:230] = x[0]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] + [1.0] * 15, 1), (2060, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (2080, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(df, block_rows=400, query_rows=30).toPandas()
    assert set(got.query_id) == {i for i in range(1500) if i % 20 == 0}
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id]) and q not in set(g.vec_id)
        hits += len(set(order) & set(g.vec_id))
    assert hits / (20 * got.query_id.nunique()) >= 0.9
    assert ann.nearest(df.limit(0)).count() == 0
