"""Fixtures and plain versions for the tests of the llm operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def corpus(n=60, seed=5):
    """Invented documents with copies, near copies, nulls, empty and blank texts, odd spaces and a very long text."""
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice(["Alpha", "beta", "gámma", "delta,", "eps", "zeta.", "x1", "ETA"]) + rng.choice(["", "", "s", "t"]) for _ in range(k))
    texts = [some(rng.randint(3, 120)) for _ in range(n)]
    base = some(200)
    for k in range(12):
        w = base.split(" ")
        for _ in range(k):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 999)}"
        texts.append(" ".join(w))
    texts += [base] * 5 + [None, "", "   \n\t", "one", "one", "two words", "Two  Words", "a b\u00a0c d", some(30_000), "tie\ntie\ntie"]
    return [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
