"""Secret scans: fixed patterns, and a character convolutional network over every candidate with its context.

Three patterns give the base findings. Every run of LEAST_RUN or more key-like characters is a candidate, inside base findings or
not, whatever it is made of; a convolutional network in numpy reads it with the characters around it and gives a calibrated
probability. It is trained on labelled findings (a seeded generator's by default; any list of text, start, end and label will
do): one part trains it, the other calibrates it by Platt scaling and sets the highest threshold that still finds `recall` of the
labelled secrets. Findings of the base always stay; of a candidate, what lies outside of them is read on its own and can be added.

Cases: a null or empty text has no findings. Texts are scanned whole, whatever their length; a candidate longer than the window is read
in overlapping windows, of which the highest counts. Repeated rows give repeated rows. Only the id and the text are read. Offsets count
code points. An empty table gives no rows; a null id stays null.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import batch, chunked, text_bytes

# The base's patterns, least lengths and the order of kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "network")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Least characters of a candidate.
LEAST_RUN = 12
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MAP = bytes(104 if x in b"0123456789abcdef" else 32 for x in range(256))


def base_findings(raw: bytes, text: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' findings that are long enough."""
    low = raw.lower()
    assign, access = any(k in low for k in _KEYWORDS), b"AKIA" in raw
    long_hex = b"h" * LEAST["hex"] in raw.translate(_HEX_MAP)
    if not (assign or access or long_hex):
        return []
    text = raw.decode() if text is None else text
    out = []
    if assign:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if access:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if long_hex:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether it can be added) of all runs of key-like characters, and of what findings leave of those that they overlap."""
    out, k, taken = [], 0, merged(taken)
    for m in CANDIDATE.finditer(text):
        a, e = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            out.append((a, e, True))
            continue
        out.append((a, e, False))
        at, i = a, k
        while i < len(taken) and taken[i][0] < e:
            if taken[i][0] - at >= LEAST_RUN:
                out.append((at, taken[i][0], True))
            at = taken[i][1]
            i += 1
        if e - at >= LEAST_RUN:
            out.append((at, e, True))
    return out


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, e, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


BEFORE, INSIDE, AFTER = 24, 48, 24
WIDTH = BEFORE + INSIDE + AFTER
_GROUPS = [string.digits, "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", " \t", "\n\r", "\"'`", "=:", "+/", "-", "_", "."]
CHANNELS = len(_GROUPS) + 3
_CLASS = np.full(128, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _i


def windows(items: list[tuple[str, int, int]]) -> np.ndarray:
    """One-hot character classes of each candidate and its context, with a channel that marks the candidate."""
    codes = np.full((len(items), WIDTH), len(_GROUPS) + 1)
    marks = np.zeros((len(items), WIDTH), np.float32)
    for i, (text, a, b) in enumerate(items):
        part = text[max(0, a - BEFORE) : a]
        shown = text[a : min(b, a + INSIDE)] + text[b : b + AFTER]
        own = np.fromiter(map(ord, part + shown), np.int64, len(part) + len(shown))
        at = BEFORE - len(part)
        codes[i, at : at + len(own)] = np.where(own < 128, _CLASS[np.minimum(own, 127)], len(_GROUPS))
        marks[i, BEFORE : BEFORE + min(b - a, INSIDE)] = 1
    out = np.zeros((len(items), WIDTH, CHANNELS), np.float32)
    np.put_along_axis(out, codes[:, :, None], 1, axis=2)
    out[:, :, -1] = marks
    return out


class Network:
    """Convolution, rectifier, maximum and mean over the window, one hidden layer and a logit."""

    SPAN, FILTERS, HIDDEN = 5, 24, 24

    def __init__(self, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *n: (rng.standard_normal(n) * np.sqrt(2 / n[0])).astype(np.float32)
        self.w = {"conv": draw(self.SPAN * CHANNELS, self.FILTERS), "conv0": np.zeros(self.FILTERS, np.float32), "hidden": draw(2 * self.FILTERS, self.HIDDEN), "hidden0": np.zeros(self.HIDDEN, np.float32), "out": draw(self.HIDDEN, 1), "out0": np.zeros(1, np.float32)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        n = WIDTH - self.SPAN + 1
        cols = np.concatenate([x[:, k : k + n] for k in range(self.SPAN)], axis=2)
        conv = cols @ self.w["conv"] + self.w["conv0"]
        live = np.maximum(conv, 0)
        top = live.argmax(axis=1)
        pooled = np.concatenate([live.max(axis=1), live.mean(axis=1)], axis=1)
        hidden = np.maximum(pooled @ self.w["hidden"] + self.w["hidden0"], 0)
        return (hidden @ self.w["out"] + self.w["out0"])[:, 0], (cols, conv, top, pooled, hidden)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 3e-3, size: int = 128, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(p) for k, p in self.w.items()}, {k: np.zeros_like(p) for k, p in self.w.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), size):
                own = order[i : i + size]
                logit, (cols, conv, top, pooled, hidden) = self._forward(x[own])
                d = ((1 / (1 + np.exp(-logit)) - y[own]) / len(own)).astype(np.float32)[:, None]
                g = {"out": hidden.T @ d, "out0": d.sum(axis=0)}
                dh = (d @ self.w["out"].T) * (hidden > 0)
                g |= {"hidden": pooled.T @ dh, "hidden0": dh.sum(axis=0)}
                dp = dh @ self.w["hidden"].T
                dc = np.repeat(dp[:, None, self.FILTERS :] / conv.shape[1], conv.shape[1], axis=1)
                np.put_along_axis(dc, top[:, None, :], np.take_along_axis(dc, top[:, None, :], axis=1) + dp[:, None, : self.FILTERS], axis=1)
                dc = dc * (conv > 0)
                g |= {"conv": cols.reshape(-1, cols.shape[2]).T @ dc.reshape(-1, self.FILTERS), "conv0": dc.sum(axis=(0, 1))}
                t += 1
                for k, p in self.w.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by gradient steps, then the highest threshold that keeps the recall."""
        z = self.logits(x).astype(float)
        a, b = 1.0, 0.0
        for _ in range(400):
            e = 1 / (1 + np.exp(-(a * z + b))) - y
            a, b = a - 0.05 * float((e * z).mean()), b - 0.05 * float(e.mean())
        self.scale, self.shift = a, b
        found = np.sort(self.probabilities(x)[y > 0])
        self.threshold = float(found[int(np.floor((1 - recall) * len(found)))])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(x) + self.shift)))

    def read(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        """The probability of each candidate (text, start, end): the highest of its windows, which overlap by half."""
        out = np.zeros(len(items))
        parts = [(i, (t, a, min(e, a + INSIDE))) for i, (t, s, e) in enumerate(items) for a in range(s, max(s + 1, e - INSIDE // 2), INSIDE // 2)]
        for k in range(0, len(parts), 512):
            own = parts[k : k + 512]
            np.maximum.at(out, [i for i, _ in own], self.probabilities(windows([w for _, w in own])))
        return out


def labelled_findings(n: int = 4000, seed: int = 42) -> list[tuple[str, int, int, int]]:
    """A seeded list of n (text, start, end, label): made-up keys as secrets, and names, dates, numbers and paths as others."""
    rng = random.Random(seed)
    some = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    alnum, base64, lower, upper = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase, string.ascii_uppercase
    word = lambda: some(lower, 2, 9)
    long = lambda: "".join(rng.choice(["th", "an", "er", "en", "ich", "tion", "re", "sch", "ed", "ou", "os", "ble", "in", "ado", "que", "lich", "pa", "le", "ver"]) for _ in range(rng.randint(4, 9)))
    spoken = lambda: "".join(rng.choice("bcdfghlmnpqrstvz") + rng.choice(["a", "e", "i", "o", "u", "ou", "ea", "ui"]) + rng.choice(["", "", "n", "r", "s", "l"]) for _ in range(rng.randint(4, 8)))
    day = lambda sep: f"{rng.randint(1990, 2030)}{sep}{rng.randint(1, 12):02}{sep}{rng.randint(1, 28):02}"
    secret = [
        lambda: some(base64, 32, 48),
        lambda: some(alnum, 20, 44),
        lambda: some(lower, 2, 3) + "_" + some(alnum, 24, 40),
        lambda: some(lower, 2, 2) + "_live_" + some(alnum, 20, 32),
        lambda: some(lower, 4, 4) + "-" + some(string.digits, 10, 12) + "-" + some(alnum, 20, 28),
        lambda: some("0123456789ABCDEF", 24, 64),
        lambda: some("0123456789abcdef", 32, 64),
        lambda: some(base64, 20, 60) + "=" * rng.randint(1, 2),
    ]
    other = [
        lambda: "-".join([word(), word(), day("-")]),
        lambda: "_".join([word(), word(), word(), some(string.digits, 1, 6)]),
        lambda: "/".join([word(), day("/"), word(), word()]),
        lambda: "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        lambda: some(upper, 2, 2) + some(string.digits, 16, 24),
        lambda: word() + word() + word() + some(string.digits, 1, 4),
        lambda: day("-") + "T" + some(string.digits, 6, 6) + "Z" + some(string.digits, 1, 3),
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + str(rng.randint(1, 2030)),
        lambda: "--" + word() + "-" + word() + "=" + some(string.digits, 1, 5),
        lambda: some(lower, 16, 30) + rng.choice(string.digits),
        lambda: long(),
        lambda: long().capitalize(),
        lambda: long().upper(),
        lambda: spoken().upper(),
        lambda: (word() + word() + word()).upper(),
        lambda: spoken(),
        lambda: long() + "-" + long(),
        lambda: some(string.digits, 12, 19),
    ]
    lead = ["key: ", "Authorization: Bearer ", "credentials = '", "token = \"", "access ", "export KEY=\"", "value: "]
    out = []
    while len(out) < n:
        label = rng.random() < 0.4
        body = rng.choice(secret if label else other)()
        before = " ".join(word() for _ in range(rng.randint(0, 6))) + " "
        if rng.random() < (0.5 if label else 0.1):
            before += rng.choice(lead)
        after = rng.choice(["", " ", "\n", ".", "' ", "\" "]) + " ".join(word() for _ in range(rng.randint(0, 4)))
        if len(body) >= LEAST_RUN:
            out.append((before + body + after, len(before), len(before) + len(body), int(label)))
    return out


def train(findings: list[tuple[str, int, int, int]], recall: float = 0.98, seed: int = 42) -> Network:
    """A network trained on three quarters of the findings, calibrated on the others."""
    x, y = windows([f[:3] for f in findings]), np.array([f[3] for f in findings], float)
    held = np.random.default_rng(seed).permutation(len(x)) % 4 == 0
    network = Network(seed)
    network.fit(x[~held], y[~held], seed=seed)
    network.calibrate(x[held], y[held], recall)
    return network


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_candidates", pa.int64()), ("n_confirmed", pa.int64())])
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_candidates long, n_confirmed long"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: list[tuple[str, int, int, int]] | None = None, recall: float = 0.98, seed: int = 42) -> DataFrame:
    """One row a row of docs: counts of the base's findings, the SHA-256 of their spelling, all spans, how many candidates the network read, and how many of those inside base findings it holds to be secrets too."""
    network = train(labelled_findings(seed=seed) if findings is None else findings, recall, seed)

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column(1))
            for i, j in chunked(texts):
                base = [base_findings(x) for x in texts[i:j]]
                items, owner, free = [], [], []
                for d, (raw, own) in enumerate(zip(texts[i:j], base, strict=True)):
                    text = raw.decode()
                    for a, e, f in candidates(text, own):
                        items.append((text, a, e))
                        owner.append(d)
                        free.append(f)
                added: list[list] = [[] for _ in base]
                read, confirmed = np.bincount(np.array(owner, int), minlength=len(base)), np.zeros(len(base), np.int64)
                for d, (_, a, e), f, p in zip(owner, items, free, network.read(items), strict=True):
                    if p >= network.threshold:
                        if f:
                            added[d].append((a, e, "network"))
                        else:
                            confirmed[d] += 1
                count = lambda kind: [sum(s[2] == kind for s in x) for x in base]  # noqa: B023, E731
                yield batch(_SCHEMA, b.column(0).slice(i, j - i), count("assign"), count("access"), count("hex"), [hashlib.sha256(spelled(x).encode()).hexdigest() for x in base], [spelled(x + y) for x, y in zip(base, added, strict=True)], read, confirmed)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DDL)
