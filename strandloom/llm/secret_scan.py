"""Secret scans: fixed patterns, and a character convolutional network over every other candidate in its context.

Patterns find assignments, access keys and long hexadecimal runs. Every token that could be a key is scored by the
network from its characters and those around it and added as a finding of kind "net" at or above a threshold: runs of
token characters, dots included (JWT), and their parts between slashes, dots and inner equals signs; of addresses only the
parts. They need MIN_CANDIDATE characters, or MIN_NEAR after a key word or as the password of an address, and a letter with
a digit or a change from lower to upper case (letters of one case: MIN_LETTERS in a row). A token longer than INSIDE is scored
in windows that overlap by half; its highest score counts. Pattern findings are scored as well and kept at any score.

The network (embedding, one convolution, maxima over the candidate and over its context, one output) is in numpy. It
is trained here on labelled findings: those of the patterns in the corpus itself (at most CORPUS_FINDINGS, which hash
lowest), and FIT_FINDINGS made by a seeded generator: keys of many forms against mail addresses, links, numbers, dates,
names, file names and words. Three fifths fit the network, one fifth calibrates its output by a logistic curve, and on
the last one each kind gets its threshold: the highest up to SURE that keeps RECALL of the kind's positive ones there.
Pattern findings below the threshold of their kind stay, but are not counted as sure.

Defined cases: a null text counts as empty; an empty text has no findings; touching or repeated findings are all kept;
a candidate within a pattern's finding is not added again; of candidates that overlap, the longest found is kept.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_CANDIDATE, MIN_NEAR, MIN_LETTERS = 16, 8, 20
_RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % MIN_NEAR)
_ODD = re.compile(r"[0-9]|[a-z][A-Z]|[A-Za-z]{%d}" % MIN_LETTERS)
_LETTER = re.compile(r"[A-Za-z]")
_PART = re.compile(r"[^/.]+")
_VALUE = re.compile(r"[^=]+=*")
_NEAR = re.compile(r"(?:key|secret|token|passw|pwd|auth|bearer|credential|signature|sig|login)[a-z_]{0,12}[\"']?\s{0,3}(?:is|[:=])?\s{0,3}[\"']?\Z", re.I)
_USER = re.compile(r"://[^\s/@:]*:\Z")

BEFORE, INSIDE, AFTER = 24, 48, 12
LENGTH = BEFORE + INSIDE + AFTER
WIDTH, DIM, FILTERS = 5, 8, 24
FIT_FINDINGS = 9_600
CORPUS_FINDINGS = 1_500
#: A kind with fewer findings than this to judge by takes the threshold of all.
LEAST_FINDINGS = 20
RECALL = 0.98
#: The threshold is no higher, however well the findings held back are told apart.
SURE = 0.9
EPOCHS = 10


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Findings of the fixed patterns, by start and then by kind."""
    out, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [Span("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Span("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Places of tokens that could be keys and that no finding covers; parts come besides the token they are in."""
    out: list[tuple[int, int]] = []

    def add(start: int, end: int, least: int) -> None:
        while start < end and text[start] in "./=":
            start += 1
        while end > start and text[end - 1] in "./":
            end -= 1
        token = text[start:end]
        if len(token) >= least and _ODD.search(token) and _LETTER.search(token):
            if not any(s.start <= start and end <= s.end for s in taken):
                out.append((start, end))

    for m in _RUN.finditer(text):
        if not _ODD.search(m[0]):
            continue
        address = m[0].startswith("//") and text[m.start() - 1 : m.start()] == ":"
        for value in _VALUE.finditer(m[0]):
            start, end = m.start() + value.start(), m.start() + value.end()
            before = text[max(0, start - 32) : start]
            least = MIN_NEAR if _NEAR.search(before) or (text[end : end + 1] == "@" and _USER.search(before)) else MIN_CANDIDATE
            if end - start < least:
                continue
            if not address:
                add(start, end, least)
            if "/" in value[0]:
                for part in value[0].split("/"):
                    if part != value[0]:
                        add(start, start + len(part), least)
                    start += len(part) + 1
                start = m.start() + value.start()
            if "." in value[0]:
                for part in _PART.finditer(value[0]):
                    add(start + part.start(), start + part.end(), least)
    return sorted(set(out))


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Places of INSIDE characters or less that cover a candidate, each overlapping the next by half."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in (*range(start, end - INSIDE, INSIDE // 2), end - INSIDE)]


@lru_cache(maxsize=1)
def _codes() -> dict[str, int]:
    return {c: i + 2 for i, c in enumerate(string.digits + string.ascii_letters + string.punctuation + " \n\t")}


def encoded(text: str, start: int, end: int, window: tuple[int, int] | None = None) -> np.ndarray:
    """Codes of a window of the candidate (its first) and of what is around the candidate."""
    first, last = window or windows(start, end)[0]
    known = _codes().get
    row = np.zeros(LENGTH, np.int64)
    left = text[max(0, start - BEFORE) : start]
    for i, c in enumerate(left, BEFORE - len(left)):
        row[i] = known(c, 1)
    for i, c in enumerate(text[first:last], BEFORE):
        row[i] = known(c, 1)
    for i, c in enumerate(text[end : end + AFTER], BEFORE + INSIDE):
        row[i] = known(c, 1)
    return row


class Network(NamedTuple):
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = {}  # noqa: RUF012

    def threshold(self, kind: str) -> float:
        return self.thresholds.get(kind, 0.5)

    def forward(self, rows: np.ndarray) -> tuple:
        e = self.embed[rows]
        windows = np.stack([e[:, k : LENGTH - WIDTH + 1 + k] for k in range(WIDTH)], 2).reshape(len(rows), LENGTH - WIDTH + 1, WIDTH * DIM)
        z = windows @ self.conv + self.bias
        a = np.maximum(z, 0)
        inner = slice(BEFORE, BEFORE + INSIDE - WIDTH + 1)
        top, where = a[:, inner].max(1), a[:, inner].argmax(1) + BEFORE
        side, side_at = a[:, : BEFORE - 1].max(1), a[:, : BEFORE - 1].argmax(1)
        mean = a[:, inner].mean(1)
        h = np.concatenate([top, side, mean], 1)
        return windows, a, where, side_at, h, h @ self.out + self.out_bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        logit = np.concatenate([self.forward(rows[i : i + 256])[-1] for i in range(0, len(rows), 256)])
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))


def labelled_findings(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Encoded candidates with labels (1: a secret), made by a seeded generator."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    letters, digits = string.ascii_lowercase, string.digits
    word = lambda: pick(letters, int(rng.integers(2, 9)))
    names = ("key", "auth", "bearer", "credential", "private_key", "client", "access", "signature", "pwd", "conn", "sig", "Authorization", "AWS_SECRET", "x-api")
    rows, marks = [], []
    for i in range(n):
        size, secret = int(rng.integers(20, 65)), i % 2 == 0
        before = " ".join(word() for _ in range(4)) + " "
        if secret:
            form, after = int(rng.integers(0, 9)), ""
            if form == 0:
                token = pick(string.ascii_letters + digits, size)
            elif form == 1:
                token = pick(string.ascii_letters + digits + "+/", size) + rng.choice(["", "=", "=="])
            elif form == 2:
                token = str(rng.choice(["ghp_", "sk-", "xoxb-", "pk_live_", "AIza", "glpat-"])) + pick(string.ascii_letters + digits, max(20, size - 6))
            elif form == 3:
                token = pick("0123456789ABCDEF", max(24, size))
            elif form == 4:
                token = pick(string.ascii_letters + digits + "-_", size)
            elif form == 5:
                url_safe = string.ascii_letters + digits + "-_"
                token = "eyJ" + pick(url_safe, int(rng.integers(15, 40))) + ".eyJ" + pick(url_safe, int(rng.integers(20, 120))) + "." + pick(url_safe, int(rng.integers(27, 86)))
            elif form == 6:
                token = str(rng.choice(["SG", "v1", "pk", "hvs", word()])) + "." + pick(string.ascii_letters + digits + "-_", int(rng.integers(16, 30))) + "." + pick(string.ascii_letters + digits + "-_", int(rng.integers(16, 44)))
            elif form == 7:
                token = pick(string.ascii_letters + digits, int(rng.integers(16, 44)))
                before += f"https://{word()}.{word()}.com/{word()}/"
                if rng.random() < 0.5:
                    before += f"T{pick(string.ascii_uppercase + digits, 8)}/B{pick(string.ascii_uppercase + digits, 8)}/"
            elif rng.random() < 0.5:
                token, after = pick(string.ascii_letters + digits, int(rng.integers(10, 24))), "@" + word() + str(rng.choice([".com/", ":5432/", "/"])) + word()
                before += f"{rng.choice(['postgres', 'mysql', 'redis', 'https', 'amqp'])}://{word()}:"
            else:
                token = pick(string.ascii_letters + digits, int(rng.integers(10, 20)))
                before += str(rng.choice(names)) + str(rng.choice([" = ", ": ", "=", ' = "', " "]))
            if form < 7 and rng.random() < 0.6:
                before += str(rng.choice(names)) + str(rng.choice([" = ", ": ", "=", ' = "', " "]))
        else:
            form, after = int(rng.integers(0, 14)), ""
            if form == 0:
                token = pick(digits, 10) + word() + word() + word()
                after = str(rng.choice(["", f"@{word()}.com"]))
            elif form == 1:
                token = "-".join([word() for _ in range(5)] + [pick(digits, int(rng.integers(1, 5)))])
            elif form == 2:
                token = "/" + "/".join(word() for _ in range(5)) + pick(digits, 2)
            elif form == 3:
                token = "_".join(word() for _ in range(5)) + f"_v{rng.integers(0, 99)}"
            elif form == 4:
                token = "".join(word().capitalize() for _ in range(5)) + pick(digits, int(rng.integers(1, 4)))
            elif form == 5:
                token = f"20{rng.integers(10, 30)}-{rng.integers(1, 12):02d}-{rng.integers(1, 28):02d}T{rng.integers(0, 23):02d}-{rng.integers(0, 59):02d}-{rng.integers(0, 59):02d}Z"
            elif form == 6:
                token = word() + "=" * int(rng.integers(12, 30)) + pick(digits, 2)
            elif form == 7:
                token = (word() + pick(digits, 1)) * int(rng.integers(6, 9))
            elif form == 8:
                token, after = str(rng.choice([".", "_", "-"])).join(word() for _ in range(int(rng.integers(2, 5)))) + pick(digits, int(rng.integers(0, 4))), f"@{word()}.{word()}.org"
            elif form == 9:
                token = ".".join(word() for _ in range(int(rng.integers(3, 7)))) + str(rng.choice([".com", ".V2", f".{word().capitalize()}{pick(digits, 2)}", "-1.10.3.tar"]))
            elif form == 10:
                token = str(rng.choice(["-", "_"])).join([word() for _ in range(int(rng.integers(3, 7)))] + [pick(digits, int(rng.integers(1, 6)))])
                before += f"https://www.{word()}.org/{word()}/"
            elif form == 11:
                token = "".join(word() for _ in range(int(rng.integers(5, 30)))) if rng.random() < 0.5 else "".join(word().capitalize() for _ in range(int(rng.integers(4, 9))))
            elif form == 12:
                token = pick("ACGT", size)
            else:
                token = str(rng.choice([f"chapter{pick(digits, 2)}", f"{word()}{word()}20{pick(digits, 2)}", f"{word()}.{word()}{pick(digits, 1)}", f"{word()}-{word()}-{pick(digits, 1)}"]))
                before += str(rng.choice(names)) + str(rng.choice([" = ", ": ", "=", " is ", " "]))
            least = MIN_NEAR if form == 13 else MIN_CANDIDATE
            token = token if len(token) >= least else token + "-" + "-".join(word() for _ in range(5))
        text = before + token + after + str(rng.choice([" ", '" ', ". ", "\n", ", "])) + " ".join(word() for _ in range(3))
        parts = windows(len(before), len(before) + len(token))
        rows.append(encoded(text, len(before), len(before) + len(token), parts[int(rng.integers(0, len(parts)))]))
        marks.append(float(secret))
    return np.stack(rows), np.array(marks)


class Example(NamedTuple):
    """A finding with what is around it."""

    kind: str
    before: str
    token: str
    after: str


def corpus_findings(docs: DataFrame, text: str = "text", most: int = CORPUS_FINDINGS) -> tuple[Example, ...]:
    """Findings of the patterns, at most `most`, those that hash lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("text"):
                found = value.as_py()
                rows = [(s.kind, found[max(0, s.start - BEFORE) : s.start], found[s.start : s.end], found[s.end : s.end + AFTER]) for s in base_spans(found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], list(Example._fields))

    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text"))
    rows = rows.mapInArrow(run, ", ".join(f"{c} string" for c in Example._fields))
    best = rows.orderBy(F.xxhash64(*Example._fields), *Example._fields).limit(most)
    return tuple(Example(*r) for r in best.collect())  # at most `most` rows


@lru_cache(maxsize=4)
def trained(examples: tuple[Example, ...] = ()) -> Network:
    """The network fitted by Adam, calibrated, and given its thresholds on a part of its own."""
    rows, marks = labelled_findings(FIT_FINDINGS)
    kinds = ["net"] * len(rows)
    if examples:
        more = []
        for e in examples:
            text, start, end = e.before + e.token + e.after, len(e.before), len(e.before) + len(e.token)
            more.append(encoded(text, start, end))
        rows, marks, kinds = np.concatenate([rows, np.stack(more)]), np.append(marks, np.ones(len(more))), kinds + [e.kind for e in examples]
    mixed = np.random.default_rng(13).permutation(len(rows))
    rows, marks, kinds = rows[mixed], marks[mixed], np.array(kinds)[mixed]
    cut, last = len(rows) * 3 // 5, len(rows) * 4 // 5
    rng = np.random.default_rng(11)
    p = [rng.normal(0, 0.3, (len(_codes()) + 2, DIM)), rng.normal(0, 0.15, (WIDTH * DIM, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 3 * FILTERS), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(cut)
        for at in range(0, cut, 64):
            part = order[at : at + 64]
            x, y = rows[part], marks[part]
            windows, a, where, side_at, h, logit = Network(*p[:4], p[4][0]).forward(x)
            d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(part)
            dh = d[:, None] * p[3]
            da, b, f = np.zeros_like(a), np.arange(len(part))[:, None], np.arange(FILTERS)[None, :]
            n = INSIDE - WIDTH + 1
            da[:, BEFORE : BEFORE + n] += dh[:, None, 2 * FILTERS :] / n
            np.add.at(da, (b, where, f), dh[:, :FILTERS])
            np.add.at(da, (b, side_at, f), dh[:, FILTERS : 2 * FILTERS])
            da *= a > 0
            flat_d, flat_w = da.reshape(-1, FILTERS), windows.reshape(-1, WIDTH * DIM)
            back = (flat_d @ p[1].T).reshape(len(part), LENGTH - WIDTH + 1, WIDTH, DIM)
            de, ge = np.zeros((len(part), LENGTH, DIM)), np.zeros_like(p[0])
            for k in range(WIDTH):
                de[:, k : LENGTH - WIDTH + 1 + k] += back[:, :, k]
            np.add.at(ge, x, de)
            grads, t = [ge, flat_w.T @ flat_d, flat_d.sum(0), h.T @ d, np.array([d.sum()])], t + 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(*p[:4], float(p[4][0]))
    held, truth = rows[cut:last], marks[cut:last]
    logit, w = net.forward(held)[-1], np.array([1.0, 0.0])
    x = np.stack([logit, np.ones_like(logit)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.clip(np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(2), x.T @ (q - truth) + 0.5 * (w - [1, 0])), -1, 1)
    net = net._replace(slope=float(w[0]), shift=float(w[1]))
    scores, right = net.scores(rows[last:]), marks[last:] == 1
    keep = lambda found: min(SURE, float(np.sort(found)[int((1 - RECALL) * len(found))]))
    thresholds = {}
    for kind in (*KINDS, "net"):
        own = scores[right & (kinds[last:] == kind)]
        thresholds[kind] = keep(own if len(own) >= LEAST_FINDINGS else scores[right])
    return net._replace(thresholds=thresholds)


class Findings(NamedTuple):
    """The patterns' findings and all findings, by start, the latter with their scores."""

    base: list[Span]
    every: list[Span]
    scores: list[float]


def token_scores(places: list[tuple[str, int, int]], net: Network) -> np.ndarray:
    """For each (text, start, end) the highest score of its windows."""
    out, rows, owner = np.zeros(len(places)), [], []

    def flush() -> None:
        if rows:
            np.maximum.at(out, owner, net.scores(np.stack(rows)))
            rows.clear()
            owner.clear()

    for k, (text, start, end) in enumerate(places):
        for window in windows(start, end):
            rows.append(encoded(text, start, end, window))
            owner.append(k)
            if len(rows) == 4096:
                flush()
    flush()
    return out


def scored(texts: list[str | None], net: Network) -> list[Findings]:
    """Each text's findings."""
    base = [base_spans(t or "") for t in texts]
    more = [candidates(t or "", found) for t, found in zip(texts, base)]
    scores = iter(token_scores([(t or "", a, b) for t, found, own in zip(texts, base, more) for a, b in [x[1:] for x in found] + own], net).tolist())
    out = []
    for found, own in zip(base, more):
        rows = [(s, next(scores)) for s in found]
        hits = [x for x in [(Span("net", a, b), next(scores)) for a, b in own] if x[1] >= net.threshold("net")]
        kept: list[tuple[Span, float]] = []
        for s, score in sorted(hits, key=lambda x: (x[0].start - x[0].end, x[0].start)):
            if not any(k.start < s.end and s.start < k.end for k, _ in kept):
                kept.append((s, score))
        rows = sorted(rows + kept, key=lambda x: (x[0].start, (*KINDS, "net").index(x[0].kind)))
        out.append(Findings(found, [s for s, _ in rows], [score for _, score in rows]))
    return out


def findings(texts: list[str | None], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' findings and all findings, by start."""
    return [(f.base, f.every) for f in scored(texts, net)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_net, the scores of the spans and n_sure of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(corpus_findings(docs, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], [], []]
            for a in range(0, batch.num_rows, 200):
                for base, every, scores in scored(batch.column("text").slice(a, 200).to_pylist(), net):
                    kinds = [s.kind for s in base]
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    sure = sum(x >= net.threshold(s.kind) for s, x in zip(every, scores))
                    for column, value in zip(out, (*map(kinds.count, KINDS), digest, joined(every), len(every) - len(base), ",".join(f"{x:.3f}" for x in scores), sure)):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, types)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_net", "scores", "n_sure"])

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long, scores string, n_sure long")


def redacted_text(text: str | None, spans: list[Span]) -> str | None:
    """The text with every finding replaced by the name of its kind."""
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text: str = "text") -> Column:
    """The text column of docs with findings replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(corpus_findings(docs, text)))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        values, out = [None if t is None or t is pd.NA else t for t in texts], []
        for a in range(0, len(values), 200):
            part = values[a : a + 200]
            out += [redacted_text(t, every) for t, (_, every) in zip(part, findings(part, shared.value))]
        return pd.Series(out, dtype=object)

    return run(F.col(f"`{text}`"))
