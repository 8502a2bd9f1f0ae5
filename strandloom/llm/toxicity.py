"""Toxicity: a weighted finite-state grammar over clauses.

Five acceptors read the classes of a clause's words: insults and threats carry weights, a target nearby strengthens
them, a negation shortly before or reported speech weakens them. A verb of violence alone weighs little; with an intent before
it and a person as its object ("will kill you", "werde dich töten") it is a threat, unless denied or reported. Their product is compiled once into one automaton.
A clause scores by what the automaton collects on its words, a document by its strongest clauses.

The insult lexicon and its weights are learned from labels: words, and stems that head many invented forms, that occur
far more often in documents labelled toxic, and the weight of a threat, as that of an entry that barely qualifies changed by
what the labels say of documents with threats, from at most FIT_ROWS labelled rows (those whose id hashes lowest). A
logistic curve fitted on a part of them held back from the lexicon turns clause weights into scores.

Defined cases: null and empty texts get the score of a text without any hit; without usable labels only the fixed
lexicon counts; repeated rows are scored each; no column but the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the lexicon and the curve are fitted on, at most.
FIT_ROWS = 12_000
FOLDS = 5
#: A lexicon entry must occur in so many documents labelled toxic, and in such a share of those that it occurs in.
MIN_DOCUMENTS = 4
MIN_PURITY = 0.8
STEMS = (4, 5, 6, 7)
MIN_WORD = 4

# Words that mark targets, negation, reported speech and threats, in four languages.
TARGETS = frozenset("you yourself u du ihr tu toi vous tú usted ustedes vosotros".split())
OBJECTS = frozenset("dich dir euch te os".split())
OWNERS = frozenset("your yours dein deine votre vos ton ta tus".split())
INTENTS = frozenset("will i'll we'll they'll gonna going shall should must want werde werden wird sollte vais va allons voy vamos quiero".split())
NEGATIONS = frozenset("not no never nor isn't aren't don't wasn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ni tampoco".split())
REPORTS = frozenset("said says saying told called wrote quoted claims claimed reported sagte sagt nannte schrieb behauptet dit appelle écrit affirme dijo dice llamó escribió".split())
THREATS = frozenset("kill killing murder shoot stab hang strangle hurt destroy töten umbringen erschießen tuer assassiner étrangler matar asesinar".split())

_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSES = re.compile(r"[.,;:!?|\n]+")
_NEGATION_REACH = 3
#: Words within which a threat's verb follows its intent, and its object the verb.
_THREAT_REACH = 3
THREAT = 4.0


KINDS = ("insult", "threat", "target", "object", "owner", "intent", "negation", "report", "other")


class Acceptor(NamedTuple):
    """A weighted automaton that starts in state 0; words of kinds without an arc leave its state.

    hits: kinds whose words carry weight; factors: what a state puts on that weight; bonuses: what an arc adds.
    """

    hits: frozenset[str]
    arcs: dict[tuple[int, str], int]
    factors: dict[int, float]
    bonuses: dict[tuple[int, str], float]


def _threats(weight: float) -> Acceptor:
    """Intent, verb, person; or intent, object, verb. Each step lies within reach of the one before."""
    intent, object_, verb, denied, told = ([0, *range(k * 10 + 1, k * 10 + _THREAT_REACH + 1)] for k in range(1, 6))
    arcs: dict[tuple[int, str], int] = {}
    for steps in (intent, object_, verb, denied):
        for now, after in zip(steps[1:], [0, *steps[1:]]):
            arcs |= {(now, k): after for k in KINDS}
    for now in (0, *intent[1:], *object_[1:], *verb[1:]):
        arcs |= {(now, "intent"): intent[-1], (now, "report"): told[-1], (now, "negation"): denied[-1]}
    for now in denied[1:]:
        arcs |= {(now, "report"): told[-1], (now, "negation"): denied[-1]}
    for now in intent[1:]:
        arcs |= {(now, "object"): object_[-1], (now, "threat"): verb[-1]}
    bonuses = {(now, k): weight for now in verb[1:] for k in ("target", "object")} | {(now, "threat"): weight for now in object_[1:]}
    return Acceptor(frozenset(["threat"]), arcs | {key: 0 for key in bonuses}, {}, bonuses)


def _acceptors(threat: float = THREAT) -> tuple[Acceptor, ...]:
    """Insults, threats, targets, negation and reported speech, each with a table of its own."""
    none: frozenset[str] = frozenset()
    insults = Acceptor(frozenset(["insult"]), {}, {}, {})
    threats = _threats(threat)
    # 1: a hit that no target went before; 2: a target was named
    named = ("target", "object", "owner")
    targets = Acceptor(none, {(0, "insult"): 1, (0, "threat"): 1, **{(q, k): 2 for q in (0, 1) for k in named}}, {2: 1.25}, {(1, k): 0.5 for k in named})
    # the state counts the words that a negation still reaches
    within = range(1, _NEGATION_REACH + 1)
    passing = {(n, k): n - 1 for n in within for k in KINDS}
    negation = Acceptor(none, passing | {(n, "negation"): _NEGATION_REACH for n in (0, *within)}, dict.fromkeys(within, 0.3), {})
    reports = Acceptor(none, {(0, "report"): 1}, {1: 0.6}, {})
    return insults, threats, targets, negation, reports


def composed(parts: tuple[Acceptor, ...] | None = None) -> dict[tuple[int, str], tuple[int, float, float]]:
    """The product of the acceptors: its reachable states, numbered from the start at 0, with what a word of a kind
    leads to: the next state, the factor on the word's weight (0 for no hit) and the bonus."""
    parts = parts or _acceptors()
    start = (0,) * len(parts)
    known, arcs, todo = {start: 0}, {}, [start]
    while todo:
        state = todo.pop()
        for kind in KINDS:
            to = tuple(a.arcs.get((q, kind), q) for a, q in zip(parts, state))
            hit = any(kind in a.hits for a in parts)
            factor = math.prod(a.factors.get(q, 1.0) for a, q in zip(parts, state)) if hit else 0.0
            bonus = sum(a.bonuses.get((q, kind), 0.0) for a, q in zip(parts, state))
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            arcs[known[state], kind] = (known[to], factor, bonus)
    return arcs


class Lexicon(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best


class Grammar:
    """Clause scores under a lexicon; slope and shift of the curve that makes them document scores."""

    def __init__(self, lexicon: Lexicon, slope: float = 1.0, shift: float = -3.0, threat: float = THREAT):
        self.lexicon, self.slope, self.shift, self.threat, self.arcs = lexicon, slope, shift, threat, composed(_acceptors(threat))
        self.hits: dict[str, float] = {}

    def kind(self, word: str, weight: float) -> str:
        if word in TARGETS:
            return "target"
        if word in OBJECTS:
            return "object"
        if word in OWNERS:
            return "owner"
        if word in INTENTS:
            return "intent"
        if word in NEGATIONS:
            return "negation"
        if word in REPORTS:
            return "report"
        if word in THREATS and weight == 0:
            return "threat"
        return "insult" if weight > 0 else "other"

    def clause(self, words: list[str]) -> float:
        state, total = 0, 0.0
        for word in words:
            weight = self.lexicon.weight(word)
            kind = self.kind(word, weight)
            state, factor, bonus = self.arcs[state, kind]
            total += factor * (weight if kind == "insult" else 1.0) + bonus
        return total

    def raw(self, text: str | None) -> float:
        """The strongest clause in full and a third of what the others add, damped."""
        scores = sorted((self.clause(ws) for c in _CLAUSES.split((text or "").lower()) if (ws := _WORDS.findall(c))), reverse=True)
        return scores[0] + math.log1p(sum(scores[1:])) / 3 if scores else 0.0

    def scores(self, texts: list[str | None]) -> list[float]:
        """Raw scores; only texts with a word of the lexicon are read clause by clause."""
        lows = [(t or "").lower() for t in texts]
        found = [set(_WORDS.findall(t)) for t in lows]
        marked = {w for w in set().union(*found) if w in THREATS or self.lexicon.weight(w) > 0} if found else set()
        return [0.0 if marked.isdisjoint(ws) else self.raw(t) for ws, t in zip(found, lows)]

    def probability(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * raw + self.shift))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic and part (0, 1, 2) of at most `rows` labelled documents outside the held-out fold."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(rows)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` rows
    return own.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)).alias("part"))


def learned_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that mark documents labelled toxic, with log-odds as weights."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: F.length(w) >= MIN_WORD))
    stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, *[F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]))))
    total = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = total.t or 0, (total.n or 0) - (total.t or 0)
    if not toxic or not clean:
        return Lexicon({}, {})
    counts = sample.select("toxic", F.explode(stems).alias("entry")).where("entry is not null").groupBy("entry").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    rate = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    good = counts.where((F.col("t") >= MIN_DOCUMENTS) & (F.col("t") >= MIN_PURITY * F.col("n"))).withColumn("weight", rate)
    good = good.collect()  # of the vocabulary of at most FIT_ROWS rows
    clip = lambda w: round(min(6.0, w), 6)
    return Lexicon({r.entry: clip(r.weight) for r in good if r.entry[-1] != "*"}, {r.entry[:-1]: clip(r.weight) for r in good if r.entry[-1] == "*"})


#: What scores threats alone, whatever the words around them.
_THREATS_ALONE = 1.0


def _threat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only, none = composed((_threats(_THREATS_ALONE),)), Lexicon({}, {})
    kind = Grammar(none).kind
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            hit = False
            for clause in _CLAUSES.split((text or "").lower()):
                state = 0
                for word in _WORDS.findall(clause):
                    state, _, bonus = only[state, kind(word, 0.0)]
                    hit = hit or bonus > 0
            found.append(hit)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.bool_()), batch.column("toxic")], ["threat", "toxic"])


def learned_threat(sample: DataFrame) -> float:
    """Log-odds of a document with a threat, which count as MIN_DOCUMENTS toxic ones before any is seen."""
    rows = sample.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(_threat_rows, "threat boolean, toxic long")
    n = {(r.threat, r.toxic): r["count"] for r in rows.groupBy("threat", "toxic").count().collect()}
    toxic, clean = (n.get((True, k), 0) + n.get((False, k), 0) for k in (1, 0))
    if not toxic or not clean:
        return THREAT
    odds = math.log((n.get((True, 1), 0) + MIN_DOCUMENTS + 0.5) / (toxic + 1)) - math.log((n.get((True, 0), 0) + 0.5) / (clean + 1))
    return round(max(0.0, min(6.0, odds)), 6)


def fitted_curve(raw: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve, by Newton steps with a weak prior."""
    if len(raw) == 0 or toxic.min() == toxic.max():
        return 1.0, -3.0
    x, w = np.stack([raw, np.ones_like(raw)], 1), np.array([0.5, -2.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.01])
        step = np.linalg.solve(h, x.T @ (p - toxic) + np.array([0.05, 0.01]) * w)
        w = w - np.clip(step, -1.0, 1.0)
    return max(float(w[0]), 1e-3), float(w[1])


def _raw_rows(grammar: Grammar) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = grammar.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), batch.column("toxic")], ["raw", "toxic"])

    return run


def learned(docs: DataFrame, labels: DataFrame) -> Grammar:
    from .storage import written

    sample = written(labelled(docs, labels), "labelled")
    lexicon, threat = learned_lexicon(sample.where("part <> 0")), learned_threat(sample.where("part <> 0"))
    grammar = Grammar(lexicon, threat=threat)
    rest = sample.where("part = 0").select("text", F.col("toxic").cast("long").alias("toxic"))
    rows = rest.mapInArrow(_raw_rows(grammar), "raw double, toxic long").collect()  # at most FIT_ROWS
    slope, shift = fitted_curve(np.array([r.raw for r in rows]), np.array([r.toxic for r in rows], float))
    return Grammar(lexicon, slope, shift, threat)


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # of the vocabulary of at most FIT_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            score: list[float] = []
            for a in range(0, batch.num_rows, 500):
                score += map(grammar.probability, grammar.scores(batch.column("text").slice(a, 500).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
