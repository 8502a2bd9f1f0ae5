"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Words and word shapes of a text are hashed into BUCKETS features (square roots of shares). One weight vector is shared
by all grades; grade g or better has probability logistic(w.x - threshold[g]) with ordered thresholds, which gives the
expected grade and tail probabilities for selection. The model is fitted on at most FIT_ROWS rated rows, those whose id
hashes lowest.

Ratings come from labels: 0 low quality, 1 good but toxic, 2 good and not toxic.

Defined cases: null and empty texts have no features and get the probabilities of the thresholds alone; without usable
ratings every document has expected grade 1 and is kept; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, slices, words_of

FIT_ROWS = 10_000
WORD_BUCKETS = 4096
SHAPE_BUCKETS = 512
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
GRADES = 3
STEPS = 150
RATE = 0.08
PENALTY = 1e-5
KEEP_GRADE = 1
KEEP_PROBABILITY = 0.5

_CLASS = np.full(256, 4, np.int64)
_CLASS[48:58] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 3


def buckets(words: Words) -> np.ndarray:
    """Two features of each word: its hash, and its shape (kinds of its ends, length, whether it repeats the last one)."""
    n = words.ends - words.starts
    first, last = _CLASS[words.data[words.starts]], words.data[words.ends - 1].astype(np.int64) % 16 + 16 * _CLASS[words.data[words.ends - 1]]
    second = _CLASS[words.data[np.minimum(words.starts + 1, words.ends - 1)]]
    same = np.concatenate(([False], words.hashes[1:] == words.hashes[:-1])) if len(words.hashes) else np.zeros(0, bool)
    shape = ((first * 5 + second) * 80 + last) * 8 + np.minimum(n, 13) // 2
    shape = (shape * 2 + same) * np.int64(2654435761) >> np.int64(7)
    return np.stack([(words.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), WORD_BUCKETS + shape % SHAPE_BUCKETS], 1)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each text."""
    for a, b in slices(texts):
        words = words_of(texts.slice(a, b - a))
        every = buckets(words)
        for first, end in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
            counts = np.bincount(every[first:end].ravel(), minlength=BUCKETS)
            at = np.flatnonzero(counts)
            yield at, np.sqrt(counts[at] / max(1, end - first))


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g from 1 on, a column each."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds[None, :], -30, 30)))


def fitted(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Cumulative-link model by Adam on the whole (bounded) sample; threshold gaps stay positive as exponentials."""
    if not rows:
        return Model(np.zeros(BUCKETS), np.array([-30.0] + [30.0] * (GRADES - 2)))
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    grade = np.array([r[2] for r in rows])
    above = grade[:, None] >= np.arange(1, GRADES)[None, :]
    share = np.clip(above.mean(0), 0.02, 0.98)
    start = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(BUCKETS), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, STEPS + 1):
        gaps = np.exp(p[BUCKETS + 1 :])
        model = Model(p[:BUCKETS], np.cumsum(np.concatenate([p[BUCKETS : BUCKETS + 1], gaps])))
        margins = np.bincount(owner, weights=model.weights[at] * value, minlength=len(rows))
        d = (model.tails(margins) - above) / len(rows)
        by_threshold = -d.sum(0)
        g = np.concatenate([
            np.bincount(at, weights=d.sum(1)[owner] * value, minlength=BUCKETS) + PENALTY * model.weights,
            [by_threshold.sum()],
            gaps * np.cumsum(by_threshold[::-1])[::-1][1:],
        ])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(p[:BUCKETS], np.cumsum(np.concatenate([p[BUCKETS : BUCKETS + 1], np.exp(p[BUCKETS + 1 :])])))


def rated(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and grade of at most `rows` rated documents."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", grade.alias("grade"))
    chosen = chosen.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64(F.lit("grade"), "doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` rows


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(features(batch.column("text")))
        arrays = [pa.array([x[i] for x in found], pa.list_(k)) for i, k in ((0, pa.int32()), (1, pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), *arrays], ["doc_id", "grade", "at", "value"])


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    rows = rated(docs, labels).mapInArrow(_feature_rows, "doc_id long, grade int, at array<int>, value array<float>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    parts = zip(rows["at"].combine_chunks(), rows["value"].combine_chunks(), rows["grade"].to_pylist())
    return fitted([(a.values.to_numpy(), v.values.to_numpy().astype(float), g) for a, v, g in parts])


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, p_good (grade 1 or better), p_best (grade 2) and kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            margins = np.array([float(model.weights[at] @ value) for at, value in features(batch.column("text"))])
            tails = model.tails(margins)
            arrays = [pa.array(tails.sum(1)), *[pa.array(tails[:, g]) for g in range(GRADES - 1)], pa.array(tails[:, KEEP_GRADE - 1] >= KEEP_PROBABILITY)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "expected_grade", "p_good", "p_best", "kept"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, expected_grade double, p_good double, p_best double, kept boolean")
