"""Packing: token sequences of a fixed window from documents, by non-negative least squares over length combinations.

Every document is cut into pieces of a whole window and one remainder. The histogram of remainder lengths has fewer
bins than the window has tokens, whatever the corpus, so the plan is made on the driver from it: combinations of up to
three lengths that fill a window are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares and rounded to what is there, and the residual lengths are packed greedily, longest first. The k-th piece of
a length then finds its sequence by arithmetic. Ranks of pieces come from counts by (length, part), so that no length
is ranked in one task.

Ids come from tiktoken with the ranks of the same vocabulary as the tokenizers file (equal ids, several times faster).

Defined cases: a null text is empty; an empty document is its end id alone; repeated rows are packed each; a special
token's string in a text becomes that token, as in the tokenizers library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

WINDOW = 2048
END_ID = 1
PARTS = 1024
#: The fit ends when a round lowers its squared error by less than this share, or after so many rounds.
CONVERGED = 1e-2
ROUNDS = 400
_SPECIAL = "<|endoftext|>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_ENCODERS: dict = {}


class Slots(NamedTuple):
    """Pieces of length key >> 40 with ranks from key & (2**40 - 1) on go to sequence + rank - first, at offset."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def encoder(ranks_path: str, pattern: str, special_id: int = 50256):
    """The tokenizer of a ranks file; made once in each worker."""
    if ranks_path not in _ENCODERS:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks_path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={_SPECIAL: special_id})
    return _ENCODERS[ranks_path]


def document_ids(text: str | None, enc) -> np.ndarray:
    """Ids of a text with the end id, as little-endian unsigned 32-bit integers."""
    text = text or ""
    allowed = {_SPECIAL} if _SPECIAL in text else set()
    ids = enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
    return np.append(ids, END_ID).astype("<u4")


def _tokenized(ranks_path: str, pattern: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = document_ids(text.as_py(), enc)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    for column, value in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All unordered pairs and triples of the lengths that sum to the window, as rows padded with 0."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a = lengths[lengths >= window / 2]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)[there[window - a] & (a < window)]
    rows = [pairs]
    for a in lengths[(lengths >= window / 3) & (lengths < window)].tolist():
        b = lengths[(lengths <= min(a, window - a - 1)) & (2 * lengths >= window - a)]
        c = window - a - b
        ok = there[c]
        rows.append(np.stack([np.full(int(ok.sum()), a, lengths.dtype), b[ok], c[ok]], 1))
    return np.concatenate(rows)


def fitted(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations with the least squared error to the histogram (multiplicative updates)."""
    if not len(rows):
        return np.zeros(0)
    target = counts.astype(float)
    target[0] = 0
    up = target[rows].sum(1)
    # pairs start with all they can take, as long pieces fit little else; triples share the rest
    pairs = rows[:, 2] == 0
    x = np.where(pairs, np.minimum(target[rows[:, 0]], target[rows[:, 1]]), 0.02 * target.sum() / (3.0 * max(1, len(rows))))
    last = np.inf
    for _ in range(ROUNDS):
        got = sum(np.bincount(rows[:, k], weights=x, minlength=len(counts)) for k in range(3))
        got[0] = 0
        error = float(((got - target) ** 2).sum())
        if error >= last * (1 - CONVERGED):
            break
        last = error
        x *= up / np.maximum(got[rows].sum(1), 1e-9)
    return x


def rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts whose running sums follow those of x, as far as pieces are left; takes them from left."""
    sums = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
    wanted, out = np.diff(sums, prepend=0), []
    some = np.flatnonzero(wanted)
    for row, want in zip(rows[some].tolist(), wanted[some].tolist()):
        parts = tuple(p for p in row if p)
        n = min(want, *(int(left[p]) // parts.count(p) for p in parts))
        if n > 0:
            out.append((parts, n))
            for p in parts:
                left[p] -= n
    return out


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations for all that is left: the longest piece, then whatever still fits, as often as it lasts."""
    out, left = [], left.copy()
    while left.any():
        room, parts, free = window, [], left.copy()
        while (fits := np.flatnonzero(free[: room + 1])).size:
            parts.append(int(fits[-1]))
            free[fits[-1]] -= 1
            room -= int(fits[-1])
        n = min(int(left[p]) // parts.count(p) for p in parts)
        out.append((tuple(parts), n))
        for p in parts:
            left[p] -= n
    return out


def planned(counts: np.ndarray, window: int = WINDOW) -> tuple[Slots, int]:
    """Places for all pieces, counts[n] of each length n, and the number of sequences."""
    left = counts.astype(np.int64).copy()
    full = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    alone = greedy(left, window)
    rows = combinations(np.flatnonzero(left), window)
    fit = rounded(rows, fitted(rows, left), left)
    fit += greedy(left, window)
    # a histogram that exact fills suit badly (as many long pieces as windows) keeps none of the fit
    used = full + min(fit, alone, key=lambda plan: sum(n for _, n in plan))
    taken, rank, sequence = [], np.zeros(window + 1, np.int64), 0
    for parts, n in used:
        offset = 0
        for p in parts:
            taken.append(((p << 40) + int(rank[p]), sequence - int(rank[p]), offset))
            rank[p] += n
            offset += p
        sequence += n
    taken.sort()
    columns = np.array(taken, np.int64).reshape(-1, 3).T
    return Slots(*columns), sequence


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(slots.key, (batch.column("length").to_numpy() << 40) + rank, side="right") - 1
            arrays = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            arrays += [pa.array(slots.sequence[at] + rank), pa.array(slots.offset[at])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, ranks_path: str, pattern: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = written(own.mapInArrow(_tokenized(ranks_path, pattern, window), _PIECES), "pieces")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(PARTS)).cast("int"))
    counts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r.length] = r.n
    slots, _ = planned(histogram, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("in_part", F.row_number().over(inside) - 1).join(offsets, ["length", "part"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("in_part")).cast("long").alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(slots)  # bounded by the number of length combinations
    return ranked.mapInArrow(_placed(shared), f"{_PIECES}, sequence_id long, offset long")
