"""Global alignment of pairs (in full, in a band, or from seeds) and hashes of reads, in Arrow batches."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Cells of the traces that a task holds at once; a single larger pair is aligned alone.
CELLS = 24_000_000
#: Length of a seed, and the step between the seeds of a reference.
SEED, STEP = 30, 10
_DIAGONAL, _LEFT, _UP = 1, 2, 3
_NEVER = -(1 << 29)
#: Pairs up to which each is traced back by itself.
_FEW = 8


class Scores(NamedTuple):
    """Scores of a match, a mismatch and a gap, and of a gap before the first or along the last letter of the other sequence.

    masks: letters whose masks share a bit score `compatible` where they differ.
    """

    match: int = 100
    mismatch: int = -100
    gap: int = 100
    edge_gap: int = 99
    compatible: int = 0
    masks: np.ndarray | None = None


#: The scores of reads.
READS = Scores()


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint8)
    for row, text in enumerate(texts):
        out[row, : len(text)] = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    return out


def _traced(references: list[str], queries: list[str], banded: bool, scores: Scores) -> list[np.ndarray]:
    """The steps of each pair's best alignment from its start: diagonal, left (a gap in the reference) or up, ties in this order.

    Rows are filled one by one for all pairs. Steps to the left within a row are a running maximum, as each costs the same.
    A cell is named by its column, or in a band by its distance from the band's lower edge.
    """
    n, m = np.array([len(x) for x in references]), np.array([len(x) for x in queries])
    rows, columns, pairs = int(n.max()), int(m.max()), len(references)
    ref, query = _codes([x.upper() for x in references], rows), _codes([x.upper() for x in queries], columns)
    slide = int(banded)
    if banded:
        half = np.ceil(np.sqrt((n + m) / 2)).astype(int)
        lower, upper = -half - np.maximum(0, n - m), half + np.maximum(0, m - n)
        width = int((upper - lower).max()) + 1
    else:
        lower, upper, width = np.zeros(pairs, int), m, columns + 1
    cell = np.arange(width)
    outside = cell > (upper - lower)[:, None]
    trace = np.zeros((rows + 1, pairs, width), np.uint8)
    j = lower[:, None] + cell
    last = np.where((j < 0) | (j > m[:, None]) | outside, _NEVER, -scores.edge_gap * j).astype(np.int64)
    for i in range(1, rows + 1):
        j = lower[:, None] + cell + slide * i
        letter = np.take_along_axis(query, np.clip(j - 1, 0, columns - 1), axis=1)
        same = letter == ref[:, i - 1, None]
        value = np.where(same, scores.match, scores.mismatch)
        if scores.masks is not None:
            value = np.where(~same & ((scores.masks[letter] & scores.masks[ref[:, i - 1, None]]) > 0), scores.compatible, value)
        before = np.full((pairs, width + 2), _NEVER, np.int64)
        before[:, 1:-1] = last
        diagonal = before[:, slide : slide + width] + value
        up = before[:, slide + 1 : slide + 1 + width] - np.where(j == m[:, None], scores.edge_gap, scores.gap)
        bad = (j < 0) | (j > m[:, None]) | outside
        best = np.where(bad, _NEVER, np.where(j == 0, -scores.edge_gap * i, np.maximum(diagonal, up)))
        gap = np.where(i == n, scores.edge_gap, scores.gap)[:, None]
        now = np.maximum.accumulate(best + gap * cell, axis=1) - gap * cell
        left = np.full((pairs, width), _NEVER, np.int64)
        left[:, 1:] = now[:, :-1] - gap
        trace[i] = np.where((diagonal == now) & (j > 0), _DIAGONAL, np.where((left == now) & (j > 0), _LEFT, _UP))
        last = np.where(bad, _NEVER, now)
    return _traces_back(trace, n, m, lower, slide)


def _traces_back(trace: np.ndarray, n: np.ndarray, m: np.ndarray, lower: np.ndarray, slide: int) -> list[np.ndarray]:
    pairs = len(n)
    if pairs <= _FEW:
        out = []
        for p in range(pairs):
            i, j, own, steps = int(n[p]), int(m[p]), trace[:, p], bytearray()
            while i or j:
                step = _LEFT if i == 0 else _UP if j == 0 else int(own[i, j - slide * i - lower[p]])
                steps.append(step)
                i, j = i - (step != _LEFT), j - (step != _UP)
            out.append(np.frombuffer(bytes(steps), np.uint8)[::-1])
        return out
    i, j, every, steps = n.copy(), m.copy(), np.arange(pairs), []
    while (going := (i > 0) | (j > 0)).any():
        step = trace[i, every, np.clip(j - slide * i - lower, 0, trace.shape[2] - 1)]
        step = np.where(going, np.where(i == 0, _LEFT, np.where(j == 0, _UP, step)), 0)
        steps.append(step)
        i, j = i - (going & (step != _LEFT)), j - (going & (step != _UP))
    found = np.array(steps, np.uint8).reshape(-1, pairs)[::-1]
    return [column[column > 0] for column in found.T]


def _sizes(reference: str, query: str, banded: bool) -> tuple[int, int]:
    n, m = len(reference), len(query)
    return n + 1, 2 * math.ceil(math.sqrt((n + m) / 2)) + abs(n - m) + 1 if banded else m + 1


def steps(pairs: list[tuple[str, str]], banded: bool = False, scores: Scores = READS) -> list[np.ndarray]:
    """The steps of each pair's alignment; equal pairs are aligned once and pairs of like sizes together."""
    out: dict[tuple[str, str], np.ndarray] = {}
    for a, b in set(pairs):
        if not a or not b:
            out[a, b] = np.full(len(a) + len(b), _LEFT if not a else _UP, np.uint8)
    todo = sorted((p for p in set(pairs) if p not in out), key=lambda p: (_sizes(*p, banded), p))
    while todo:
        size, rows, width = 0, 0, 0
        while size < len(todo):
            more = _sizes(*todo[size], banded)
            rows, width = max(rows, more[0]), max(width, more[1])
            if size and (size + 1) * rows * width > CELLS:
                break
            size += 1
        part, todo = todo[:size], todo[size:]
        out.update(zip(part, _traced([a for a, _ in part], [b for _, b in part], banded, scores)))
    return [out[p] for p in pairs]


def written_out(reference: str, query: str, path: np.ndarray) -> tuple[str, str]:
    """Both sequences with gaps, as the steps say."""
    sides = []
    for text, gap in ((reference, _LEFT), (query, _UP)):
        row = np.full(len(path), ord("-"), np.uint32)
        row[path != gap] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sides.append(row.tobytes().decode("utf-32-le"))
    return sides[0], sides[1]


def aligned(references: list[str], queries: list[str], banded: bool = False) -> list[tuple[str, str]]:
    """Global alignments of pairs; ties go to the diagonal, then to a gap in the reference.

    banded: within the square root of the mean length of the diagonal (and the difference of lengths), in memory of the band.
    """
    pairs = list(zip(references, queries))
    return [written_out(a, b, path) for (a, b), path in zip(pairs, steps(pairs, banded))]


def seeds(reference: str) -> dict[str, int]:
    """Words of a reference at every STEP letters that are unique among these, with their places."""
    found: dict[str, int] = {}
    for at in range(0, len(reference) - SEED + 1, STEP):
        word = reference[at : at + SEED]
        found[word] = -1 if word in found else at
    return {word: at for word, at in found.items() if at >= 0}


def _rising(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of matches, sorted by the reference, whose places in the query rise."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, place) in enumerate(matches):
        rank = bisect_left(tops, place)
        before.append(ends[rank - 1] if rank else -1)
        tops[rank:], ends[rank:] = [place, *tops[rank + 1 :]], [k, *ends[rank + 1 :]]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(matches[k])
        k = before[k]
    return out[::-1]


def anchors(words: dict[str, int], query: str) -> list[tuple[int, int, int]]:
    """(reference, query, length) of stretches that agree, from seeds that are unique in the query too and in one order."""
    places: dict[int, int] = {}
    for at in range(len(query) - SEED + 1):
        own = words.get(query[at : at + SEED])
        if own is not None:
            places[own] = -1 if own in places else at
    matches = _rising(sorted((a, b) for a, b in places.items() if b >= 0))
    chain: list[tuple[int, int]] = []
    for a, b in matches:
        if chain:
            da, db = a - chain[-1][0], b - chain[-1][1]
            if STEP < da < SEED or db != STEP and db < SEED:
                continue
        chain.append((a, b))
    out: list[tuple[int, int, int]] = []
    for k, (a, b) in enumerate(chain):
        if k and (a - chain[k - 1][0], b - chain[k - 1][1]) == (STEP, STEP):
            out[-1] = (out[-1][0], out[-1][1], a + SEED - out[-1][0])
        else:
            out.append((a, b, SEED))
    return out


def seeded_steps(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """The steps of each pair's alignment from seeds: what lies between them is aligned in full, pairs without seeds in a band."""
    words: dict[str, dict[str, int]] = {}
    plans: dict[tuple[str, str], list] = {}
    full: dict[tuple[str, str], np.ndarray | None] = {}
    bands: dict[tuple[str, str], np.ndarray | None] = {}
    for reference, query in set(pairs):
        if min(len(reference), len(query)) < SEED:
            full[reference, query] = None
            continue
        if reference not in words:
            words[reference] = seeds(reference)
        chain = anchors(words[reference], query)
        if not chain:
            bands[reference, query] = None
            continue
        plan: list = []
        i = j = 0
        for a, b, size in [*chain, (len(reference), len(query), 0)]:
            gap = (reference[i:a], query[j:b])
            full[gap] = None
            plan += [gap, size]
            i, j = a + size, b + size
        plans[reference, query] = plan
    full.update(zip(full, steps(list(full))))
    bands.update(zip(bands, steps(list(bands), banded=True)))
    out = {}
    for pair in set(pairs):
        parts = plans.get(pair)
        if parts is None:
            out[pair] = bands[pair] if pair in bands else full[pair]
        else:
            out[pair] = np.concatenate([np.full(x, _DIAGONAL, np.uint8) if isinstance(x, int) else full[x] for x in parts])
    return [out[pair] for pair in pairs]


def places(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of the reference, how many letters of the query come before its column, and how many up to it."""
    taken = np.cumsum(path != _UP)
    own = path != _LEFT
    return (taken - (path != _UP))[own], taken[own]


def global_alignments(pairs: DataFrame, method: str = "full") -> DataFrame:
    """pairs (reference, query and other columns) with aligned_reference and aligned_query; null where one of both is null.

    method: "full", "banded" (memory of the band) or "seeded" (from shared words of 30 letters, for long reads).
    """
    schema = StructType([*pairs.schema.fields]).add("aligned_reference", "string").add("aligned_query", "string")
    found = {"full": steps, "banded": lambda some: steps(some, banded=True), "seeded": seeded_steps}[method]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("reference", "query"))
            out: list[tuple[str | None, str | None]] = [(None, None)] * len(a)
            todo = [k for k in range(len(a)) if a[k] is not None and b[k] is not None]
            for k, path in zip(todo, found([(a[k], b[k]) for k in todo])):
                out[k] = written_out(a[k], b[k], path)
            arrays = [*batch.columns, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return pairs.mapInArrow(run, schema)


def stable_hashes(first: list[str], second: list[str], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each pair of texts: FNV-1a over both, each closed by a byte 255, and a finaliser."""
    value = np.full(len(first), np.uint64(1469598103934665603) ^ np.uint64(seed), np.uint64)
    prime = np.uint64(1099511628211)
    for texts in (first, second):
        raw = [t.encode() + b"\xff" for t in texts]
        size = np.array([len(r) for r in raw])
        data, starts = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.cumsum(size) - size
        for k in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > k)
            value[on] = (value[on] ^ data[starts[on] + k]) * prime
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        value = (value ^ (value >> np.uint64(33))) * np.uint64(factor)
    return value ^ (value >> np.uint64(33))


def downsampled(reads: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """reads (sample, name and other columns) of which each sample keeps the share of hashes that leaves it `most` on average.

    Samples with fewer reads keep them all; what a read's hash is depends on its sample and name alone.
    """
    schema = StructType([*reads.schema.fields]).add("hash_share", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([x or "" for x in batch.column(c).to_pylist()] for c in ("sample", "name"))
            share = stable_hashes(a, b, seed) / 2.0**64
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(share, pa.float64())], schema.names)

    counts = reads.groupBy("sample").agg(F.count("*").alias("seen")).where(F.col("seen") > most)
    rows = reads.mapInArrow(run, schema).join(counts, "sample", "left")
    return rows.where(F.col("seen").isNull() | (F.col("hash_share") * F.col("seen") <= most)).select(*reads.columns)
