"""Primer search with errors, and trimming of reads between a pair of primers in either orientation.

The search is a dynamic program over text positions that runs for all reads of an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.nucleotides import IUPAC, IUPAC_COMPLEMENT

# The bases that each IUPAC code stands for.
CODES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
_MASK = np.zeros(256, np.uint8)
for _code, _bases in CODES.items():
    _MASK[[ord(_code), ord(_code.lower())]] = sum(1 << "ACGT".index(b) for b in _bases)
_COMPLEMENT = str.maketrans(IUPAC, IUPAC_COMPLEMENT)


class Hits(NamedTuple):
    """By text: whether there is a hit, its start and end (exclusive) and its edits."""

    found: np.ndarray
    start: np.ndarray
    end: np.ndarray
    errors: np.ndarray


def find(texts: list[str], pattern: str, tolerance: int, last: bool = False, starts: bool = True) -> Hits:
    """The first place where a text's prefix can end so that the pattern lies before it with so few edits.

    Codes match where they share a base; of equal costs the later start wins. last: the search starts again behind
    each hit and the last one counts. An empty pattern is found at 0 without edits. starts: without it, start and errors
    of a hit stay 0.

    A text's column of costs is two words, the rows where it rises and where it falls, so a letter takes a few operations
    on words for all texts; a table is only made of the letters before a hit.
    """
    n, m = len(texts), len(pattern)
    hits = Hits(np.full(n, m == 0), np.zeros(n, int), np.zeros(n, int), np.zeros(n, int))
    sizes = np.array([len(t) for t in texts], int)
    width = int(sizes.max(initial=0))
    if not m or not width:
        return hits
    raw = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("ascii", "replace"), np.uint8).reshape(n, width)
    wanted = _MASK[np.frombuffer(pattern.encode("ascii", "replace"), np.uint8)]
    if m > 64:
        return _found_by_table(_MASK[raw], sizes, wanted, tolerance, last, hits)
    word = np.uint16 if m <= 16 else np.uint32 if m <= 32 else np.uint64
    fits = np.array([sum(1 << k for k in range(m) if mask & wanted[k]) for mask in range(16)], word)[_MASK]
    letters, top, ones = fits[np.ascontiguousarray(raw.T)], word(1 << (m - 1)), word(np.iinfo(word).max)
    up, down, cost, since, begin = np.full(n, ones), np.zeros(n, word), np.full(n, m, np.int16), np.zeros(n, int), np.zeros(n, int)
    for at in range(width):
        same = letters[at]
        vertical, across = same | down, (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up), up & across
        cost += (rise & top) != 0
        cost -= (fall & top) != 0
        rise <<= word(1)
        fall <<= word(1)
        up, down = fall | ~(vertical | rise), rise & vertical
        hit = (cost <= tolerance) & (sizes > at)
        if not last:
            hit &= ~hits.found
        own = np.flatnonzero(hit)
        if len(own):
            hits.found[own], hits.end[own], begin[own] = True, at + 1, since[own]
            if last:
                up[own], down[own], cost[own], since[own] = ones, 0, m, at + 1
            elif hits.found.all():
                break
    if starts and tolerance > 0:
        own = np.flatnonzero(hits.found)
        hits.start[own], hits.errors[own] = _starts(_MASK[raw], own, begin[own], hits.end[own], wanted, tolerance)
    elif starts:
        hits.start[hits.found] = hits.end[hits.found] - m
    return hits


def _found_by_table(text: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, tolerance: int, last: bool, hits: Hits) -> Hits:
    """What find returns, for patterns that are longer than a word."""
    (n, width), m = text.shape, len(wanted)
    # cost and start are one number: fewer edits first, then the later start
    unit = 2 * width + 4
    fresh = np.arange(m + 1) * unit
    state = np.repeat(fresh[:, None] + width, n, axis=1)
    for at in range(width):
        new = np.empty_like(state)
        new[0] = width - (at + 1)
        for row in range(1, m + 1):
            step = np.where(text[:, at] & wanted[row - 1], 0, unit)
            new[row] = np.minimum(np.minimum(state[row - 1] + step, state[row] + unit), new[row - 1] + unit)
        hit = (new[m] // unit <= tolerance) & (at < sizes)
        if not last:
            hit &= ~hits.found
        hits.found[hit], hits.end[hit] = True, at + 1
        hits.start[hit], hits.errors[hit] = width - new[m, hit] % unit, new[m, hit] // unit
        if last:
            new[:, hit] = fresh[:, None] + width - (at + 1)
        state = new
    return hits


def _starts(text: np.ndarray, own: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and edits of the hits of some texts, by a table of the letters that a hit can cover; a search began at `begin`."""
    m, span = len(wanted), len(wanted) + tolerance
    # cost and start are one number: fewer edits first, then the later start
    width = text.shape[1] + 1
    unit, rows = 2 * width, np.arange(m + 1)[:, None] * (2 * width)
    state = rows + width - np.maximum(end - span, begin)
    for k in range(span):
        at = end - span + k
        letter = text[own, np.maximum(at, 0)]
        new = np.empty_like(state)
        new[0] = width - (at + 1)
        for row in range(1, m + 1):
            step = np.where(letter & wanted[row - 1], 0, unit)
            new[row] = np.minimum(np.minimum(state[row - 1] + step, state[row] + unit), new[row - 1] + unit)
        state = np.where(at >= begin, new, state)
    return width - state[m] % unit, state[m] // unit


def reverse_complements(texts: list[str]) -> list[str]:
    return [t.upper().translate(_COMPLEMENT)[::-1] for t in texts]


def _trims(forward: str, adapter: str, tolerance: int, window: int, chop: int):
    def between(reads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        a = find([r[:window] for r in reads], forward[chop:], tolerance, last=True, starts=False)
        b = find(reverse_complements([r[-window:] for r in reads]), adapter[chop:], tolerance, last=True, starts=False)
        right = np.array([len(r) for r in reads], int) - b.end
        ok = a.found & b.found & (a.end < right)
        return np.where(ok, a.end, -1), right

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reads = batch["sequence"].fillna("").str.upper().tolist()
            turned = reverse_complements(reads)
            (left, right), (left2, right2) = between(reads), between(turned)
            inserts, ways = [], []
            for i in range(len(reads)):
                way = "forward" if left[i] >= 0 else "reverse" if left2[i] >= 0 else None
                insert = reads[i][left[i] : right[i]] if way == "forward" else turned[i][left2[i] : right2[i]] if way else None
                inserts.append(insert)
                ways.append(way)
            yield batch.assign(insert=inserts, orientation=ways)

    return run


def primer_trimmed(reads: DataFrame, forward: str, adapter: str, tolerance: int = 2, window: int = 100, chop: int = 0) -> DataFrame:
    """reads with insert and orientation (both null where no orientation has both primers); null reads count as empty."""
    if chop >= min(len(forward), len(adapter)):
        raise ValueError("chop leaves nothing of a primer")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema)
    return reads.mapInPandas(_trims(forward.upper(), adapter.upper(), tolerance, window, chop), f"{fields}, insert string, orientation string")
