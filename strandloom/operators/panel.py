"""Distance of sequences from an aligned panel: affine alignment with the panel's profile, in a band that widens on demand.

Scores are shares of rows and tenths, so the program counts in whole units of 1 / (5 x rows): equal scores are equal.
All sequences of a batch go through the panel's columns together; gaps along a column are a running maximum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Costs of opening and extending a gap in fifths, what is added to a probability, the background, and the least score.
OPEN, EXTEND, PSEUDO, BACKGROUND, LEAST = -10, -1, 0.01, 0.25, 1.0
#: The narrowest band, and how near to its edge a path must not come.
BAND, EDGE = 64, 2
CELLS = 24_000_000
_NEVER = -(1 << 40)
_M, _X, _Y = 0, 1, 2


class Panel(NamedTuple):
    """counts: rows of the panel that have a letter (ASCII) in a column."""

    rows: int
    counts: np.ndarray

    @classmethod
    def of(cls, aligned: list[str]) -> Panel:
        rows = ["".join(r.split()).upper() for r in aligned]
        if not rows or not rows[0] or any(len(r) != len(rows[0]) for r in rows):
            raise ValueError("a panel needs rows of one length")
        letters = np.stack([np.frombuffer(r.encode("ascii", "replace"), np.uint8) for r in rows])
        counts = np.zeros((letters.shape[1], 128), np.int64)
        np.add.at(counts, (np.arange(letters.shape[1]), letters), 1)
        return cls(len(rows), counts)

    @property
    def width(self) -> int:
        return len(self.counts)


def _letters(queries: list[str]) -> np.ndarray:
    out = np.zeros((len(queries), max(map(len, queries)) + 1), np.uint8)
    for row, q in zip(out, queries):
        row[1 : len(q) + 1] = np.frombuffer(q.encode("ascii", "replace"), np.uint8)
    return out


def _at(values: np.ndarray, place: np.ndarray, last: np.ndarray) -> np.ndarray:
    """values at places of each row; never, where a place lies outside the band or beyond its last cell."""
    inside = (place >= 0) & (place <= last[:, None])
    return np.where(inside, np.take_along_axis(values, np.clip(place, 0, values.shape[1] - 1), axis=1), _NEVER)


def _banded(panel: Panel, queries: list[str], band: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the panel's column of each letter (-1: none), and whether the path came near the band's edge."""
    n, size, width = len(queries), np.array([len(q) for q in queries]), panel.width
    letters, unit = _letters(queries), panel.rows
    cells = min(int(size.max()) + 1, 2 * band + 1)
    cell = np.arange(cells)
    start, end = np.zeros((width + 1, n), int), np.zeros((width + 1, n), int)
    end[0] = np.minimum(size, band)
    middle = (2 * np.arange(1, width + 1)[:, None] * size + width) // (2 * width)
    start[1:], end[1:] = np.maximum(0, middle - band), np.minimum(size, middle + band)
    trace = np.zeros((width + 1, n, cells), np.uint8)
    m = np.full((n, cells), _NEVER)
    m[:, 0] = 0
    x = np.full((n, cells), _NEVER)
    y = np.where((cell > 0) & (cell <= end[0][:, None]), unit * (OPEN + EXTEND * cell), _NEVER)
    trace[0] = np.where(cell > 1, 8, 0)
    for row in range(1, width + 1):
        shift, last = start[row] - start[row - 1], end[row - 1] - start[row - 1]
        column = start[row][:, None] + cell
        good = (column >= 1) & (column <= end[row][:, None])
        before = cell + shift[:, None] - 1
        came = np.stack([_at(v, before, last) for v in (m, x, y)])
        state = np.where(came[_X] > came[_M], _X, _M)
        best = np.maximum(came[_M], came[_X])
        state, best = np.where(came[_Y] > best, _Y, state), np.maximum(best, came[_Y])
        letter = np.take_along_axis(letters, np.minimum(column, letters.shape[1] - 1), axis=1)
        share = panel.counts[row - 1][np.minimum(letter, 127)] * (letter < 128)
        now_m = np.where(good & (best > _NEVER // 2), best + 10 * share - 5 * unit, _NEVER)
        opened, extended = _at(m, before + 1, last) + unit * OPEN, _at(x, before + 1, last) + unit * EXTEND
        goes_x = extended > opened
        now_x = np.where(good, np.maximum(opened, extended), _NEVER)
        now_x = np.where((column == 0) & (start[row] == 0)[:, None], unit * (OPEN + EXTEND * row), now_x)
        run = np.maximum.accumulate(now_m - unit * EXTEND * cell, axis=1) + unit * EXTEND * cell
        now_y = np.full((n, cells), _NEVER)
        now_y[:, 1:] = run[:, :-1] + unit * OPEN
        now_y = np.where(good & (now_y > _NEVER // 2), now_y, _NEVER)
        goes_y = np.zeros((n, cells), bool)
        goes_y[:, 1:] = now_y[:, :-1] + unit * EXTEND > now_m[:, :-1] + unit * OPEN
        trace[row] = np.where(column == 0, 4 if row > 1 else 0, state | goes_x * np.uint8(4) | goes_y * np.uint8(8))
        m, x, y = now_m, now_x, now_y
    every, at = np.arange(n), size - start[width]
    last = np.stack([v[every, at] for v in (m, x, y)])
    state = np.where(last[_X] > last[_M], _X, _M)
    state = np.where(last[_Y] > np.maximum(last[_M], last[_X]), _Y, state)
    lost = last.max(axis=0) <= _NEVER // 2
    near = lost.copy()
    found = np.full((n, letters.shape[1]), -1)
    row, column = np.full(n, width), size.copy()
    while (going := ((row > 0) | (column > 0)) & ~lost).any():
        inner = going & (row > 0) & (column > 0)
        first, final = start[row, every], end[row, every]
        outside = inner & ((column < first) | (column > final))
        near |= outside
        lost |= outside
        inner &= ~outside
        near |= inner & (((first > 0) & (column <= first + EDGE)) | ((final < size) & (column >= final - EDGE)))
        packed = trace[row, every, np.clip(column - first, 0, cells - 1)]
        step = np.where(row == 0, _Y, np.where(column == 0, _X, state))
        hit = inner & (step == _M)
        found[every[hit], column[hit]] = row[hit] - 1
        state = np.where(inner, np.where(step == _M, packed & 3, np.where(step == _X, np.where(packed & 4, _X, _M), np.where(packed & 8, _Y, _M))), step)
        moves = going & ~outside
        row, column = row - (moves & (step != _Y)), column - (moves & (step != _X))
    return [found[k, 1 : len(q) + 1] for k, q in enumerate(queries)], near


def mapped(panel: Panel, queries: list[str]) -> list[np.ndarray]:
    """The panel's column of each letter of ungapped queries; -1 for letters between columns. Bands double until paths keep clear of them."""
    out: dict[str, np.ndarray] = {}
    band_of = {q: min(max(panel.width, len(q)), max(BAND, math.ceil(math.sqrt(max(panel.width, len(q)))))) for q in queries if q}
    while band_of:
        band = min(band_of.values())
        some = sorted((q for q, b in band_of.items() if b == band), key=lambda q: (len(q), q))
        per = max(1, CELLS // ((panel.width + 1) * (2 * band + 1)))
        for k in range(0, len(some), per):
            part = some[k : k + per]
            for q, columns, near in zip(part, *_banded(panel, part, band)):
                most = max(panel.width, len(q))
                if near and band < most:
                    band_of[q] = min(most, band * 2)
                else:
                    out[q] = columns
                    del band_of[q]
    return [out.get(q, np.zeros(0, int)) for q in queries]


def scored(panel: Panel, query: str, columns: np.ndarray) -> float:
    """The best run of letters that the panel's columns do not explain, LEAST at least."""
    at = np.flatnonzero(columns >= 0)
    letters = np.frombuffer(query.encode("ascii", "replace"), np.uint8)[at]
    share = panel.counts[columns[at], np.minimum(letters, 127)] / panel.rows
    now, best = 0.0, LEAST
    for value in (math.log(BACKGROUND) - np.log(share + PSEUDO)).tolist():
        now += value
        best = max(best, now)
        now = max(now, 0.0)
    return best


def ungapped(sequence: str) -> str:
    return "".join(sequence.replace("-", "").split()).upper()


def panel_scores(records: DataFrame, panel_rows: list[str], threshold: float = 50.0) -> DataFrame:
    """records (sequence and other columns) with panel_score, panel_pass and extracted, the part that lies on the panel.

    Gaps and white space of sequences do not count. Null and empty sequences, and those of which no letter lies on the panel,
    have no score and do not pass.
    """
    panel = Panel.of(panel_rows)
    schema = StructType([*records.schema.fields]).add("panel_score", "double").add("panel_pass", "boolean").add("extracted", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = [ungapped(x or "") for x in batch.column("sequence").to_pylist()]
            distinct = list(dict.fromkeys(queries))
            found: dict[str, tuple[float | None, str | None]] = {}
            for q, columns in zip(distinct, mapped(panel, distinct)):
                at = np.flatnonzero(columns >= 0)
                found[q] = (scored(panel, q, columns), q[at[0] : at[-1] + 1]) if len(at) else (None, None)
            scores = [found[q][0] for q in queries]
            arrays = [pa.array(scores, pa.float64()), pa.array([s is not None and s < threshold for s in scores]), pa.array([found[q][1] for q in queries], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema.names)

    return records.mapInArrow(run, schema)


def added(rows: list[str], sequence: str) -> tuple[list[str], str]:
    """The rows and the sequence aligned to them; rows only get columns of gaps, where the sequence has letters of its own."""
    upper = ["".join(r.split()).upper() for r in rows]
    panel, query = Panel.of(upper), ungapped(sequence)
    own, between, last = ["-"] * panel.width, [""] * (panel.width + 1), -1
    for letter, column in zip(query, mapped(panel, [query])[0].tolist()):
        if column < 0:
            between[last + 1] += letter
        else:
            own[column], last = letter, column
    wide = lambda row, gaps: gaps[0] + "".join(c + g for c, g in zip(row, gaps[1:]))
    return [wide(r, ["-" * len(g) for g in between]) for r in upper], wide("".join(own), between)
