"""What a corrected alignment changes: rows, gaps, and letters by the kind of edit.

Defined cases: a row of only one alignment has no edits; null texts count as empty; names are unique in each alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nucleotides as nt
from .reports import alignment_edits

KINDS = ("substituted", "inserted", "removed")
#: Pairs and cells of a row that are compared at once; fewer pairs, and longer texts, are compared one by one.
TOGETHER, CELLS, FEW, LONG = 1024, 1 << 20, 16, 4000
#: What a cell counts for an edit, and what it has besides where a step comes later among equally cheap ones; below it, removals.
UNIT, LATER = 1 << 14, 1 << 13


def edit_kinds(old: str, new: str) -> tuple[int, int, int]:
    """Letters substituted, inserted and removed in a cheapest edit of old into new.

    Of equally cheap last steps a substitution or match comes before a removal, and that before an insertion. A row of the
    table is one pass: its steps other than insertions stand alone, and each run of insertions starts at the last of them.
    Common ends would not change the cost but could change the kinds, so the whole texts are compared. Rows take memory for
    one text, not for the product.
    """
    if old == new:
        return 0, 0, 0
    target, place = np.frombuffer(new.encode("utf-32-le"), np.uint32), np.arange(len(new) + 1)
    cost, substituted, inserted, removed = place, np.zeros_like(place), place, np.zeros_like(place)
    for letter in np.frombuffer(old.encode("utf-32-le"), np.uint32):
        differs = (target != letter).astype(place.dtype)
        down = np.concatenate(([True], cost[1:] + 1 < cost[:-1] + differs))
        before = lambda x: np.concatenate(([0], x[:-1]))
        own = np.where(down, cost + 1, before(cost) + np.concatenate(([0], differs)))
        substituted = np.where(down, substituted, before(substituted) + np.concatenate(([0], differs)))
        inserted, removed = np.where(down, inserted, before(inserted)), np.where(down, removed + 1, before(removed))
        cost = np.minimum.accumulate(own - place) + place
        start = np.maximum.accumulate(np.where(cost == own, place, 0))
        substituted, removed, inserted = substituted[start], removed[start], inserted[start] + place - start
    return int(substituted[-1]), int(inserted[-1]), int(removed[-1])


def _codes(texts: list[str]) -> np.ndarray:
    """A row for each place, a column for each text; -1 behind its end."""
    out = np.full((len(texts), max(map(len, texts))), -1, np.int32)
    for row, text in zip(out, texts):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le"), np.int32)
    return np.ascontiguousarray(out.T)


def edit_kinds_of_all(pairs: list[tuple[str, str]]) -> list[tuple[int, int, int]]:
    """edit_kinds of each pair, pairs of like lengths together.

    A cell is one number, its cost before the letters removed so far; the other kinds follow from these and the cell's place.
    """
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(pairs)
    order = sorted((k for k, (a, b) in enumerate(pairs) if a != b), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    while order:
        size = max(1, min(TOGETHER, CELLS // (len(pairs[order[-1]][1]) + 1), len(order)))
        own, order = order[-size:], order[:-size]
        old, new = [pairs[k][0] for k in own], [pairs[k][1] for k in own]
        if size < FEW or max(map(len, old)) > LONG or not any(old) or not any(new):
            for k in own:
                out[k] = edit_kinds(*pairs[k])
            continue
        n, m, letters, targets = np.array([len(x) for x in old]), np.array([len(x) for x in new]), _codes(old), _codes(new)
        cells = np.repeat((np.arange(len(targets) + 1, dtype=np.int32) * UNIT)[:, None], size, axis=1)
        last = cells[m, np.arange(size)]
        for i, letter in enumerate(letters, 1):
            down = cells + (UNIT + LATER + 1)
            cells = np.concatenate((down[:1], np.minimum(cells[:-1] + (targets != letter) * np.int32(UNIT), down[1:])))
            cells &= ~LATER
            for before, cell in zip(cells, cells[1:]):
                np.minimum(cell, before + (UNIT + LATER), out=cell)
                cell &= ~LATER
            ended = np.flatnonzero(n == i)
            last[ended] = cells[m[ended], ended]
        removed, cost = last % LATER, last // UNIT
        inserted = m - n + removed
        for k, *kinds in zip(own, (cost - inserted - removed).tolist(), inserted.tolist(), removed.tolist()):
            out[k] = tuple(kinds)
    return out


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = edit_kinds_of_all([(a or "", b or "") for a, b in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist())])
        counts = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("old"), batch.column("new"), *counts], ["old", "new", *KINDS])


def corrected_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, change, gaps_only, substituted, inserted, removed of two alignments (name, aligned).

    Different pairs of ungapped texts are compared once, however many rows have them.
    """
    rows = alignment_edits(before, after).drop("edits")
    texts = lambda df, to: df.select("name", F.coalesce(nt.degapped(F.col("aligned")), F.lit("")).alias(to))
    pairs = texts(before, "old").join(texts(after, "new"), "name").where("old <> new")
    kinds = pairs.select("old", "new").distinct().mapInArrow(_kinds, "old string, new string, substituted long, inserted long, removed long")
    counted = pairs.join(kinds, ["old", "new"]).select("name", *KINDS)
    return rows.join(counted, "name", "left").fillna(0, list(KINDS))


def correction_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after, rows added, removed, changed and with moved gaps only, letters by kind of edit."""
    is_change = lambda kind: F.count_if(F.col("change") == kind)
    counts = [F.count_if(F.col("change") != "added").alias("rows_before"), F.count_if(F.col("change") != "removed").alias("rows_after")]
    counts += [is_change(k).alias(f"rows_{k}") for k in ("added", "removed", "changed")] + [F.count_if("gaps_only").alias("rows_with_moved_gaps")]
    return corrected_rows(before, after).agg(*counts, *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in KINDS])
