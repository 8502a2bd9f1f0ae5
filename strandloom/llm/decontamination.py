"""Benchmark decontamination: greedy string tiling of documents with test items.

A document meets an item when they share a seed, SEED consecutive words (lower case, letters and digits). For each such
pair the longest matches are marked again and again, found by Karp-Rabin hashes over what is still unmarked, until none
of at least MIN_MATCH words is left. The share of the item's words that the tiles cover tells contamination; order does
not matter, so passages put together anew are caught.

The test set is the query set: it is taken to the executors in blocks of BLOCK_BYTES, and every block meets all
documents.

Defined cases: null and empty texts match nothing; items shorter than a seed are matched whole, so an item of one word is
found in every document with that word; repeated documents
are judged each, repeated items once; an item_id with two texts counts as two items; a null item_id stays null in the
result; an empty test set flags nothing; extra columns of the documents stay as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mixed, window_hashes

MIN_MATCH = 4
#: No longer than a tile, so that passages put together anew from the shortest tiles are looked at as well.
SEED = MIN_MATCH
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
#: Size of a block of items as it is sent to executors, and what one of its words takes there (a seed, its set and its entry).
BLOCK_BYTES = 64 << 20
WORD_BYTES = 512
_WORDS = re.compile(r"[^\W_]+")


class Found(NamedTuple):
    item_id: int | None
    coverage: float
    tiles: int
    words: int


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _grams(ids: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, Karp-Rabin hashes) of each n consecutive unmarked ids."""
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marked = np.concatenate(([0], np.cumsum(~free)))
    starts = np.flatnonzero(marked[n:] == marked[:-n])
    return starts, window_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), n)[starts] if len(starts) else np.zeros(0, np.uint64)


def _runs(doc: list[int], least: int) -> tuple[list[int], list[int]]:
    """Runs of at least `least` words that the item has, -1 between them, and where each word lay."""
    ids, at, first = [], [], 0
    for i in range(len(doc) + 1):
        if i == len(doc) or doc[i] < 0:
            if i - first >= least:
                ids += [*doc[first:i], -1]
                at += range(first, i + 1)
            first = i + 1
    return ids, at


def tiles(item: list[int], doc: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in item, start in document, length) of greedy tiles, the longest first.

    Each round runs Karp-Rabin at the greatest length at which anything is left to match. A match contains shorter ones, so
    that length is found by bisection, and lengths without matches cost nothing.
    """
    least = max(1, min(least, len(item)))
    doc, at = _runs(doc, least)
    item_ids, doc_ids = np.array(item, np.int64), np.array(doc, np.int64)
    free_item, free_doc, out, n = np.ones(len(item), bool), doc_ids >= 0, [], len(item)

    def common(length: int) -> bool:
        return bool(np.isin(_grams(item_ids, free_item, length)[1], _grams(doc_ids, free_doc, length)[1]).any())

    while n >= least and common(least):
        low, high = least, n
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        n, places = low, defaultdict(list)
        starts, hashes = _grams(item_ids, free_item, n)
        for i, h in zip(starts.tolist(), hashes.tolist()):
            places[h].append(i)
        starts, found = _grams(doc_ids, free_doc, n)
        hit = np.isin(found, hashes)
        for j, h in zip(starts[hit].tolist(), found[hit].tolist()):
            if not free_doc[j : j + n].all():
                continue
            for i in places[h]:
                # marks set in this round and collisions of hashes are checked here
                if free_item[i : i + n].all() and (item_ids[i : i + n] == doc_ids[j : j + n]).all():
                    free_item[i : i + n] = free_doc[j : j + n] = False
                    out.append((i, at[j], n))
                    break
            if not free_item.any():
                break
        n -= 1
    return out


class Block:
    """Some items: their ids, their words as numbers and, by place in the block, their seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, list[int]]] = []
        # by seed: where it starts in the row of all items' words
        self.seeds: dict[tuple[int, ...], list[int]] = defaultdict(list)
        self.short: set[int] = set()
        size = 0
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if not ids:
                continue
            self.items.append((item_id, ids))
            n = min(SEED, len(ids))
            self.short |= {n} if n < SEED else set()
            for i in range(len(ids) - n + 1):
                self.seeds[tuple(ids[i : i + n])].append(size + i)
            size += len(ids)
        self.ends = np.cumsum([len(ids) for _, ids in self.items], dtype=np.int64)

    def _reachable(self, doc: list[int], least_coverage: float) -> list[int]:
        """Places of the items of which shared seeds cover enough words."""
        near, covered = np.array(doc, np.int64) >= 0, []
        for n in (SEED, *sorted(self.short)):
            if len(doc) >= n:
                sums = np.concatenate(([0], np.cumsum(near)))
                seeds = {tuple(doc[i : i + n]) for i in np.flatnonzero(sums[n:] - sums[:-n] == n).tolist()}
                starts = [x for seed in seeds for x in self.seeds.get(seed, ())]
                covered.append((np.array(starts, np.int64)[:, None] + np.arange(n)).ravel())
        if not covered or not len(at := np.unique(np.concatenate(covered))):
            return []
        place, words = np.unique(np.searchsorted(self.ends, at, side="right"), return_counts=True)
        return [p for p, n in zip(place.tolist(), words.tolist()) if n >= least_coverage * len(self.items[p][1])]

    def found(self, text: str | None, least_coverage: float) -> list[Found]:
        known = self.vocabulary.get
        doc = [known(w, -1) for w in words(text)]
        out = []
        for place in self._reachable(doc, least_coverage):
            item_id, item = self.items[place]
            mine = set(item)
            got = tiles(item, [x if x in mine else -1 for x in doc])
            covered = sum(n for _, _, n in got)
            if covered >= least_coverage * len(item):
                out.append(Found(item_id, covered / len(item), len(got), len(item)))
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The test set in blocks of bounded size."""
    some, size = [], 0
    items = benchmark.where("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in items.toLocalIterator():
        some.append((r.item_id, r.text))
        size += len(words(r.text)) * WORD_BYTES
        if size >= most:
            yield Block(some)
            some, size = [], 0
    yield Block(some)


def _rows(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                for f in block.found(text.as_py(), coverage):
                    for column, value in zip(out, (doc_id.as_py(), *f)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "item_id", "coverage", "n_tiles", "item_words"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, item_words): each document with each item that it contains."""
    own, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for block in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        rows = own.mapInArrow(_rows(shared, coverage), "doc_id long, item_id long, coverage double, n_tiles long, item_words long")
        out = rows if out is None else out.unionByName(rows)
    return out


def _leaked(shared, coverage: float):
    @F.pandas_udf("boolean")
    def leaked(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(shared.value.found(t, coverage)) for t in texts])

    return leaked


def is_leaked(text: Column, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> Column:
    """Whether a text contains an item of the test set."""
    out = F.lit(False)
    for block in blocks(benchmark, block_bytes):
        out = out | _leaked(benchmark.sparkSession.sparkContext.broadcast(block), coverage)(text)
    return out
