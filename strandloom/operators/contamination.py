"""Contaminants among consensus records: clusters of each sample, and records nearer to another sample than to their own.

1. Records become profiles of six-letter words. A sample's equal records share a profile, so a task holds a sample's
   different sequences, not its records.
2. DP-means gives each sample's clusters: in three passes, records in order join the nearest centre, or open one beyond the
   radius. Only the first record of a sequence can open a centre, so a pass is one leader pass over sequences, after which
   all records find their centre among those that were open when their turn came.
3. Clusters, the samples' means and the panel make the database. It is dealt in blocks; sequences are compared with every
   block in tasks of their own, and the nearest entries are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written
from .consensus import WORD, profile
from .trimming import CODES

BINS = 4**WORD
#: Passes of clustering, and the offset and the factor of the hash that seeds a record's ambiguous letters.
PASSES, HASH_START, HASH_FACTOR = 3, 0x811C9DC5, 0x01000193
#: Profiles that are compared at once, entries of a block, and tasks over which a block's sequences are dealt.
CHUNK, BLOCK, SPREAD = 512, 512, 32
#: Called sequences up to which they are broadcast to their records; more are joined by a shuffle.
BROADCAST_CALLS = 20_000


class Thresholds(NamedTuple):
    cluster: float = 0.015
    proportion: float = 0.2
    distance: float = 0.015


class Cluster(NamedTuple):
    members: int
    centre: np.ndarray


def seed(text: str, ordinal: int) -> int:
    """The state that picks a record's ambiguous letters."""
    value = HASH_START ^ ordinal
    for letter in text:
        value = (value ^ ord(letter)) * HASH_FACTOR & 0xFFFFFFFF
    return value or 1


def picked(sequence: str, state: int) -> str:
    """The ungapped sequence with a base for each code, picked by xorshift steps; other letters stay."""
    out = []
    for letter in sequence.upper():
        if letter == "-":
            continue
        for shift in (13, -17, 5):
            state ^= (state << shift if shift > 0 else state >> -shift) & 0xFFFFFFFF
        choices = CODES.get(letter, letter)
        out.append(choices[state % len(choices)])
    return "".join(out)


def is_ambiguous(sequence: str) -> bool:
    return any(len(CODES.get(c, c)) > 1 for c in sequence.upper())


class Profiles:
    """Sparse word counts of many sequences."""

    def __init__(self, sequences: list[str]):
        found = [np.unique(profile(s.replace("-", "").replace("U", "T")), return_counts=True) for s in sequences]
        self.offsets = np.cumsum([0, *(len(codes) for codes, _ in found)])
        self.codes = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.int64)
        self.counts = np.concatenate([n for _, n in found]).astype(float) if found else np.zeros(0)
        self.norms = self._sums(self.counts**2)
        self.totals = self._sums(self.counts)

    def _sums(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(x)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def dense(self, first: int, end: int) -> np.ndarray:
        out = np.zeros((end - first, BINS))
        a, b = self.offsets[first], self.offsets[end]
        out[np.repeat(np.arange(end - first), np.diff(self.offsets[first : end + 1])), self.codes[a:b]] = self.counts[a:b]
        return out

    def distances(self, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first profile, distances): to all centres, CHUNK profiles at a time."""
        norms, totals = (centres**2).sum(axis=1), centres.sum(axis=1)
        for first in range(0, len(self), CHUNK):
            end = min(first + CHUNK, len(self))
            squared = np.maximum(0, self.norms[first:end, None] + norms - 2 * self.dense(first, end) @ centres.T)
            total = self.totals[first:end, None] + totals
            yield first, np.divide(squared, WORD * total, out=np.zeros_like(squared), where=total > 0)


def dp_means(profiles: Profiles, points: np.ndarray, radius: float, passes: int = PASSES) -> list[Cluster]:
    """Clusters of points, given as places of profiles in order; a point that is farther than the radius from all centres opens one."""
    if not len(points):
        return []
    first_at = np.full(len(profiles), len(points))
    np.minimum.at(first_at, points, np.arange(len(points)))
    centres = profiles.dense(points[0], points[0] + 1)
    assigned = np.full(len(points), -1)
    for _ in range(passes):
        near, near_at = np.full(len(profiles), np.inf), np.zeros(len(profiles), int)
        for first, d in profiles.distances(centres):
            near[first : first + len(d)], near_at[first : first + len(d)] = d.min(axis=1), d.argmin(axis=1)
        far = np.flatnonzero(near > radius)
        opened = _leaders(profiles, far[np.argsort(first_at[far])], radius)
        start, label = near[points], near_at[points]
        if len(opened):
            fresh = np.concatenate([profiles.dense(k, k + 1) for k in opened])
            opened_at = first_at[opened]
            for first, d in profiles.distances(fresh):
                own = np.flatnonzero((points >= first) & (points < first + len(d)))
                least = np.minimum.accumulate(d, axis=1)
                drops = np.concatenate((np.ones((len(d), 1), bool), least[:, 1:] < least[:, :-1]), axis=1)
                at = np.maximum.accumulate(np.where(drops, np.arange(d.shape[1]), 0), axis=1)
                seen = np.searchsorted(opened_at, own, side="right") - 1
                row = points[own] - first
                better = (seen >= 0) & (least[row, seen] < start[own])
                label[own] = np.where(better, len(centres) + at[row, seen], label[own])
            centres = np.concatenate((centres, fresh))
        changed = bool((label != assigned).any())
        assigned = label
        centres = _means(profiles, points, assigned, len(centres))
        if not changed:
            break
    sizes = np.bincount(assigned, minlength=len(centres))
    return [Cluster(int(n), c) for n, c in zip(sizes, centres) if n]


def _leaders(profiles: Profiles, order: np.ndarray, radius: float) -> list[int]:
    """Of profiles in order, those that are farther than the radius from all leaders before them."""
    out: list[int] = []
    rows = np.zeros((16, BINS))
    for k in order.tolist():
        a, b = profiles.offsets[k], profiles.offsets[k + 1]
        if out:
            dots = rows[: len(out), profiles.codes[a:b]] @ profiles.counts[a:b]
            total = profiles.totals[out] + profiles.totals[k]
            squared = np.maximum(0, profiles.norms[out] + profiles.norms[k] - 2 * dots)
            if np.divide(squared, WORD * total, out=np.zeros(len(out)), where=total > 0).min() <= radius:
                continue
        if len(out) == len(rows):
            rows = np.concatenate((rows, np.zeros_like(rows)))
        rows[len(out), profiles.codes[a:b]] = profiles.counts[a:b]
        out.append(k)
    return out


def _means(profiles: Profiles, points: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """Mean profile of each label's points; zeros for a label without points."""
    sums, sizes = np.zeros((n, BINS)), np.bincount(label, minlength=n)
    pairs, times = np.unique(np.stack((label, points)), axis=1, return_counts=True)
    for (which, k), m in zip(pairs.T.tolist(), times.tolist()):
        a, b = profiles.offsets[k], profiles.offsets[k + 1]
        sums[which, profiles.codes[a:b]] += m * profiles.counts[a:b]
    return sums / np.maximum(1, sizes)[:, None]


def percent(share: float) -> str:
    """A share in percent with one decimal, none where it is whole."""
    tenths = int(1000 * share + 0.5)
    return f"{tenths // 10}.{tenths % 10}%" if tenths % 10 else f"{tenths // 10}%"


def _database(thresholds: Thresholds, names: dict[int, str]):
    """Entries of one sample's sequences (sample_idx, text, places): its clusters and its mean."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        profiles = Profiles(rows["text"].tolist())
        place = np.concatenate([np.array(x, np.int64) for x in rows["places"]])
        points = np.repeat(np.arange(len(rows)), rows["places"].str.len().to_numpy())[np.argsort(place)]
        sample = int(rows["sample_idx"].iloc[0])
        found = dp_means(profiles, points, thresholds.cluster)
        shares = [c.members / len(points) for c in found]
        every = _means(profiles, points, np.zeros(len(points), int), 1)[0]
        labels = [f"{names[sample]}_cluster{k + 1}_{percent(x)}" for k, x in enumerate(shares)] + [f"{names[sample]}_All"]
        return pd.DataFrame({
            "sample_idx": sample, "entry": range(len(labels)), "label": labels, "primary": [*(x > thresholds.proportion for x in shares), True],
            "members": [*(c.members for c in found), len(points)], "vector": [packed(c) for c in [*(c.centre for c in found), every]],
        })

    return run


_ENTRY = "sample_idx int, entry int, label string, primary boolean, members long, vector binary"


def database(records: DataFrame, names: dict[int, str], thresholds: Thresholds = Thresholds()) -> DataFrame:
    """sample_idx, entry, label, primary, members, vector: clusters (in the order in which they opened) and mean of each sample.

    records: sample_idx, text, place (its order in the sample); names: by sample.
    """
    distinct = records.groupBy("sample_idx", "text").agg(F.collect_list("place").alias("places"))
    return distinct.groupBy("sample_idx").applyInPandas(_database(thresholds, names), _ENTRY)


def packed(vector: np.ndarray) -> bytes:
    """The bins of a vector that are not zero: their places, then their values."""
    places = np.flatnonzero(vector)
    return places.astype(np.uint16).tobytes() + vector[places].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out, n = np.zeros(BINS), len(raw) // 10
    out[np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw, np.float64, n, 2 * n) if n else 0
    return out


_FOUND = ["sample_idx", "text", "own", "primary_distance", "primary_order", "any_distance", "any_order"]


class Block:
    """Entries of the database that a task compares with sequences."""

    def __init__(self, rows: list[tuple[int, int | None, bool, bytes]], groups: dict[int, str]):
        rows = sorted(rows, key=lambda r: r[0])
        self.order, self.primary = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        self.group = np.array([groups.get(r[1], "") for r in rows])
        self.centres = np.stack([unpacked(r[3]) for r in rows])

    def compared(self, samples: list[int], texts: list[str], groups: dict[int, str], threshold: float) -> Iterator[pa.RecordBatch]:
        asking = np.array([groups[s] for s in samples])
        for a, d in Profiles(texts).distances(self.centres):
            same = asking[a : a + len(d), None] == self.group
            rows = []
            for mask in (same & self.primary, ~same & self.primary, ~same):
                value = np.where(mask, d, np.inf)
                rows.append((value.min(axis=1), self.order[value.argmin(axis=1)]))
            (own, _), (other, other_at), (any_, any_at) = rows
            some = np.flatnonzero((own <= threshold) | (other < threshold) | (any_ < threshold))
            arrays = [
                pa.array([samples[a + k] for k in some.tolist()], pa.int32()), pa.array([texts[a + k] for k in some.tolist()], pa.string()),
                pa.array(own[some]), pa.array(other[some]), pa.array(other_at[some], pa.int64()), pa.array(any_[some]), pa.array(any_at[some], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, _FOUND)


def _compared(groups: dict[int, str], threshold: float):
    """own (nearest of its own group), other (nearest other primary) and any (nearest other entry) of each sequence and block.

    Rows of a block and part come sorted, entries (with a vector) before sequences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            names = ["block", "part", "sample_idx", "text", "order", "primary", "vector"]
            blocks, parts, samples, texts, orders, primary, vectors = (batch.column(c).to_pylist() for c in names)
            asked: list[int] = []

            def answered(asked: list[int] = asked) -> Iterator[pa.RecordBatch]:
                if asked and block is not None:
                    yield from block.compared([samples[k] for k in asked], [texts[k] for k in asked], groups, threshold)
                asked.clear()

            for k in range(len(blocks)):
                if (blocks[k], parts[k]) != now:
                    yield from answered()
                    now, held, block = (blocks[k], parts[k]), [], None
                if vectors[k] is not None:
                    held.append((orders[k], samples[k], primary[k], vectors[k]))
                    continue
                if block is None and held:
                    block, held = Block(held, groups), []
                asked.append(k)
            yield from answered()

    return run


def calls(records: DataFrame, names: dict[int, str], panel: list[tuple[str, str]] = [], donors: dict[int, str] | None = None, thresholds: Thresholds = Thresholds()) -> DataFrame:  # noqa: B006
    """sample_idx, id, nearest, distance, discarded, suspect_only of the records (sample_idx, id, sequence) near to something foreign.

    names: by sample; panel: named foreign sequences; donors: samples of one donor are not foreign to each other. A record is
    called where a large cluster, a mean or a panel entry of others is nearer than the threshold (ties: the first entry), and
    discarded unless one of its own is as near as the threshold. Otherwise any foreign cluster makes it a suspect only.
    Null sequences count as empty. A record with ambiguous letters gets bases for them by its id and place.
    """
    spark, folder = records.sparkSession, shared_folder(records.sparkSession)
    groups = {k: f"donor {donors[k]}" if donors and k in donors else f"sample {name}" for k, name in names.items()}
    own = records.select(F.col("sample_idx").cast("int").alias("sample_idx"), F.col("id").cast("string").alias("id"), F.upper(F.coalesce("sequence", F.lit(""))).alias("sequence"))
    placed = own.withColumn("place", F.row_number().over(Window.partitionBy("sample_idx").orderBy("id")).cast("long") - 1)
    sizes = own.groupBy("sample_idx").count().orderBy("sample_idx").collect()  # a row for each sample
    before, offset = {}, 0
    for row in sizes:
        before[row.sample_idx], offset = offset, offset + row["count"]
    both = written(placed.mapInArrow(_resolved(before), "sample_idx int, id string, place long, text string, asked string"), "records", folder)
    entries = database(both.select("sample_idx", "text", "place"), names, thresholds)
    foreign = [(None, k, name, True, 1, packed(Profiles([picked(s, seed(name, k))]).dense(0, 1)[0])) for k, (name, s) in enumerate(panel)]
    everything = entries.unionByName(spark.createDataFrame(foreign, _ENTRY)) if foreign else entries
    entries = written(everything, "entries", folder)
    blocks = max(1, -(-entries.count() // BLOCK))
    # In the samples' order, each sample's entries in theirs, and the panel last.
    order = F.coalesce(F.col("sample_idx").cast("long"), F.lit(1 << 30)) * (1 << 32) + F.col("entry")
    entries = entries.withColumn("order", order)
    block, none = F.pmod(F.xxhash64("order"), F.lit(blocks)).cast("int").alias("block"), F.lit(None)
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part")
    held = entries.select(block, parts, "sample_idx", none.cast("string").alias("text"), "order", "primary", "vector")
    part = F.pmod(F.xxhash64("asked"), F.lit(SPREAD)).cast("int").alias("part")
    asked = both.select("sample_idx", "asked").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part, "sample_idx", F.col("asked").alias("text"))
    asked = asked.select("*", none.cast("long").alias("order"), none.cast("boolean").alias("primary"), none.cast("binary").alias("vector"))
    dealt = held.unionByName(asked).repartition(SPREAD * blocks, "block", "part").sortWithinPartitions("block", "part", F.col("vector").isNull())
    compared = dealt.mapInArrow(_compared(groups, thresholds.distance), "sample_idx int, text string, own double, primary_distance double, primary_order long, any_distance double, any_order long")
    nearest = lambda kind: F.min(F.struct(f"{kind}_distance", f"{kind}_order")).alias(kind)
    best = compared.groupBy("sample_idx", "text").agg(F.min("own").alias("own"), nearest("primary"), nearest("any"))
    is_primary = F.col("primary.primary_distance") < thresholds.distance
    found = best.where(is_primary | (F.col("any.any_distance") < thresholds.distance)).select(
        "sample_idx",
        F.col("text").alias("asked"),
        F.when(is_primary, F.col("primary.primary_order")).otherwise(F.col("any.any_order")).alias("order"),
        F.when(is_primary, F.col("primary.primary_distance")).otherwise(F.col("any.any_distance")).alias("distance"),
        (is_primary & (F.col("own") > thresholds.distance)).alias("discarded"),
        (~is_primary).alias("suspect_only"),
    )
    named = written(found.join(entries.select("order", F.col("label").alias("nearest")), "order"), "named", folder)
    # Many records may have one sequence, so what was found for sequences is broadcast while it is small.
    named = F.broadcast(named) if named.count() <= BROADCAST_CALLS else named
    return deduplicated(both.select("sample_idx", "id", "asked").join(named, ["sample_idx", "asked"]).select("sample_idx", "id", "nearest", "distance", "discarded", "suspect_only"))


def deduplicated(found: DataFrame) -> DataFrame:
    """One call for a record: a primary one before a suspicion, then the nearest."""
    first = F.struct("suspect_only", "distance", "nearest", "discarded")
    best = found.groupBy("sample_idx", "id").agg(F.min(first).alias("c"))
    return best.select("sample_idx", "id", F.col("c.nearest"), F.col("c.distance"), F.col("c.discarded"), F.col("c.suspect_only"))


def _resolved(before: dict[int, int]):
    """text and asked: the sequence with bases for ambiguous letters, by its place in the sample and among all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, asked = [], []
            for sample, name, sequence, place in zip(*(batch.column(c).to_pylist() for c in ("sample_idx", "id", "sequence", "place"))):
                if is_ambiguous(sequence):
                    texts.append(picked(sequence, seed(name or "", place)))
                    asked.append(picked(sequence, seed(name or "", before.get(sample, 0) + place)))
                else:
                    texts.append(sequence)
                    asked.append(sequence)
            yield pa.RecordBatch.from_arrays([batch.column("sample_idx"), batch.column("id"), batch.column("place"), pa.array(texts, pa.string()), pa.array(asked, pa.string())], ["sample_idx", "id", "place", "text", "asked"])

    return run
