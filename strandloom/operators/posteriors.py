"""Posterior of G-to-A hypermutation of aligned sequences, and a map of their distances, in grouped Arrow kernels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The grid of log rates and of log multipliers, transitions against transversions, priors, and the least chance.
RATES, MULTIPLIERS = -12 + 0.5 * np.arange(23), -1 + 0.05 * np.arange(121)
TRANSITION, RATE_PRIOR, NARROW, WIDE, WIDE_SHARE, LEAST = 4.5, (-5.0, 1.0), 0.1, 1.0, 0.01, 1e-300
#: The angle and the iterations of the map's first vectors.
ANGLE, ITERATIONS = 1.61803398875, 160
#: Terms of the exponential's series, once the matrix is halved until its norm is below 1.
_TERMS = 24


def _exponential(matrices: np.ndarray) -> np.ndarray:
    """Exponentials of a stack of small matrices."""
    norm = np.abs(matrices).sum(axis=2).max(axis=1)
    halvings = np.maximum(0, np.ceil(np.log2(np.maximum(norm, 1)))).astype(int)
    scaled = matrices / (2.0**halvings)[:, None, None]
    term = total = np.broadcast_to(np.eye(matrices.shape[1]), matrices.shape)
    for k in range(1, _TERMS + 1):
        term = term @ scaled / k
        total = total + term
    for k in range(int(halvings.max(initial=0))):
        more = halvings > k
        total[more] = total[more] @ total[more]
    return total


def _density(x: np.ndarray, mean: float, spread: float) -> np.ndarray:
    return np.exp(-((x - mean) ** 2) / (2 * spread**2)) / (spread * math.sqrt(2 * math.pi))


class Grid(NamedTuple):
    rate: np.ndarray
    multiplier: np.ndarray
    prior: np.ndarray
    chances: np.ndarray


@lru_cache(maxsize=1)
def grid() -> Grid:
    """All rates with all multipliers: log prior, and log chances of each of the 16 pairs of bases (ACGT, from and to)."""
    rate, multiplier = (x.ravel() for x in np.meshgrid(RATES, MULTIPLIERS, indexing="ij"))
    q = np.ones((len(rate), 4, 4))
    q[:, [0, 1, 2, 3], [2, 3, 0, 1]] = TRANSITION
    q[:, 2, 0] *= np.exp(multiplier)
    q[:, np.arange(4), np.arange(4)] = 0
    q[:, np.arange(4), np.arange(4)] = -q.sum(axis=2)
    chances = np.log(np.maximum(_exponential(q * np.exp(rate)[:, None, None]), LEAST)).reshape(len(rate), 16)
    prior = np.log(_density(rate, *RATE_PRIOR)) + np.log((1 - WIDE_SHARE) * _density(multiplier, 0, NARROW) + WIDE_SHARE * _density(multiplier, 0, WIDE))
    return Grid(rate, multiplier, prior, chances)


def pair_counts(consensus: str, sequence: str) -> np.ndarray:
    """How often each base of the consensus stands over each base of the sequence."""
    code = np.full(256, -1, np.int64)
    code[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2
    a, b = (code[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)] for t in (consensus, sequence))
    n = min(len(a), len(b))
    both = (a[:n] >= 0) & (b[:n] >= 0)
    return np.bincount(a[:n][both] * 4 + b[:n][both], minlength=16)


class Posterior(NamedTuple):
    """Of each sequence: e to the mean log multiplier, the chance that it is above 1, e to the mean log rate, and changes."""

    multiplier: np.ndarray
    inflated: np.ndarray
    rate: np.ndarray
    g_to_a: np.ndarray
    changes: np.ndarray


def posteriors(counts: np.ndarray) -> Posterior:
    points = grid()
    weight = points.prior + counts @ points.chances.T
    share = np.exp(weight - weight.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    above = share[:, points.multiplier > 0].sum(axis=1)
    changes = counts.sum(axis=1) - counts[:, [0, 5, 10, 15]].sum(axis=1)
    return Posterior(np.exp(share @ points.multiplier), above, np.exp(share @ points.rate), counts[:, 8], changes)


def hypermutation(rows: DataFrame, consensus: str, sequence: str) -> DataFrame:
    """rows with ga_multiplier, ga_inflated, mutation_rate, ga_mutations, mutations, from their aligned sequence and consensus.

    Null texts count as empty; the posterior is then the prior.
    """
    schema = StructType([*rows.schema.fields])
    for name, kind in (("ga_multiplier", "double"), ("ga_inflated", "double"), ("mutation_rate", "double"), ("ga_mutations", "long"), ("mutations", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2_000):
                part = batch.slice(first, 2_000)
                counts = np.stack([pair_counts(a or "", b or "") for a, b in zip(part.column(consensus).to_pylist(), part.column(sequence).to_pylist())])
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, posteriors(counts))], schema.names)

    return rows.mapInArrow(run, schema)


def mismatch_shares(rows: list[str]) -> np.ndarray:
    """Shares of mismatches of each two rows where neither has a gap; 0 without any such column."""
    letters = np.stack([np.frombuffer(r.encode("latin-1", "replace"), np.uint8) for r in rows])
    out = np.zeros((len(rows), len(rows)))
    for k, row in enumerate(letters):
        both = (row != ord("-")) & (letters != ord("-"))
        sizes = both.sum(axis=1)
        out[k] = np.divide((both & (letters != row)).sum(axis=1), sizes, out=np.zeros(len(rows)), where=sizes > 0)
    return out


def scaled_map(distances: np.ndarray) -> np.ndarray:
    """Two coordinates for each point: the leading axes of the doubly centred squared distances, by power iteration."""
    n = len(distances)
    if n < 2:
        return np.zeros((n, 2))
    squared = distances**2
    centred = -0.5 * (squared - squared.mean(axis=0) - squared.mean(axis=1)[:, None] + squared.mean())
    shift, axes, sizes = np.abs(centred).sum(axis=1).max(), [], []
    for axis in (1, 2):
        vector = np.sin(np.arange(1, n + 1) * axis * ANGLE)
        for _ in range(ITERATIONS):
            vector = vector - vector.mean()
            then = centred @ vector + shift * vector
            for other in axes:
                then = then - (then @ other) * other
            then = then - then.mean()
            size = np.sqrt(then @ then)
            if not size:
                break
            vector = then / size
        axes.append(vector)
        sizes.append(max(0.0, vector @ centred @ vector))
    return np.stack(axes, axis=1) * np.sqrt(sizes)


def _mapped(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("name", kind="stable")
    at = scaled_map(mismatch_shares(rows["aligned"].tolist()))
    return pd.DataFrame({"group": rows["group"], "name": rows["name"], "x": at[:, 0], "y": at[:, 1]})


def distance_map(rows: DataFrame, group: str, name: str = "name", aligned: str = "aligned") -> DataFrame:
    """group, name, x, y: a flat map of each group's aligned rows, made in one task from all pairs of them; rows with a null
    name or sequence take no part."""
    own = rows.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{name}`").cast("string").alias("name"), F.col(f"`{aligned}`").alias("aligned"))
    return own.where("name IS NOT NULL AND aligned IS NOT NULL").groupBy("group").applyInPandas(_mapped, "group string, name string, x double, y double")
