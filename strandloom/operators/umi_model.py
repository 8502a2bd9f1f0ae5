"""The likelihood model of UMIs: which tag an observed tag was read from, by EM over tags within two edits.

An observed tag and a real one meet at every string that is one edit away from both. Samples of up to SAMPLE_TAGS distinct
tags are one task each: it finds the edges by merging the neighbours of all tags, as numbers, and iterates over arrays.
Larger ones are one task each too, but a round goes from the tags to the strings one edit away and back, without edges, of
which a full sample has hundreds for each tag; edges are only passed through once at the end, a few million at a time.
For tags that fill no length and are too many, and for tags that do not fit in a number, the edges are a join over tables
and each round is a join with the prior and two aggregations, so no task holds a sample. Sums over a table have no fixed
order, so these rounds end where no weight moves by more than CLOSE of itself, as do those of the larger samples.
Spark takes exploded rows to be as few as the rows they come from, so joins of such rows ask for a merge: they would be
broadcast otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import removed, shared_folder, written

#: Error rate of a base, its shares by kind of edit, prior weight, and the probability of rejected tags.
ERROR = 0.005
INSERTION, DELETION, SUBSTITUTION = ERROR * 0.4 * 0.25, ERROR * 0.4, ERROR * 0.2 / 3
CONCENTRATION, ROUNDS = 0.5, 1000
#: A weight has settled when it moves by less than this share of itself, which is what rounding leaves.
SETTLED = 1e-15
#: Tags of a sample up to which its EM holds all edges, and the relative change at which the rounds of larger ones end.
SAMPLE_TAGS, CLOSE = 40_000, 1e-13
#: A length is full where it has one in so many of its strings, up to a length; a task holds 1.5 times SAMPLE_TAGS besides.
FULL, FULL_LENGTH, OTHERS = 8, 10, 1.5
#: Real and observed tags between which edges are made at once, tags of a task that makes edges, and of the largest sample.
FAR, NEAR, PART, MOST = 32_768, 1024, 16_384, 50
#: Tasks over which samples are dealt.
SAMPLE_TASKS = 256
#: Letters that a tag in a number may have (3 bits each), and pairs of neighbours that are merged at once.
NUMBER_LETTERS, PAIRS = 18, 4_000_000
REJECTS, REJECTED, REJECTED_PROBABILITY = "REJECTS", "REJECTED", 1 - math.exp(-5.123456789)

_BASES = "array('A', 'C', 'T', 'G')"
_GROWN = f"flatten(transform({_BASES}, b -> transform(sequence(0, length(umi)), i -> concat(substr(umi, 1, i), b, substr(umi, i + 1)))))"
_CUT = "transform(sequence(1, length(umi)), i -> concat(substr(umi, 1, i - 1), substr(umi, i + 1)))"
_CHANGED = f"flatten(transform({_BASES}, b -> transform(sequence(1, length(umi)), i -> concat(substr(umi, 1, i - 1), b, substr(umi, i + 1)))))"

_MADE = "filter(sequence(1, length(umi)), i -> substr(umi, i, 1) IN ('A', 'C', 'T', 'G'))"  # an edit puts no other letter into a real tag


def _weighted(words: str, weight: float):
    return F.transform(F.expr(words), lambda w: F.struct(w.alias("mid"), F.lit(weight).alias("p")))


def _intact(length):
    return F.pow(F.lit(1 - ERROR), length)


def two_edit_likelihoods(counts: DataFrame, unknown: bool = False) -> DataFrame:
    """sample_idx, umi, real, p: likelihood of observing umi where real was there, over two edits at most.

    unknown: tags may have the letter N, which an edit can take away.
    """
    bases = _BASES.replace(")", ", 'N')") if unknown else _BASES
    tags = counts.where((F.col("umi") != REJECTS) & (F.length("umi") > 0)).select("sample_idx", "umi").distinct()
    first = F.concat(_weighted(_GROWN, INSERTION), _weighted(_CUT, DELETION), _weighted(_CHANGED, SUBSTITUTION))
    # the second edit leads from the middle to the real tag, so seen from the real tag a cut undoes an insertion
    same = F.array(F.struct(F.col("umi").alias("mid"), _intact(F.length("umi")).alias("p")))
    some = "sequence(1, length(umi))"
    changed = F.filter(_weighted(_CHANGED.replace(some, _MADE).replace(_BASES, bases), SUBSTITUTION), lambda x: x["mid"] != F.col("umi"))
    second = F.concat(_weighted(_CUT.replace(some, _MADE), INSERTION), _weighted(_GROWN.replace(_BASES, bases), DELETION), changed, same)

    def steps(edits, name: str, p: str) -> DataFrame:
        rows = tags.select("sample_idx", F.col("umi").alias(name), F.explode(edits).alias("x"))
        return rows.groupBy("sample_idx", name, F.col("x.mid").alias("mid")).agg(F.sum("x.p").alias(p))

    pairs = steps(first, "umi", "p1").join(steps(second, "real", "p2").hint("merge"), ["sample_idx", "mid"])
    edges = pairs.groupBy("sample_idx", "umi", "real").agg(F.sum(F.col("p1") * F.col("p2")).alias("p"))
    return edges.withColumn("p", F.when(F.col("umi") == F.col("real"), _intact(F.length("umi"))).otherwise(F.col("p")))


def _neighbours(tags: np.ndarray, sizes: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, tag's place, weight): all strings one edit away from each tag, as numbers, with duplicates summed.

    A number has 3 bits a letter below a leading 1. Seen from the real tag (second), an insertion is undone by a cut.
    """
    grown, cut = (DELETION, INSERTION) if second else (INSERTION, DELETION)
    letters = (0, 1, 2, 3, 7) if second else (0, 1, 2, 3)  # what an edit takes away may be an N
    out, places, weights = [], [], []
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        x = tags[own]

        def add(values: np.ndarray, weight: float | np.ndarray, own: np.ndarray = own) -> None:
            out.append(values)
            places.append(own)
            weights.append(np.broadcast_to(weight, len(own)))

        for at in range(size + 1):
            high, low = x >> (3 * at) << (3 * at), x & ((1 << 3 * at) - 1)
            for letter in letters:
                add(high << 3 | letter << (3 * at) | low, grown)
        for at in range(size):
            high, low, letter_at = x >> (3 * at + 3), x & ((1 << 3 * at) - 1), (x >> (3 * at)) & 7
            made = (letter_at < 4) | (not second)  # an edit puts no other letter than A, C, T, G into a real tag
            add(high << (3 * at) | low, np.where(made, cut, 0.0))
            for letter in letters:
                add(high << (3 * at + 3) | letter << (3 * at) | low, np.where(made & ~((letter_at == letter) & second), SUBSTITUTION, 0.0))
        if second:
            add(x, (1 - ERROR) ** size)
    key, place, weight = np.concatenate(out), np.concatenate(places), np.concatenate(weights)
    some = weight > 0
    key, place, weight = key[some], place[some], weight[some]
    order = np.lexsort((place, key))
    key, place, weight = key[order], place[order], weight[order]
    heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1]))))
    return key[heads], place[heads], np.add.reduceat(weight, heads)


def _edges(tags: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(observed, real, p) by places of the tags, sorted, from the strings that both have in common."""
    n, done = len(tags), []
    far, real, q = _neighbours(tags, sizes, True)
    per = max(1, PAIRS * n // (8 * len(far)))
    for first in range(0, n, per):
        near, seen, p = _neighbours(tags[first : first + per], sizes[first : first + per], False)
        low, high = np.searchsorted(far, near), np.searchsorted(far, near, side="right")
        times = high - low
        row = np.repeat(np.arange(len(near)), times)
        other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + low[row]
        pair = (seen[row] + first) * n + real[other]
        order = np.argsort(pair, kind="stable")
        pair, value = pair[order], (p[row] * q[other])[order]
        heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        pair, value = pair[heads], np.add.reduceat(value, heads)
        same = pair // n == pair % n
        value[same] = (1 - ERROR) ** sizes[pair[same] % n]
        done.append((pair, value))
    pair, value = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
    return (pair // n).astype(np.int32), (pair % n).astype(np.int32), value


def _edge_parts(tags: np.ndarray, sizes: np.ndarray, first: int = 0, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(observed, real, p) of the observed tags from first to end, between FAR real and NEAR observed ones at a time."""
    end = len(tags) if end is None else end
    for block in range(0, len(tags), FAR):
        far, real, q = _neighbours(tags[block : block + FAR], sizes[block : block + FAR], True)
        for start in range(first, end, NEAR):
            until = min(start + NEAR, end)
            near, seen, p = _neighbours(tags[start:until], sizes[start:until], False)
            low, high = np.searchsorted(far, near), np.searchsorted(far, near, side="right")
            times = high - low
            row = np.repeat(np.arange(len(near)), times)
            if not len(row):
                continue
            other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + low[row]
            pair = seen[row] * FAR + real[other]
            order = np.argsort(pair, kind="stable")
            pair, value = pair[order], (p[row] * q[other])[order]
            heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            pair, value = pair[heads], np.add.reduceat(value, heads)
            a, b = pair // FAR + start, pair % FAR + block
            same = a == b
            value[same] = (1 - ERROR) ** sizes[a[same]]
            yield a, b, value


def _numbers(names: list[str]) -> np.ndarray:
    tags = np.zeros(len(names), np.int64)
    for k, name in enumerate(names):
        number = 1
        for letter in name:
            number = number << 3 | "ACTG".find(letter) & 7
        tags[k] = number
    return tags


def _sample_edges(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _edges(_numbers(rows["umi"].tolist()), rows["umi"].str.len().to_numpy())


def _edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sample_idx, umi, real, p of the observed tags of each row (sample_idx, umis of the sample, part)."""
    for batch in batches:
        for sample, names, part in zip(*(batch.column(c) for c in ("sample_idx", "umis", "part"))):
            sample, part, texts = sample.as_py(), part.as_py(), names.as_py()
            umis, sizes = pa.array(texts, pa.string()), np.array([len(x) for x in texts])
            for seen, real, p in _edge_parts(_numbers(texts), sizes, part * PART, min((part + 1) * PART, len(texts))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), sample), pa.int64()), umis.take(pa.array(seen)), umis.take(pa.array(real)), pa.array(p)], ["sample_idx", "umi", "real", "p"])


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    """Of a value for each of all strings of a size: the sum at each longer string over the ways to insert a letter."""
    out = np.zeros(4 ** (size + 1))
    for at in range(size + 1):
        out.reshape(4**at, 4, -1)[...] += x.reshape(4**at, 1, -1)
    return out


def _over(x: np.ndarray, at: int) -> np.ndarray:
    y = x.reshape(4**at, 4, -1)
    return y[:, 0] + y[:, 1] + y[:, 2] + y[:, 3]


def _cut(x: np.ndarray, size: int) -> np.ndarray:
    """The sum at each shorter string over the ways to cut a letter."""
    out = np.zeros(4 ** (size - 1))
    for at in range(size):
        out += _over(x, at).ravel()
    return out


def _changed(x: np.ndarray, size: int) -> np.ndarray:
    """The sum at each string over the ways to write a letter over another, or over itself."""
    out = np.zeros(4**size)
    for at in range(size):
        out.reshape(4**at, 4, -1)[...] += _over(x, at)[:, None]
    return out


class Steps:
    """Tags without N and all strings one edit away. Lengths of which many strings are tags are vectors over all strings of
    the length, where an edit is a sum along an axis; the edits of other tags are listed."""

    def __init__(self, tags: np.ndarray, sizes: np.ndarray):
        self.n = len(tags)
        self.full: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            if is_full(size, len(own)):
                self.full[size] = own, _base_four(tags[own], size)
        self.first, self.strings = {}, 0
        for size in sorted({s + d for s in self.full for d in (-1, 0, 1)}):
            self.first[size] = self.strings
            self.strings += 4**size
        others = np.flatnonzero(~np.isin(sizes, list(self.full)))
        lists = []
        for second in (False, True):
            key, place, weight = _neighbours(tags[others], sizes[others], second) if len(others) else (np.zeros(0, np.int64), np.zeros(0, int), np.zeros(0))
            size = (np.frexp(key.astype(float))[1] - 1) // 3
            known = (key & ((1 << 3 * size) - 1) // 7 * 4) == 0  # a string with an N is no neighbour of an observed tag
            lists.append((key[known], size[known], others[place[known]].astype(np.int32), weight[known]))
        more = np.unique(np.concatenate([key[~np.isin(size, list(self.first))] for key, size, _, _ in lists]))
        self.lists = []
        for key, size, place, weight in lists:
            at = np.searchsorted(more, key) + self.strings
            for s, first in self.first.items():
                at[size == s] = first + _base_four(key[size == s], s)
            self.lists.append((at.astype(np.int32), place, weight))
        self.strings += len(more)

    def _of(self, strings: np.ndarray, size: int) -> np.ndarray:
        return strings[self.first[size] : self.first[size] + 4**size]

    def out(self, x: np.ndarray, second: bool) -> np.ndarray:
        """At each string the sum over the tags one edit away, as the first or the second edit weighs it."""
        grown, cut = (DELETION, INSERTION) if second else (INSERTION, DELETION)
        at, place, weight = self.lists[second]
        found = np.bincount(at, weight * x[place], self.strings).astype(float, copy=False)
        for size, (own, strings) in self.full.items():
            v = np.zeros(4**size)
            v[strings] = x[own]
            self._of(found, size + 1)[...] += grown * _grown(v, size)
            self._of(found, size - 1)[...] += cut * _cut(v, size)
            self._of(found, size)[...] += SUBSTITUTION * _changed(v, size) + (_unedited(size) * v if second else 0.0)
        return found

    def back(self, strings: np.ndarray, second: bool) -> np.ndarray:
        """At each tag the sum over the strings one edit away."""
        grown, cut = (DELETION, INSERTION) if second else (INSERTION, DELETION)
        at, place, weight = self.lists[second]
        found = np.bincount(place, weight * strings[at], self.n).astype(float, copy=False)
        for size, (own, to) in self.full.items():
            here = self._of(strings, size)
            v = grown * _cut(self._of(strings, size + 1), size + 1) + cut * _grown(self._of(strings, size - 1), size - 1) + SUBSTITUTION * _changed(here, size)
            found[own] = (v + _unedited(size) * here if second else v)[to]
        return found


def is_full(size: int, n: int) -> bool:
    return 1 < size <= FULL_LENGTH and n * FULL >= 4**size


def _unedited(size: int) -> float:
    """Weight of no second edit, without those that write a letter over itself, which _changed has too."""
    return (1 - ERROR) ** size - size * SUBSTITUTION


def _base_four(tags: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(tags), np.int64)
    for at in range(size):
        out |= ((tags >> 3 * at) & 3) << 2 * at
    return out


def _returns(tags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """By tag, the weight of two edits that lead back to it."""
    out = np.zeros(len(tags))
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        bits = min(14, 62 - 3 * (size + 1))
        for first in range(0, len(own), 1 << bits):
            part = own[first : first + (1 << bits)]
            (near, seen, p), (far, real, q) = (_neighbours(tags[part], sizes[part], second) for second in (False, True))
            _, a, b = np.intersect1d(near << bits | seen, far << bits | real, assume_unique=True, return_indices=True)
            out[part] = np.bincount(seen[a], p[a] * q[b], len(part))
    return out


def _assigned_by_steps(rows: pd.DataFrame) -> pd.DataFrame:
    """What _assigned returns, for a sample with too many edges to be held."""
    rows = rows.sort_values("umi", kind="stable")
    names, sizes, counts = rows["umi"].to_numpy(str), rows["umi"].str.len().to_numpy(), rows["family_size"].to_numpy(float)
    tags, n = _numbers(rows["umi"].tolist()), len(rows)
    steps, prior = Steps(tags, sizes), np.full(n, 1 / n)
    itself = (1 - ERROR) ** sizes - _returns(tags, sizes)  # a tag is read as itself with its own likelihood
    for _ in range(ROUNDS):
        total = steps.back(steps.out(prior, True), False) + itself * prior
        scale = np.divide(counts, total, out=np.zeros(n), where=total > 0)
        weight = prior * (steps.back(steps.out(scale, False), True) + itself * scale) + CONCENTRATION
        before, prior = prior, weight / weight.sum()
        if (np.abs(prior - before) <= CLOSE * prior).all():
            break
    best, parent, total = np.zeros(n), np.zeros(n, int), np.zeros(n)
    for seen, real, p in _edge_parts(tags, sizes):
        joint = prior[real] * p
        total += np.bincount(seen, joint, n)
        order = np.lexsort((real, -joint, seen))
        order = order[np.flatnonzero(np.diff(seen[order], prepend=-1))]
        own, value, at = seen[order], joint[order], real[order]
        better = (value > best[own]) | (value == best[own]) & (at < parent[own])
        best[own[better]], parent[own[better]] = value[better], at[better]
    return pd.DataFrame({"sample_idx": rows["sample_idx"].iloc[0], "umi": names, "parent": names[parent], "probability": best / total})


def _assigned(rows: pd.DataFrame) -> pd.DataFrame:
    """Each tag's likeliest real tag and its probability, by EM over one sample's tags and counts."""
    rows = rows.sort_values("umi", kind="stable")
    names, (seen, real, p) = rows["umi"].to_numpy(str), _sample_edges(rows)
    n, counts = len(names), rows["family_size"].to_numpy(float)
    prior = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        joint = prior[real] * p
        scale = np.divide(counts, total := np.bincount(seen, joint, n), out=np.zeros(n), where=total > 0)
        weight = np.bincount(real, joint * scale[seen], n) + CONCENTRATION
        before, prior = prior, weight / weight.sum()
        if (np.abs(prior - before) <= SETTLED * prior).all():
            break
    joint = prior[real] * p
    order = np.lexsort((real, -joint, seen))
    at = order[np.searchsorted(seen[order], np.arange(n))]  # edges are loops too, so every tag has one
    total = np.bincount(seen, joint, n)
    return pd.DataFrame({"sample_idx": rows["sample_idx"].iloc[0], "umi": names, "parent": names[real[at]], "probability": joint[at] / total})


def _assigned_by_rounds(edges: DataFrame, folder: str) -> DataFrame:
    """What _assigned returns, for the edges of any number of samples, as joins over tables in the folder."""
    key = ["sample_idx", "real"]
    prior = edges.select(*key).distinct().withColumn("weight", F.lit(1.0))  # only ratios within a sample matter

    def joint(prior: DataFrame) -> DataFrame:
        return edges.join(prior.select(*key, "weight").hint("merge"), key).withColumn("joint", F.col("weight") * F.col("p"))

    for k in range(ROUNDS):
        rows = joint(prior)
        totals = rows.groupBy("sample_idx", "umi").agg(F.sum("joint").alias("total"))
        shares = rows.join(totals.hint("merge"), ["sample_idx", "umi"]).where("total > 0")
        shares = shares.withColumn("share", F.col("joint") * F.col("family_size") / F.col("total"))
        sums = shares.groupBy(*key).agg(F.sum("share").alias("share"))
        after = prior.select(*key, F.col("weight").alias("before")).join(sums.hint("merge"), key, "left")
        prior = written(after.withColumn("weight", F.coalesce("share", F.lit(0.0)) + CONCENTRATION), f"prior-{k}", folder)
        if k:
            removed(edges.sparkSession, folder, f"prior-{k - 1}")
        if k and not prior.where(F.abs(F.col("weight") - F.col("before")) > CLOSE * F.col("weight")).limit(1).count():
            break
    best = F.min(F.struct((-F.col("joint")).alias("minus"), "real"))
    rows = joint(prior).groupBy("sample_idx", "umi").agg(best.alias("best"), F.sum("joint").alias("total"))
    return rows.select("sample_idx", "umi", F.col("best.real").alias("parent"), (-F.col("best.minus") / F.col("total")).alias("probability"))


def _sizes(counts: DataFrame, folder: str) -> tuple[DataFrame, dict[int, dict[int, int]], set[int], set[int]]:
    """The tags as a table; by sample, how many it has of each length; samples with tags beyond a number, and with an N."""
    tags = counts.where((F.col("umi") != REJECTS) & (F.length("umi") > 0)).withColumn("sample_idx", F.col("sample_idx").cast("long"))
    tags = written(tags.select("sample_idx", "umi", "family_size"), "tags", folder)
    odd = F.max((F.length("umi") > NUMBER_LETTERS) | ~F.col("umi").rlike("^[ACGTN]*$"))
    by_length = tags.groupBy("sample_idx", F.least(F.length("umi"), F.lit(NUMBER_LETTERS + 1)).alias("size"))
    sizes: dict[int, dict[int, int]] = {}
    found = by_length.agg(F.count("*").alias("n"), odd.alias("odd"), F.max(F.contains("umi", F.lit("N"))).alias("unknown")).collect()  # a row for each sample and length
    for r in found:
        sizes.setdefault(r.sample_idx, {})[r["size"]] = r["n"]
    return tags, sizes, {r.sample_idx for r in found if r["odd"]}, {r.sample_idx for r in found if r["unknown"]}


def _of(tags: DataFrame, samples: list[int]) -> DataFrame:
    return tags.where(F.col("sample_idx").isin(samples))


def _by_sample(tags: DataFrame, samples: list[int]):
    """Samples in tasks of their own: they are few rows but much work, so Spark would put many of them into one task."""
    return _of(tags, samples).repartitionByRange(max(1, min(len(samples), SAMPLE_TASKS)), "sample_idx").groupBy("sample_idx")


def likelihoods(counts: DataFrame, sample_tags: int = SAMPLE_TAGS) -> DataFrame:
    """What two_edit_likelihoods gives; tasks make the edges of PART tags of a sample each."""
    tags, sizes, odd, _ = _sizes(counts, shared_folder(counts.sparkSession))
    large = [k for k, own in sizes.items() if k in odd or sum(own.values()) > MOST * sample_tags]
    small = _of(tags, [k for k in sizes if k not in large])
    samples = small.groupBy("sample_idx").agg(F.sort_array(F.collect_set("umi")).alias("umis"))
    parts = samples.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("umis") - 1) / PART).cast("int"))))
    tasks = max(1, sum(-(-sum(own.values()) // PART) for k, own in sizes.items() if k not in large))
    dealt = parts.repartition(tasks, "sample_idx", "part")
    found = dealt.mapInArrow(_edge_batches, "sample_idx long, umi string, real string, p double")
    return found.unionByName(two_edit_likelihoods(_of(tags, large), unknown=True).select(*found.columns)) if large else found


def _all_assigned(counts: DataFrame, sample_tags: int) -> DataFrame:
    """sample_idx, umi, parent, probability: samples in a task each, those that no task can hold by rounds over tables."""
    folder = shared_folder(counts.sparkSession)
    tags, sizes, odd, unknown = _sizes(counts, folder)
    others = {k: sum(n for size, n in own.items() if not is_full(size, n)) for k, own in sizes.items()}
    small = [k for k, own in sizes.items() if k not in odd and sum(own.values()) <= sample_tags]
    full = [k for k in sizes if k not in small and k not in odd and k not in unknown and others[k] <= OTHERS * sample_tags]
    schema = "sample_idx long, umi string, parent string, probability double"
    found = _by_sample(tags, small).applyInPandas(_assigned, schema)
    if full:
        found = found.unionByName(_by_sample(tags, full).applyInPandas(_assigned_by_steps, schema))
    large = _of(tags, [k for k in sizes if k not in small and k not in full])
    if len(sizes) == len(small) + len(full):
        return found
    edges = written(two_edit_likelihoods(large, unknown=True).join(large.hint("merge"), ["sample_idx", "umi"]), "edges", folder)
    return found.unionByName(_assigned_by_rounds(edges, folder))


def families(counts: DataFrame, threshold: float = 0.995, family_size: int = 5, sample_tags: int = SAMPLE_TAGS) -> DataFrame:
    """sample_idx, umi, parent, family_size, probability, disposition of every tag of sample_idx, umi, family_size."""
    assigned = _all_assigned(counts, sample_tags)
    why = F.when(F.col("umi") == REJECTS, "BPB-rejects").when(F.col("probability") < threshold, "LDA-rejects")
    why = why.when(F.length("umi") != 8, "UMI_len != 8").when(F.col("family_size") < family_size, "family-size-reject")
    rejected = F.col("umi") == REJECTS
    rows = counts.select("sample_idx", "umi", "family_size").join(assigned.hint("merge"), ["sample_idx", "umi"], "left")
    rows = rows.withColumn("parent", F.when(rejected, REJECTED).otherwise(F.col("parent")))
    rows = rows.withColumn("probability", F.when(rejected, REJECTED_PROBABILITY).otherwise(F.coalesce("probability", F.lit(0.0))))
    return rows.withColumn("disposition", why.otherwise("likely_real"))
