"""Annotations of consensus records: reading frames, filters with reasons, nearest references, names and exports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from ..functions import nucleotides as nt
from ..sources.shared import written

#: The gates of a record in the order in which they are reported.
PASSES = ("artefact_pass", "agreement_pass", "contamination_pass", "panel_pass")

#: References up to this number are broadcast; more are joined by a shuffle.
BROADCAST_REFERENCES = 20_000
#: References up to this number are compared as one array, and letters of records that are compared at once.
ARRAY_REFERENCES, LETTERS = 1_000, 100_000


_CODONS = {a + b + c: nt.AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(nt.CODON_BASES) for j, b in enumerate(nt.CODON_BASES) for k, c in enumerate(nt.CODON_BASES)}
_FRAME = re.compile(r"M[^*]*\*")


def longest_orf(sequence: str) -> str | None:
    """The longest stretch from ATG to a stop in any of three frames (ties: first frame, first start)."""
    text, best = sequence.upper().replace("U", "T"), (0, 0, 0)
    for frame in range(3):
        protein = "".join([_CODONS.get(text[k : k + 3], "X") for k in range(frame, len(text) - 2, 3)])
        for m in _FRAME.finditer(protein):
            best = max(best, (m.end() - m.start(), -frame, -m.start()))
    n, frame, start = best
    first = -frame - 3 * start
    return sequence[first : first + 3 * n] if n else None


def longest_orfs(sequences: DataFrame) -> DataFrame:
    """sequence, orf: of each distinct sequence that has one, its longest_orf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("sequence")
            yield pa.RecordBatch.from_arrays([texts, pa.array([longest_orf(x) for x in texts.to_pylist()], pa.string())], ["sequence", "orf"])

    found = sequences.select("sequence").where("sequence IS NOT NULL").distinct().mapInArrow(run, "sequence string, orf string")
    return found.where("orf IS NOT NULL")


def with_passes(records: DataFrame, discarded: DataFrame, cutoffs: DataFrame, agreement: float) -> DataFrame:
    """records (sample_idx, fam, family_size, agreement) with PASSES and the reasons of those that failed, in order.

    discarded: fam of contaminants; cutoffs: sample_idx, cutoff. Records that no panel scored pass it.
    """
    bad = discarded.select("fam").distinct().withColumn("bad", F.lit(True))
    rows = records.join(cutoffs.select("sample_idx", "cutoff"), "sample_idx", "left").join(bad, "fam", "left")
    score = F.col("panel_score") if "panel_score" in records.columns else F.lit(None).cast("double")
    limit = F.col("panel_threshold") if "panel_threshold" in records.columns else F.lit(None).cast("double")
    rows = rows.withColumns(
        {
            "artefact_pass": F.coalesce(F.col("family_size") >= F.col("cutoff"), F.lit(True)),
            "agreement_pass": F.col("agreement") >= agreement,
            "contamination_pass": F.col("bad").isNull(),
            "panel_pass": F.coalesce(score < limit, F.lit(True)),
        }
    )
    texts = (
        F.concat(F.lit("ccs_count < artefact cutoff ("), F.col("cutoff"), F.lit(")")),
        F.lit(f"minimum_agreement < {agreement}"),
        F.lit("contamination filter"),
        F.concat(F.lit("distance_from_panel >= "), limit),
    )
    reasons = F.array_compact(F.array(*[F.when(~F.col(p), t) for p, t in zip(PASSES, texts)]))
    passed = F.col(PASSES[0]) & F.col(PASSES[1]) & F.col(PASSES[2]) & F.col(PASSES[3])
    return rows.withColumns({"passed": passed, "reasons": F.array_join(reasons, "; ")}).drop("bad")


def filter_flow(records: DataFrame) -> DataFrame:
    """sample_idx, step, n: how many records are left after each gate in turn, from one aggregate."""
    left, counts = F.lit(True), [F.count("*").alias("consensus")]
    for name in PASSES:
        left = left & F.col(name)
        counts.append(F.count_if(left).alias(name.removesuffix("_pass")))
    steps = ["consensus", *[p.removesuffix("_pass") for p in PASSES]]
    return records.groupBy("sample_idx").agg(*counts).unpivot("sample_idx", steps, "step", "n")


def agreement_bins(records: DataFrame, bins: int = 101) -> DataFrame:
    """sample_idx, bin, n: records by agreement, rounded half up to one of the bins."""
    top = bins - 1
    place = F.least(F.greatest(F.floor(F.col("agreement") * top + 0.5), F.lit(0)), F.lit(top)).cast("long")
    return records.groupBy("sample_idx", place.alias("bin")).agg(F.count("*").alias("n"))


def two_decimals(share: Column) -> Column:
    """A share from 0 to 1 with two decimals, as printf rounds: by its exact binary value, a tie to the even digit.

    Spark's own formats round half up, and by the shortest decimals of a number. A share above 1/512 is a whole number of
    2**-62; smaller ones only lose bits far below the first decimal that counts.
    """
    scaled = 100 * (share * 2.0**62).cast("long").cast("decimal(38,0)")
    one = F.lit(2**62).cast("decimal(38,0)")
    whole = F.call_function("div", scaled, one)
    rest = 2 * (scaled - whole * one)
    up = (rest > one) | (rest == one) & (whole % 2 == 1)
    hundredths = (whole + up.cast("long")).cast("long")
    exact = F.concat(F.call_function("div", hundredths, F.lit(100)).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    return F.when(share.between(0, 1), exact).otherwise(F.format_string("%.2f", share))


def display_name(fam: Column, size: Column, agreement: Column) -> Column:
    return F.concat(fam.cast("string"), F.lit(" fs="), size.cast("string"), F.lit(" minag="), two_decimals(agreement.cast("double")))


def fasta_record(name: Column, sequence: Column, width: int = 80) -> Column:
    """A FASTA record without its last line end; width 0: the sequence on one line."""
    lines = F.regexp_replace(sequence, f"(.{{{width}}})(?!$)", "$1\n") if width else sequence
    return F.concat(F.lit(">"), name, F.lit("\n"), lines)


def _words(texts: list[str], k: int) -> np.ndarray:
    """The k-mers of each text as numbers, a row for each text; -1 behind the last one."""
    sizes = np.array([len(t) for t in texts])
    width = int(max(sizes.max(initial=0), k))
    letters = np.zeros((len(texts), width), np.uint32)
    for row, text in zip(letters, texts):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, codes = np.unique(letters, return_inverse=True)
    if len(kinds) ** k < 1 << 62:
        codes, out = codes.reshape(letters.shape).astype(np.int64), np.zeros((len(texts), width - k + 1), np.int64)
        for at in range(k):
            out = out * len(kinds) + codes[:, at : at + out.shape[1]]
    else:
        seen: dict[str, int] = {}
        out = np.array([[seen.setdefault(t[at : at + k], len(seen)) for at in range(width - k + 1)] for t in texts], np.int64)
    out[np.arange(out.shape[1]) > (sizes - k)[:, None]] = -1
    return out


def _squares(words: np.ndarray) -> np.ndarray:
    """The sum of the squared counts of each row's words."""
    rows = np.sort(words, axis=1)
    first = np.concatenate((np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]), axis=1)
    heads = np.flatnonzero(first)
    n = np.diff(np.append(heads, rows.size))
    n[rows.ravel()[heads] < 0] = 0
    return np.bincount(heads // rows.shape[1], n * n, len(rows)).astype(np.int64)


class References(NamedTuple):
    """References in order, with the places of their groups."""

    texts: list[str]
    group: np.ndarray
    k: int

    def nearest(self, texts: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By text: whether it shares a k-mer with a reference, its distance to its own group (not finite where there is none),
        and place and distance of the nearest reference of another one. Groups below 0 are unknown."""
        words = _words([*self.texts, *texts], self.k)
        total, square = (words >= 0).sum(axis=1), _squares(words)
        known, m = np.unique(words[: len(self.texts)]), len(self.texts)
        known = known[known >= 0]
        own = words[:m]
        most = int(total.max(initial=0)) ** 2
        counts = np.zeros((len(known) + 1, m), np.int16 if most < 1 << 15 else np.int64)
        row, at = np.nonzero(own >= 0)
        np.add.at(counts, (np.searchsorted(known, own[row, at]), row), 1)
        asked = words[m:]
        place = np.searchsorted(known, asked)
        place[(place == len(known)) | (np.append(known, -2)[place] != asked)] = len(known)  # a row of zeros
        dots = np.zeros((len(texts), m), counts.dtype)
        for column in place.T:
            dots += counts[column]
        squared = np.maximum(square[m:, None] + square[:m] - 2 * dots.astype(np.int64), 0)
        shared = dots > 0
        distance = np.where(shared, squared / np.maximum(self.k * (total[m:, None] + total[:m]), 1), np.inf)
        known_group = (group[:, None] >= 0) & (self.group >= 0)
        same = group[:, None] == self.group
        of_own, other = np.where(known_group & same, distance, np.inf).min(axis=1), np.where(known_group & ~same, distance, np.inf)
        best = other.argmin(axis=1)
        return shared.any(axis=1), of_own, best, other[np.arange(len(texts)), best]


def _nearest_in_tasks(records: DataFrame, ref: DataType, rows: list, threshold: float, k: int) -> DataFrame:
    """What nearest_references gives for few references (ref, group, text) and records with different fam."""
    rows = sorted((r for r in rows if r.ref is not None), key=lambda r: r.ref)
    groups = {g: n for n, g in enumerate(dict.fromkeys(r.group for r in rows if r.group is not None))}
    references = References([r.text or "" for r in rows], np.array([groups.get(r.group, -1) for r in rows]), k)
    fam, kind = records.schema["fam"].dataType, to_arrow_type(ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            group = np.array([-1 if g is None else groups.get(g, len(groups)) for g in batch.column("group").to_pylist()])
            size = max(1, LETTERS // max(map(len, texts), default=1)) if any(texts) else len(texts)
            for first in range(0, len(texts), max(1, size)):
                some, own, at, other = references.nearest(texts[first : first + size], group[first : first + size])
                keep, found = np.flatnonzero(some), np.isfinite(other)
                yield pa.RecordBatch.from_arrays([
                    batch.column("fam").take(pa.array(first + keep)), pa.array(own[keep], mask=~np.isfinite(own[keep])),
                    pa.array([rows[k].ref if ok else None for k, ok in zip(at[keep].tolist(), found[keep].tolist())], kind), pa.array(other[keep], mask=~found[keep]),
                ], ["fam", "own_distance", "nearest", "distance"])

    asked = records.where("fam IS NOT NULL").select("fam", "group", nt.degapped(F.col("sequence")).alias("text"))
    out = StructType().add("fam", fam).add("own_distance", "double").add("nearest", ref).add("distance", "double")
    called = F.coalesce((F.col("distance") < threshold) & ~F.coalesce(F.col("own_distance") <= threshold, F.lit(False)), F.lit(False))
    return asked.mapInArrow(run, out).withColumn("called", called)


def nearest_references(records: DataFrame, references: DataFrame, threshold: float, k: int = 6, different: bool = False) -> DataFrame:
    """fam, own_distance, nearest, distance, called: the nearest reference of another group, by k-mer counts.

    different: no two records have the same fam, and no two references the same ref. Few references (ARRAY_REFERENCES) are
    then compared in the tasks of the records, without a join on k-mers.

    records: fam, group, sequence; references: ref, group, sequence. The distance is the squared difference of the
    counts over k times their sum. References that share no k-mer with a record lie at 1/k or more and are never
    called below that, so the join on k-mers loses none; a threshold above it is refused. Ties: the smallest ref.
    """
    if threshold > 1 / k:
        raise ValueError("beyond 1/k, references without a common k-mer would count")
    if different:
        references = written(references.select("ref", "group", "sequence"), "references")
        rows = references.select("ref", "group", nt.degapped(F.col("sequence")).alias("text")).limit(ARRAY_REFERENCES + 1).collect()
        if 0 < len(rows) <= ARRAY_REFERENCES:
            return _nearest_in_tasks(records, references.schema["ref"].dataType, rows, threshold, k)

    def vectors(df: DataFrame, key: str, n: str) -> tuple[DataFrame, DataFrame]:
        rows = df.select(key, F.explode(nt.kmers(nt.degapped(F.col("sequence")), k)).alias("kmer"))
        rows = rows.groupBy(key, "kmer").agg(F.count("*").alias(n))
        return rows, rows.groupBy(key).agg(F.sum(F.col(n) * F.col(n)).alias(f"{n}_square"), F.sum(n).alias(f"{n}_total"))

    (a, a_norm), (b, b_norm) = vectors(records, "fam", "a"), vectors(references, "ref", "b")
    few = references.count() <= BROADCAST_REFERENCES
    near = F.broadcast if few else (lambda df: df)
    dots = a.join(near(b), "kmer").groupBy("fam", "ref").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    pairs = dots.join(a_norm, "fam").join(near(b_norm), "ref")
    square = F.greatest(F.col("a_square") + F.col("b_square") - 2 * F.col("dot"), F.lit(0))
    pairs = pairs.withColumn("distance", square / (k * (F.col("a_total") + F.col("b_total"))))
    groups = references.select("ref", F.col("group").alias("ref_group"))
    pairs = pairs.join(records.select("fam", "group"), "fam").join(near(groups), "ref")
    own, other = F.col("group") == F.col("ref_group"), F.struct("distance", "ref")
    best = pairs.groupBy("fam").agg(F.min(F.when(own, F.col("distance"))).alias("own_distance"), F.min(F.when(~own, other)).alias("best"))
    called = F.coalesce((F.col("best.distance") < threshold) & ~F.coalesce(F.col("own_distance") <= threshold, F.lit(False)), F.lit(False))
    return best.select("fam", "own_distance", F.col("best.ref").alias("nearest"), F.col("best.distance").alias("distance"), called.alias("called"))


def modal_tips(rows: DataFrame) -> DataFrame:
    """sample_idx, sequence, weight: the sequence of most families in each sample, ties to the one seen first."""
    sums = rows.groupBy("sample_idx", "sequence").agg(F.countDistinct("fam").alias("weight"), F.min("fam").alias("first"))
    order = F.min(F.struct((-F.col("weight")).alias("w"), "first", "sequence")).alias("best")
    return sums.groupBy("sample_idx").agg(order).select("sample_idx", "best.sequence", (-F.col("best.w")).alias("weight"))
