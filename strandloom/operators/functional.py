"""Functional filter: reading frames of a group are aligned as proteins, a reference is added to their fixed profile, and each
frame is judged by the columns that the reference spans.

Proteins are aligned in rounds (see msa), so a group may have any number of rows; what the reference is aligned with is a
group's counts of letters by column. Rows are then judged in tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..sources.shared import shared_folder, written
from . import msa, panel
from .annotations import _CODONS, longest_orf

#: Why a sequence fails.
AMBIGUOUS, NO_FRAME, LATE, EARLY = "ambiguousSymbols-reject", "noORF-reject", "lateStart-reject", "earlyStop-reject"
DIGITS = 3
GROUPS_AT_ONCE = 2_000


class Verdict(NamedTuple):
    passed: bool
    reasons: list[str]
    match: float
    nt: str
    aa: str


def translated(text: str) -> str:
    return "".join(_CODONS.get(text[k : k + 3], "X") for k in range(0, len(text) - 2, 3))


def rounded(value: float, digits: int) -> float:
    """To so many decimals, halves of the exact value away from zero."""
    return float(Decimal(value).quantize(Decimal(1).scaleb(-max(0, digits)), ROUND_HALF_UP))


def significant(value: float) -> float:
    """To DIGITS significant digits."""
    return rounded(value, DIGITS if not value else DIGITS - math.floor(math.log10(abs(value))) - 1)


def columns_of(reference: str, counts: np.ndarray, rows: int) -> list[tuple[int, str]]:
    """The reference's letters as (column, letter) with the columns between its ends that it skips (letter "-"), in order; a
    letter of its own between two columns has column -1."""
    at = panel.mapped(panel.Panel(rows, counts), [reference])[0].tolist()
    out: list[tuple[int, str]] = []
    last = -1
    for letter, column in zip(reference, at):
        if column >= 0:
            if last >= 0:
                out += [(k, "-") for k in range(last + 1, column)]
            last = column
        out.append((column, letter))
    return out


def judged(orf: str, aligned: str, span: list[tuple[int, str]], reference: str, threshold: float) -> Verdict:
    """A frame by its row of the protein alignment and the reference's span of columns; reference: its coding letters."""
    codon = iter([orf[k : k + 3] for k in range(0, len(orf), 3)])
    query = [next(codon) if c != "-" else "---" for c in aligned]
    own = iter([reference[k : k + 3] for k in range(0, len(reference), 3)])
    region = [(query[k] if k >= 0 else "---", next(own) if letter != "-" else "---") for k, letter in span]
    left, right = "".join(q for q, _ in region), "".join(r for _, r in region)
    reasons = [LATE] if left[:3] != "ATG" else []
    reasons += [EARLY] if left[-3:] == "---" else []
    share = sum(a == b for a, b in zip(left, right)) / max(1, len(right))
    ratio = significant(share)
    if ratio < threshold:
        reasons.append(f"badMatch-reject (match={ratio:g})")
    nt = left.replace("-", "")
    return Verdict(not reasons, reasons, rounded(share, 2), nt, translated(nt))


_SPAN = "group string, columns array<int>, letters array<string>"


def _spans(protein: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((int(rows["slot"].max()) + 1, 128), np.int64)
        letters = np.array([ord(c) for c in rows["letter"]])
        counts[rows["slot"].to_numpy(), letters] = rows["n"].to_numpy()
        span = columns_of(protein, counts, int(counts[0].sum()))
        return pd.DataFrame({"group": [rows["group"].iloc[0]], "columns": [[k for k, _ in span]], "letters": [[c for _, c in span]]})

    return run


def _framed(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["".join((x or "").split()).replace("-", "").upper().replace("U", "T") for x in batch.column("__text").to_pylist()]
            why = [AMBIGUOUS if set(t) - set("ACGT") else None for t in texts]
            frames = [None if w else longest_orf(t) for t, w in zip(texts, why)]
            why = [w or (None if f else NO_FRAME) for w, f in zip(why, frames)]
            proteins = [translated(f) if f else None for f in frames]
            arrays = [pa.array(x, pa.string()) for x in (frames, proteins, why)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], [*names, "__orf", "__protein", "__why"])

    return run


def functional_filter(rows: DataFrame, group: str, reference: str, sequence: str = "sequence", threshold: float = 0.7) -> DataFrame:
    """rows with functional_pass, functional_reasons, reference_match, trimmed_nt, trimmed_aa.

    reference: its coding letters; what is behind its last whole codon does not count. Gaps and white space of sequences do not
    count; null sequences count as empty and have no frame. Only frames are aligned with one another, group by group.
    """
    coding = "".join(reference.split()).replace("-", "").upper().replace("U", "T")
    coding = coding[: len(coding) // 3 * 3]
    protein = translated(coding)
    if not protein:
        raise ValueError("the reference has no codon")
    folder, names = shared_folder(rows.sparkSession), rows.columns
    schema = StructType([*rows.schema.fields]).add("__orf", "string").add("__protein", "string").add("__why", "string")
    framed = rows.withColumn("__text", F.col(f"`{sequence}`")).mapInArrow(_framed(names), schema)
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("null"))
    framed = written(framed.withColumn("__group", name), "framed", folder)
    frames = written(msa.multiple_alignment(framed.where("__orf IS NOT NULL"), "__group", "__protein").withColumnRenamed("aligned", "__aligned"), "aligned", folder)
    letters = frames.select(F.col("__group").alias("group"), F.posexplode(F.filter(F.split("__aligned", ""), lambda c: c != "")).alias("slot", "letter"))
    counts = letters.groupBy("group", "slot", "letter").agg(F.count("*").alias("n"))
    spans = written(counts.groupBy("group").applyInPandas(_spans(protein), _SPAN), "spans", folder)
    spans = spans.select(F.col("group").alias("__group"), F.col("columns").alias("__columns"), F.col("letters").alias("__letters"))
    spans = F.broadcast(spans) if spans.count() <= GROUPS_AT_ONCE else spans
    out = StructType([*rows.schema.fields])
    for field, kind in (("functional_pass", "boolean"), ("functional_reasons", ArrayType(StringType())), ("reference_match", "double"), ("trimmed_nt", "string"), ("trimmed_aa", "string")):
        out = out.add(field, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = zip(*(batch.column(c).to_pylist() for c in ("__orf", "__aligned", "__columns", "__letters")))
            found = [judged(orf, aligned, list(zip(columns, own)), coding, threshold) for orf, aligned, columns, own in inputs]
            columns = list(zip(*found)) or [[]] * 5
            kinds = [pa.bool_(), pa.list_(pa.string()), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, t) for c, t in zip(columns, kinds))], out.names)

    good = frames.join(spans, "__group").mapInArrow(run, out)
    none = F.lit(None)
    lost = framed.where("__orf IS NULL").select(
        *[F.col(f"`{n}`") for n in names], F.lit(False).alias("functional_pass"), F.array("__why").alias("functional_reasons"),
        none.cast("double").alias("reference_match"), none.cast("string").alias("trimmed_nt"), none.cast("string").alias("trimmed_aa"),
    )
    return good.unionByName(lost)
