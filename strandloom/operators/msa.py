"""Multiple alignment of groups of any size around an anchor, as rounds over all sequences.

A group's first anchor is its most frequent sequence. In each round every different sequence is aligned with its group's
anchor, all of them vote on each of the anchor's letters and on what stands between them, and what most say is the next
anchor. When it stays, or after ROUNDS, each slot between two letters becomes as wide as its longest insertion. Sequences
are aligned in tasks of their own; what is kept of a group is one row with its anchor and its slots.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import removed, shared_folder, written
from . import alignment

ROUNDS = 3
#: Groups up to which their anchors are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 2_000


def parts(anchor: str, sequence: str, path: np.ndarray) -> tuple[list[str], list[str]]:
    """What stands before each letter of the anchor and behind the last, and what stands at each letter ("" for a gap)."""
    if not anchor:
        return [sequence], []
    before, until = (x.tolist() for x in alignment.places(path))
    edges = [0, *until]
    return [sequence[a:b] for a, b in zip(edges, [*before, len(sequence)])], [sequence[a:b] for a, b in zip(before, until)]


def row(between: list[str], at: list[str], widths: list[int]) -> str:
    """A row of the alignment; what stands before the first letter is pushed to the right, all else to the left."""
    out = [between[0].rjust(widths[0], "-")]
    for letter, text, width in zip(at, between[1:], widths[1:]):
        out += [letter or "-", text.ljust(width, "-")]
    return "".join(out)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, slot, value, n): 2k is the place before letter k and 2k + 1 the letter; summed over a batch."""
    for batch in batches:
        groups, anchors, texts, counts = (batch.column(c).to_pylist() for c in ("group", "anchor", "sequence", "n"))
        votes: dict[tuple[str, int, str], int] = defaultdict(int)
        for group, anchor, text, n, path in zip(groups, anchors, texts, counts, alignment.seeded_steps(list(zip(anchors, texts)))):
            between, at = parts(anchor, text, path)
            for k, value in enumerate(between):
                votes[group, 2 * k, value] += n
            for k, value in enumerate(at):
                votes[group, 2 * k + 1, value] += n
        columns = list(zip(*[(*key, n) for key, n in votes.items()])) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["group", "slot", "value", "n"])


def _rows(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, texts, widths = (batch.column(c).to_pylist() for c in ("__anchor", "__text", "__widths"))
            paths = alignment.seeded_steps(list(zip(anchors, texts)))
            out = [row(*parts(a, t, path), w) for a, t, w, path in zip(anchors, texts, widths, paths)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, "aligned"])

    return run


def _beside(rows: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    """rows with their group's row, which is broadcast where there are few groups."""
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, on)


def multiple_alignment(rows: DataFrame, group: str, sequence: str = "sequence", rounds: int = ROUNDS) -> DataFrame:
    """rows with aligned: as long as all others of the row's group, and the row's sequence without its gaps.

    Gaps in sequences do not count; null sequences count as empty; rows with a null group are a group of their own.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("null"))
    text = F.upper(F.regexp_replace(F.coalesce(F.col(f"`{sequence}`"), F.lit("")), "-", ""))
    distinct = written(rows.select(name.alias("group"), text.alias("sequence")).groupBy("group", "sequence").agg(F.count("*").alias("n")), "distinct", folder)
    anchors = written(distinct.groupBy("group").agg(F.min_by("sequence", F.struct(-F.col("n"), "sequence")).alias("anchor")), "anchors", folder)
    total = F.sum("n").over(_window())
    for k in range(rounds + 1):
        votes = _beside(distinct, anchors, "group").select("group", "anchor", "sequence", "n").mapInArrow(_voted, "group string, slot int, value string, n long")
        votes = written(votes.groupBy("group", "slot", "value").agg(F.sum("n").alias("n")), f"votes-{k}", folder)
        if k == rounds:
            break
        sizes = votes.withColumn("total", total)
        best = sizes.groupBy("group", "slot").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"), (2 * F.sum(F.when(F.col("value") == "", F.col("n")).otherwise(0)) >= F.max("total")).alias("empty"))
        # between two letters only what most sequences have there, whatever it is, makes the anchor longer
        filled = sizes.where("value <> ''").groupBy("group", "slot").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("filled"))
        best = best.join(filled, ["group", "slot"], "left").select("group", "slot", F.when(F.col("slot") % 2 == 1, F.col("value")).when(F.col("empty"), "").otherwise(F.col("filled")).alias("value"))
        letters = F.array_sort(F.collect_list(F.struct("slot", "value")))
        then = best.groupBy("group").agg(F.array_join(F.transform(letters, lambda x: x["value"]), "").alias("anchor"))
        then = written(then, f"anchors-{k}", folder)
        moved = then.join(anchors.withColumnRenamed("anchor", "before"), "group").where("anchor <> before").limit(1).count()
        if not moved:
            break
        anchors = then
        removed(spark, folder, f"votes-{k}")
    widths = votes.where("slot % 2 = 0").groupBy("group", "slot").agg(F.max(F.length("value")).alias("width"))
    widths = widths.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "width"))), lambda x: x["width"]).alias("__widths"))
    shape = written(anchors.join(widths, "group").select(F.col("group").alias("__group"), F.col("anchor").alias("__anchor"), "__widths"), "shape", folder)
    schema = StructType([*rows.schema.fields]).add("aligned", "string")
    return _beside(rows.withColumns({"__group": name, "__text": text}), shape, "__group").mapInArrow(_rows(rows.columns), schema)


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("group", "slot")
