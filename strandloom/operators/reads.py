"""Relational operators on demultiplexed reads: gates, UMI families, haplotypes and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import nucleotides as nt

GATES = ("quality", "short", "long")


def gate(error_rate: float, min_length: int, max_length: int) -> Column:
    """The first gate that rejects a read (bounds are excluded), or null."""
    n = F.length("sequence")
    return F.when(F.col("error") >= error_rate, "quality").when(n <= min_length, "short").when(n >= max_length, "long")


def input_funnel(reads: DataFrame, error_rate: float, min_length: int, max_length: int) -> DataFrame:
    """stage, n: reads, rejects by gate and passes, from one aggregate."""
    why = gate(error_rate, min_length, max_length)
    counts = reads.agg(F.count("*").alias("reads"), *[F.count_if(why == g).alias(g) for g in GATES], F.count_if(why.isNull()).alias("passed"))
    return counts.unpivot([], ["reads", *GATES, "passed"], "stage", "n")


def umi_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sample_idx", "umi").agg(F.count("*").alias("family_size"))


def sample_counters(reads: DataFrame) -> DataFrame:
    by_umi = umi_counts(reads)
    return by_umi.groupBy("sample_idx").agg(F.sum("family_size").alias("reads"), F.count("*").alias("families"), F.max("family_size").alias("largest"))


def substitution_neighbours(counts: DataFrame) -> DataFrame:
    """sample_idx, umi, neighbour, n: pairs of UMIs of a sample that differ in one base, by a join on masked UMIs."""
    masks = F.transform(F.sequence(F.lit(1), F.length("umi")), lambda i: F.concat(F.substring("umi", F.lit(1), i - 1), F.lit("_"), F.substring(F.col("umi"), i + 1, F.length("umi"))))
    own = counts.select("sample_idx", "umi", "family_size", F.explode(masks).alias("mask"))
    other = own.select("sample_idx", "mask", F.col("umi").alias("neighbour"), F.col("family_size").alias("neighbour_size"))
    pairs = own.join(other, ["sample_idx", "mask"]).where("umi <> neighbour")
    return pairs.select("sample_idx", "umi", "neighbour", "family_size", "neighbour_size")


def disposition(size: Column, umi: Column, threshold: int) -> Column:
    return F.when(F.length(umi) != 8, "UMI_len != 8").when(size < threshold, "family-size-reject").otherwise("likely_real")


def call_stats(counts: DataFrame, threshold: int) -> DataFrame:
    """Families and reads by sample and disposition, and their percentages in the sample."""
    rows = counts.groupBy("sample_idx", disposition(F.col("family_size"), F.col("umi"), threshold).alias("disposition"))
    rows = rows.agg(F.count("*").alias("families"), F.sum("family_size").alias("reads"))
    sample = Window.partitionBy("sample_idx")
    percent = lambda c: F.round(100.0 * F.col(c) / F.sum(c).over(sample), 6).alias(f"{c}_percent")
    return rows.select("*", percent("families"), percent("reads"))


def artefact_cutoffs(counts: DataFrame, quantile: float, fraction: float) -> DataFrame:
    """sample_idx, cutoff, families below it: the cutoff is a fraction of a high quantile of the family sizes."""
    cut = counts.groupBy("sample_idx").agg(F.ceil(F.percentile("family_size", F.lit(quantile)) * fraction).cast("long").alias("cutoff"))
    return counts.join(cut, "sample_idx").groupBy("sample_idx", "cutoff").agg(F.count_if(F.col("family_size") < F.col("cutoff")).alias("below"))


def haplotypes(reads: DataFrame) -> DataFrame:
    """Identical ungapped sequences by sample, ranked by members and then by sequence."""
    groups = reads.groupBy("sample_idx", nt.degapped(F.col("sequence")).alias("haplotype")).agg(F.countDistinct("fam").alias("families"))
    rank = F.row_number().over(Window.partitionBy("sample_idx").orderBy(F.desc("families"), "haplotype"))
    name = lambda r: F.concat(F.lit("v"), r.cast("string"), F.lit("_"), F.col("families").cast("string"))
    return groups.withColumn("variant", rank.cast("long")).withColumn("name", name(F.col("variant")))


def kmer_counts(reads: DataFrame, k: int = 6) -> DataFrame:
    return reads.select(F.explode(nt.kmers(F.col("sequence"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def dinucleotides(counts: DataFrame) -> DataFrame:
    """Pairs of neighbouring bases in UMIs, by family and by read, with shares."""
    pairs = counts.select("family_size", F.explode(nt.kmers(F.col("umi"), 2)).alias("pair"))
    rows = pairs.groupBy("pair").agg(F.count("*").alias("families"), F.sum("family_size").alias("reads"))
    total = rows.agg(F.sum("families").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("pair", "families", "reads", F.round(F.col("families") / F.col("total"), 8).alias("share"))  # one row


def consensus(reads: DataFrame) -> DataFrame:
    """Each family's most frequent base at every position (ties: the first in the alphabet) and its least agreement.

    Families without a base give no row. One shuffle; a task keeps counts by position, not a family's reads.
    """
    own = reads.select("fam", "sequence").where(F.length("sequence") > 0).repartition("fam").sortWithinPartitions("fam")
    kind = own.schema["fam"].dataType.simpleString()
    return own.mapInArrow(_voted, f"fam {kind}, sequence string, share double").select("fam", "sequence", F.round("share", 6).alias("agreement"))


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fam, sequence, share of families whose reads come one after another."""
    open_fam, open_counts, kind = None, {}, None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, fams = batch.column("fam").type, batch.column("fam").to_pylist()
        texts = np.array(batch.column("sequence").to_pylist())
        letters = texts.view(np.uint32).reshape(len(texts), -1)
        heads = np.array([0, *(k for k in range(1, len(fams)) if fams[k] != fams[k - 1])])
        counts = {int(c): np.add.reduceat(letters == c, heads, axis=0, dtype=np.int64) for c in np.unique(letters) if c}
        own = [fams[k] for k in heads.tolist()]
        if open_counts and own[0] == open_fam:
            for c, n in open_counts.items():
                rows = counts.setdefault(c, np.zeros((len(own), letters.shape[1]), np.int64))
                if rows.shape[1] < len(n):
                    counts[c] = rows = np.pad(rows, ((0, 0), (0, len(n) - rows.shape[1])))
                rows[0, : len(n)] += n
        elif open_counts:
            yield _winners([open_fam], {c: n[None] for c, n in open_counts.items()}, kind)
        if len(own) > 1:
            yield _winners(own[:-1], {c: n[:-1] for c, n in counts.items()}, kind)
        open_fam, open_counts = own[-1], {c: n[-1] for c, n in counts.items() if n[-1].any()}
    if open_counts:
        yield _winners([open_fam], {c: n[None] for c, n in open_counts.items()}, kind)


def _winners(fams: list, counts: dict[int, np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    width, order = max(n.shape[1] for n in counts.values()), sorted(counts)
    votes = np.stack([np.pad(counts[c], ((0, 0), (0, width - counts[c].shape[1]))) for c in order])
    total, most = votes.sum(axis=0), votes.max(axis=0)
    best = np.where(total > 0, np.array(order, np.uint32)[votes.argmax(axis=0)], 0).astype(np.uint32)
    share = np.divide(most, total, out=np.ones(total.shape), where=total > 0).min(axis=1)
    texts = np.ascontiguousarray(best).view(f"U{width}").ravel().tolist()
    return pa.RecordBatch.from_arrays([pa.array(fams, kind), pa.array(texts, pa.string()), pa.array(share)], ["fam", "sequence", "share"])
