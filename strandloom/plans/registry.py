"""Registered queries on reads, with the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nucleotides as nt
from ..operators import alignment
from ..operators import reads as ops
from .reads import DUCK_READS, reads

Query = Callable[[SparkSession, str], DataFrame]
ERROR, SHORT, LONG = 0.05, 42, 62

_WITH = f"WITH r AS ({DUCK_READS}), u AS (SELECT sample_idx, umi, count(*) AS family_size FROM r GROUP BY ALL) "
_KMERS = "unnest(list_transform(range(1, length({s}) - {k} + 2), lambda i: substr({s}, i, {k})))"
_GATE = f"CASE WHEN error >= {ERROR} THEN 'quality' WHEN length(sequence) <= {SHORT} THEN 'short' WHEN length(sequence) >= {LONG} THEN 'long' END"


def _founders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).groupBy((F.col("fam") % 97).alias("founder")).agg(F.max(F.substring("sequence", 1, 40)).alias("sequence"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _founders(spark, sf_dir)
    other = rows.select(F.col("founder").alias("other"), F.col("sequence").alias("other_sequence"))
    share = nt.mismatch_share(F.col("sequence"), F.col("other_sequence"))
    pairs = rows.join(F.broadcast(other), F.col("founder") < F.col("other"))  # 97 founders at any scale
    return pairs.select("founder", "other", F.round(share, 8).alias("mismatch"), F.round(nt.jukes_cantor(share), 8).alias("jc69"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct sequence with the one of its founder that most reads have, aligned from end to end."""
    counts = reads(spark, sf_dir).groupBy((F.col("fam") % 97).alias("founder"), "sequence").agg(F.count("*").alias("n"))
    modal = counts.groupBy("founder").agg(F.min(F.struct((-F.col("n")).alias("n"), "sequence")).alias("best")).select("founder", F.col("best.sequence").alias("reference"))
    pairs = counts.join(modal, "founder").select("founder", "reference", F.col("sequence").alias("query"))
    return alignment.global_alignments(pairs)


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most about 200 reads of each sample."""
    names = reads(spark, sf_dir).withColumns({"sample": F.col("sample_idx").cast("string"), "name": F.concat_ws("|", "fam", "sequence", "error")})
    return alignment.downsampled(names, 200).select("sample_idx", "fam", "sequence", "error")


QUERIES: dict[str, tuple[Query, str]] = {
    "global_alignment": (alignments, ""),
    "downsampled_reads": (sampled, ""),
    "translated_alignment": (
        lambda s, d: reads(s, d).select(F.concat(F.substring("sequence", 1, 9), F.lit("---"), F.substring("sequence", 10, 100)).alias("aligned")).distinct().select("aligned", nt.translated_alignment(F.col("aligned")).alias("protein")),
        _WITH
        + f"""SELECT aligned, array_to_string(list_transform(range(1, length(aligned) + 1, 3), lambda i: CASE WHEN substr(aligned, i, 3) = '---' THEN '-' WHEN length(substr(aligned, i, 3)) < 3 OR instr(substr(aligned, i, 3), '-') > 0 THEN 'X'
          ELSE substr('{nt.AMINO_ACIDS}', (instr('TCAG', substr(aligned, i, 1)) - 1) * 16 + (instr('TCAG', substr(aligned, i + 1, 1)) - 1) * 4 + instr('TCAG', substr(aligned, i + 2, 1)), 1) END), '') AS protein
          FROM (SELECT DISTINCT concat(substr(sequence, 1, 9), '---', substr(sequence, 10)) AS aligned FROM r)""",
    ),
    "umi_counts": (lambda s, d: ops.umi_counts(reads(s, d)), _WITH + "SELECT * FROM u"),
    "sample_counters": (
        lambda s, d: ops.sample_counters(reads(s, d)),
        _WITH + "SELECT sample_idx, CAST(sum(family_size) AS BIGINT) AS reads, count(*) AS families, max(family_size) AS largest FROM u GROUP BY sample_idx",
    ),
    "input_funnel": (
        lambda s, d: ops.input_funnel(reads(s, d), ERROR, SHORT, LONG),
        _WITH + f"SELECT coalesce({_GATE}, 'passed') AS stage, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'reads', count(*) FROM r",
    ),
    "reverse_complement": (
        lambda s, d: reads(s, d).select("sequence", nt.reverse_complement(F.col("sequence")).alias("reversed")).distinct(),
        _WITH + "SELECT DISTINCT sequence, reverse(translate(sequence, 'ACGT', 'TGCA')) AS reversed FROM r",
    ),
    "translate_codons": (
        lambda s, d: reads(s, d).select("sequence").distinct().select("sequence", nt.translated(F.col("sequence")).alias("protein")),
        _WITH
        + f"""SELECT sequence, array_to_string(list_transform(range(1, length(sequence) - 1, 3), lambda i: substr('{nt.AMINO_ACIDS}',
          (instr('TCAG', substr(sequence, i, 1)) - 1) * 16 + (instr('TCAG', substr(sequence, i + 1, 1)) - 1) * 4 + instr('TCAG', substr(sequence, i + 2, 1)), 1)), '') AS protein
          FROM (SELECT DISTINCT sequence FROM r)""",
    ),
    "umi_edit1_neighbours": (
        lambda s, d: ops.substitution_neighbours(ops.umi_counts(reads(s, d))),
        _WITH
        + """SELECT a.sample_idx, a.umi, b.umi AS neighbour, a.family_size, b.family_size AS neighbour_size FROM u a JOIN u b ON a.sample_idx = b.sample_idx AND hamming(a.umi, b.umi) = 1""",
    ),
    "call_stats": (
        lambda s, d: ops.call_stats(ops.umi_counts(reads(s, d)), 3),
        _WITH
        + """, g AS (SELECT sample_idx, CASE WHEN family_size < 3 THEN 'family-size-reject' ELSE 'likely_real' END AS disposition, count(*) AS families, CAST(sum(family_size) AS BIGINT) AS reads FROM u GROUP BY ALL)
        SELECT *, round(100.0 * families / sum(families) OVER (PARTITION BY sample_idx), 6) AS families_percent, round(100.0 * reads / sum(reads) OVER (PARTITION BY sample_idx), 6) AS reads_percent FROM g""",
    ),
    "artefact_cutoffs": (
        lambda s, d: ops.artefact_cutoffs(ops.umi_counts(reads(s, d)), 0.99, 0.25),
        _WITH
        + """, c AS (SELECT sample_idx, CAST(ceil(quantile_cont(family_size, 0.99) * 0.25) AS BIGINT) AS cutoff FROM u GROUP BY sample_idx)
        SELECT sample_idx, cutoff, count(*) FILTER (WHERE family_size < cutoff) AS below FROM u JOIN c USING (sample_idx) GROUP BY ALL""",
    ),
    "collapse_haplotypes": (
        lambda s, d: ops.haplotypes(reads(s, d)),
        _WITH
        + """, h AS (SELECT sample_idx, sequence AS haplotype, count(DISTINCT fam) AS families FROM r GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY families DESC, haplotype) AS variant FROM h)
        SELECT *, concat('v', variant, '_', families) AS name FROM k""",
    ),
    "kmer6_counts": (
        lambda s, d: ops.kmer_counts(reads(s, d)),
        _WITH + f", k AS (SELECT {_KMERS.format(s='sequence', k=6)} AS kmer FROM r) SELECT kmer, count(*) AS n FROM k GROUP BY kmer",
    ),
    "family_size_freq": (
        lambda s, d: ops.umi_counts(reads(s, d)).groupBy("sample_idx", "family_size").agg(F.count("*").alias("families")),
        _WITH + "SELECT sample_idx, family_size, count(*) AS families FROM u GROUP BY ALL",
    ),
    "dinucleotide_freq": (
        lambda s, d: ops.dinucleotides(ops.umi_counts(reads(s, d))),
        _WITH
        + f""", p AS (SELECT family_size, {_KMERS.format(s="umi", k=2)} AS pair FROM u), g AS (SELECT pair, count(*) AS families, CAST(sum(family_size) AS BIGINT) AS reads FROM p GROUP BY pair)
        SELECT *, round(families / (SELECT sum(families) FROM g), 8) AS share FROM g""",
    ),
    "column_consensus": (
        lambda s, d: ops.consensus(reads(s, d)),
        _WITH
        + f""", b AS (SELECT fam, unnest(range(length(sequence))) AS spot, unnest(string_split(sequence, '')) AS base FROM r),
        v AS (SELECT fam, spot, base, count(*) AS n FROM b GROUP BY ALL),
        w AS (SELECT *, row_number() OVER (PARTITION BY fam, spot ORDER BY n DESC, base) AS k, n / sum(n) OVER (PARTITION BY fam, spot) AS share FROM v)
        SELECT fam, string_agg(base, '' ORDER BY spot) AS sequence, round(min(share), 6) AS agreement FROM w WHERE k = 1 GROUP BY fam""",
    ),
    "jc69_distance": (
        distances,
        _WITH
        + """, f AS (SELECT fam % 97 AS founder, max(substr(sequence, 1, 40)) AS sequence FROM r GROUP BY 1),
        p AS (SELECT a.founder, b.founder AS other, hamming(a.sequence, b.sequence) / 40.0 AS m FROM f a JOIN f b ON a.founder < b.founder)
        SELECT founder, other, round(m, 8) AS mismatch, round(CASE WHEN m < 0.75 THEN -0.75 * ln(1 - m * 4.0 / 3.0) END, 8) AS jc69 FROM p""",
    ),
}
