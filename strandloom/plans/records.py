"""Registered queries on UMI models and consensus records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nucleotides as nt
from ..operators import annotations, reads as ops, trimming, umi_model
from .reads import DUCK_READS, reads

QUANTILE, FRACTION, AGREEMENT, THRESHOLD = 0.99, 0.5, 0.6, 0.15
FORWARD, ADAPTER = "ACGTNN", "TTGCA"

_WITH = f"WITH r AS ({DUCK_READS}), u AS (SELECT sample_idx, umi, count(*) AS family_size FROM r GROUP BY ALL) "
_RECORDS = (
    _WITH
    + f""", b AS (SELECT fam, unnest(range(length(sequence))) AS spot, unnest(string_split(sequence, '')) AS base FROM r),
    v AS (SELECT fam, spot, base, count(*) AS n FROM b GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY fam, spot ORDER BY n DESC, base) AS k, n / sum(n) OVER (PARTITION BY fam, spot) AS share FROM v),
    c AS (SELECT fam, string_agg(base, '' ORDER BY spot) AS sequence, round(min(share), 6) AS agreement FROM w WHERE k = 1 GROUP BY fam),
    s AS (SELECT fam, sample_idx, count(*) AS family_size FROM r GROUP BY ALL),
    cut AS (SELECT sample_idx, CAST(ceil(quantile_cont(family_size, {QUANTILE}) * {FRACTION}) AS BIGINT) AS cutoff FROM s GROUP BY sample_idx),
    rec AS (SELECT c.fam, sample_idx, family_size, sequence, agreement, cutoff, family_size >= cutoff AS artefact_pass, agreement >= {AGREEMENT} AS agreement_pass,
      c.fam % 13 <> 0 AS contamination_pass, true AS panel_pass FROM c JOIN s USING (fam) JOIN cut USING (sample_idx)) """
)
_CODON = f"substr('{nt.AMINO_ACIDS}', (instr('TCAG', substr(q, i, 1)) - 1) * 16 + (instr('TCAG', substr(q, i + 1, 1)) - 1) * 4 + instr('TCAG', substr(q, i + 2, 1)), 1)"
_GRAM = "SELECT {key}, unnest(list_transform(range(1, length(sequence) - 4), lambda i: substr(sequence, i, 6))) AS kmer FROM {rows}"
_PLACES = "(SELECT unnest(range(0, 9)) AS i) places"
_EDITS = f"""grown AS (SELECT sample_idx, umi, concat(substr(umi, 1, i), x, substr(umi, i + 1)) AS mid FROM u, bases, {_PLACES}),
 cut AS (SELECT sample_idx, umi, concat(substr(umi, 1, i), substr(umi, i + 2)) AS mid FROM u, {_PLACES} WHERE i < 8),
 changed AS (SELECT sample_idx, umi, concat(substr(umi, 1, i), x, substr(umi, i + 2)) AS mid FROM u, bases, {_PLACES} WHERE i < 8)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus records: fam, sample_idx, family_size, sequence, agreement."""
    rows = reads(spark, sf_dir)
    sizes = rows.groupBy("fam", "sample_idx").agg(F.count("*").alias("family_size"))
    return ops.consensus(rows).join(sizes, "fam")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    cutoffs = ops.artefact_cutoffs(rows.groupBy("fam", "sample_idx").agg(F.count("*").alias("family_size")), QUANTILE, FRACTION)
    discarded = rows.where("fam % 13 = 0").select("fam")
    return annotations.with_passes(_records(spark, sf_dir), discarded, cutoffs, AGREEMENT)


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).groupBy("fam").agg(F.max("sequence").alias("sequence")).withColumn("group", F.col("fam") % 97)
    # The first letters of a maximum are the maximum of the first letters, so references come from the reads; 97 at any scale.
    references = reads(spark, sf_dir).groupBy((F.col("fam") % 97).alias("group")).agg(F.max(F.substring("sequence", 1, 45)).alias("sequence"))
    return annotations.nearest_references(rows, references.withColumn("ref", F.col("group")), THRESHOLD, different=True)


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = annotations.display_name(F.col("fam"), F.col("family_size"), F.col("agreement"))
    rows = _judged(spark, sf_dir).where("passed").withColumn("name", name)
    return rows.select("fam", "name", annotations.fasta_record(F.col("name"), F.col("sequence"), 20).alias("record"))


def _likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = umi_model.likelihoods(ops.umi_counts(reads(spark, sf_dir)))
    return edges.select("sample_idx", "umi", "real", F.round("p", 12).alias("p"))


QUERIES = {
    "umi_two_edit_likelihood": (
        _likelihoods,
        _WITH
        + f""", bases AS (SELECT unnest(['A', 'C', 'T', 'G']) AS x), {_EDITS},
        one AS (SELECT sample_idx, umi, mid, sum(p) AS p FROM (SELECT *, {umi_model.INSERTION} AS p FROM grown UNION ALL SELECT *, {umi_model.DELETION} FROM cut UNION ALL SELECT *, {umi_model.SUBSTITUTION} FROM changed) GROUP BY ALL),
        two AS (SELECT sample_idx, umi AS real, mid, sum(p) AS p FROM (SELECT *, {umi_model.DELETION} AS p FROM grown UNION ALL SELECT *, {umi_model.INSERTION} FROM cut
          UNION ALL SELECT *, {umi_model.SUBSTITUTION} FROM changed WHERE mid <> umi UNION ALL SELECT sample_idx, umi, umi, power({1 - umi_model.ERROR}, 8) FROM u) GROUP BY ALL),
        e AS (SELECT sample_idx, umi, real, sum(one.p * two.p) AS p FROM one JOIN two USING (sample_idx, mid) GROUP BY ALL)
        SELECT sample_idx, umi, real, round(CASE WHEN umi = real THEN power({1 - umi_model.ERROR}, 8) ELSE p END, 12) AS p FROM e""",
    ),
    "umi_families": (lambda s, d: umi_model.families(ops.umi_counts(reads(s, d)), 0.995, 3), None),
    "primer_trim": (lambda s, d: trimming.primer_trimmed(reads(s, d).select("fam", "sequence"), FORWARD, ADAPTER, 1), None),
    "longest_orf": (
        lambda s, d: annotations.longest_orfs(reads(s, d)),
        _WITH
        + f""", f AS (SELECT sequence, frame, array_to_string(list_transform(range(1, length(q) - 1, 3), lambda i: {_CODON}), '') AS protein
          FROM (SELECT sequence, frame, substr(sequence, frame + 1) AS q FROM (SELECT DISTINCT sequence FROM r), (SELECT unnest([0, 1, 2]) AS frame) frames)),
        p AS (SELECT *, unnest(range(1, length(protein) + 1)) AS s FROM f),
        c AS (SELECT *, instr(substr(protein, s), '*') AS n FROM p WHERE substr(protein, s, 1) = 'M')
        SELECT sequence, substr(sequence, CAST(frame + (s - 1) * 3 + 1 AS BIGINT), n * 3) AS orf FROM c WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY n DESC, frame, s) = 1""",
    ),
    "record_filters": (
        lambda s, d: _judged(s, d).select("fam", "sample_idx", *annotations.PASSES, "passed", "reasons"),
        _RECORDS
        + f"""SELECT fam, sample_idx, artefact_pass, agreement_pass, contamination_pass, panel_pass, artefact_pass AND agreement_pass AND contamination_pass AND panel_pass AS passed,
        concat_ws('; ', CASE WHEN NOT artefact_pass THEN concat('ccs_count < artefact cutoff (', cutoff, ')') END, CASE WHEN NOT agreement_pass THEN 'minimum_agreement < {AGREEMENT}' END,
          CASE WHEN NOT contamination_pass THEN 'contamination filter' END) AS reasons FROM rec""",
    ),
    "filter_flow": (
        lambda s, d: annotations.filter_flow(_judged(s, d)),
        _RECORDS
        + """, g AS (SELECT sample_idx, count(*) AS consensus, count_if(artefact_pass) AS artefact, count_if(artefact_pass AND agreement_pass) AS agreement,
          count_if(artefact_pass AND agreement_pass AND contamination_pass) AS contamination FROM rec GROUP BY sample_idx)
        SELECT sample_idx, unnest(['consensus', 'artefact', 'agreement', 'contamination', 'panel']) AS step, CAST(unnest([consensus, artefact, agreement, contamination, contamination]) AS BIGINT) AS n FROM g""",
    ),
    "agreement_bins": (
        lambda s, d: annotations.agreement_bins(_records(s, d)),
        _RECORDS + "SELECT sample_idx, CAST(floor(agreement * 100 + 0.5) AS BIGINT) AS bin, count(*) AS n FROM rec GROUP BY ALL",
    ),
    "passed_fasta": (
        _export,
        _RECORDS
        + """, k AS (SELECT fam, sequence, concat(fam, ' fs=', family_size, ' minag=', printf('%.2f', agreement)) AS name FROM rec WHERE artefact_pass AND agreement_pass AND contamination_pass)
        SELECT fam, name, concat('>', name, chr(10), array_to_string(list_transform(range(1, length(sequence) + 1, 20), lambda i: substr(sequence, i, 20)), chr(10))) AS record FROM k""",
    ),
    "nearest_references": (
        _nearest,
        _WITH
        + f""", a AS (SELECT fam, max(sequence) AS sequence FROM r GROUP BY fam), f AS (SELECT fam % 97 AS ref, max(substr(sequence, 1, 45)) AS sequence FROM a GROUP BY 1),
        x AS (SELECT fam, kmer, count(*) AS n FROM ({_GRAM.format(key="fam", rows="a")}) GROUP BY ALL), y AS (SELECT ref, kmer, count(*) AS n FROM ({_GRAM.format(key="ref", rows="f")}) GROUP BY ALL),
        xs AS (SELECT fam, sum(n * n) AS sq, sum(n) AS t FROM x GROUP BY fam), ys AS (SELECT ref, sum(n * n) AS sq, sum(n) AS t FROM y GROUP BY ref),
        dots AS (SELECT fam, ref, sum(x.n * y.n) AS dot FROM x JOIN y USING (kmer) GROUP BY ALL),
        d AS (SELECT fam, ref, fam % 97 = ref AS own, CAST(greatest(xs.sq + ys.sq - 2 * dot, 0) AS DOUBLE) / CAST(6 * (xs.t + ys.t) AS DOUBLE) AS distance FROM dots JOIN xs USING (fam) JOIN ys USING (ref)),
        best AS (SELECT fam, min(distance) FILTER (WHERE own) AS own_distance, min(struct_pack(distance := distance, ref := ref)) FILTER (WHERE NOT own) AS best FROM d GROUP BY fam)
        SELECT fam, own_distance, best.ref AS nearest, best.distance AS distance, coalesce(best.distance < {THRESHOLD} AND NOT coalesce(own_distance <= {THRESHOLD}, false), false) AS called FROM best""",
    ),
    "modal_tips": (
        lambda s, d: annotations.modal_tips(reads(s, d)),
        _WITH
        + """, g AS (SELECT sample_idx, sequence, count(DISTINCT fam) AS weight, min(fam) AS first FROM r GROUP BY ALL)
        SELECT sample_idx, sequence, weight FROM g QUALIFY row_number() OVER (PARTITION BY sample_idx ORDER BY weight DESC, first, sequence) = 1""",
    ),
}
