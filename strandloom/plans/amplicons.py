"""Raw amplicon reads derived from the line items of the test tables, and what the stages make of them.

A molecule is a forward primer, one of its sample's three founders (in some families one of the next sample's) and, reversed and complemented, a sample's primer: adapter, identifier,
tag and tail. Reads have replaced, missing and added letters, half of them are turned round, some have lost an end, and in some
families the tag reads badly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, annotations, assignment, consensus, contamination, demultiplex, functional, msa, panel, phylogeny, posteriors, reads as ops, reports, umi_model
from ..operators.demultiplex import Gates, Sample
from ..sources import sequences
from ..sources.shared import shared_folder, written
from ..streaming import admission
from .reads import lines

ADAPTER, TAIL = "CCGCTCCGTCCGACG", "CAGTCATTGC"
IDENTIFIERS = ("acgtca", "ctgatg", "gatcct", "tgcaga", "aagctg", "ccttag", "ggatac", "ttcgac")
PRIMERS = ("TAGGATCATG", "GCTAGGATCATG", "TAGGATCATG", "GCTAGGATCATG", "ATTGACGATC", "CCATTGACGATC", "CCATTGACGATC", "CCATTGACGATC")
SAMPLES = [Sample(f"S{k}", f"{ADAPTER}{i}NNNNNNNN{TAIL}", p) for k, (i, p) in enumerate(zip(IDENTIFIERS, PRIMERS))]
ID_LENGTH, TAG_LENGTH = 6, 8
ERROR, SHORT, LONG, MOST, LDA, FAMILY = 0.05, 80, 400, 100_000, 0.995, 2

_HEX = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
AMPLICONS_SQL = f"""
SELECT fam, founder_no, sample_no, tag, ordinal, molecule, read, CASE WHEN l_linenumber % 2 = 0 THEN reverse(translate(read, 'ACGT', 'TGCA')) ELSE read END AS sequence,
  CASE WHEN l_linenumber % 2 = 0 THEN reverse(phred) ELSE phred END AS quality FROM (SELECT *, concat(repeat(chr(CAST(33 + q AS INT)), 30),
    repeat(chr(CAST(33 + (q + 9) % 41 AS INT)), 54), repeat(chr(CAST(CASE WHEN fam % 53 = 0 THEN 37 ELSE 33 + (q + 9) % 41 END AS INT)), 10),
    repeat(chr(CAST(33 + (q + 9) % 41 AS INT)), CAST(length(read) - 94 AS INT))) AS phred FROM (
  SELECT fam, founder_no, sample_no, tag, ordinal, l_linenumber, molecule, q, CASE
    WHEN edit % 29 = 0 THEN substr(molecule, 20, 1000)
    WHEN edit % 7 = 0 THEN concat(substr(molecule, 1, CAST(spot AS INT)), substr(molecule, CAST(spot + 2 AS INT), 1000))
    WHEN edit % 7 = 1 THEN concat(substr(molecule, 1, CAST(spot AS INT)), substr('ACGT', CAST(1 + edit % 4 AS INT), 1), substr(molecule, CAST(spot + 1 AS INT), 1000))
    WHEN edit % 7 < 4 THEN concat(substr(molecule, 1, CAST(spot AS INT)), substr('ACGT', CAST(1 + edit % 4 AS INT), 1), substr(molecule, CAST(spot + 2 AS INT), 1000))
    ELSE molecule END AS read FROM (
    SELECT fam, founder_no, sample_no, tag, ordinal, l_linenumber, q, edit, spot, concat(
      substr('{"".join(p.ljust(12) for p in PRIMERS)}', CAST(1 + 12 * sample_no AS INT), CAST(CASE WHEN sample_no IN ({", ".join(str(k) for k, p in enumerate(PRIMERS) if len(p) == 10)}) THEN 10 ELSE 12 END AS INT)),
      translate(md5(concat('a', founder)), {_HEX}), translate(md5(concat('b', founder)), {_HEX}),
      '{TAIL[::-1].translate(str.maketrans("ACGT", "TGCA"))}', reverse(translate(tag, 'ACGT', 'TGCA')),
      substr('{"".join(i.upper()[::-1].translate(str.maketrans("ACGT", "TGCA")) for i in IDENTIFIERS)}', CAST(1 + 6 * sample_no AS INT), 6),
      '{ADAPTER[::-1].translate(str.maketrans("ACGT", "TGCA"))}') AS molecule FROM (
      SELECT l_orderkey AS fam, founder_no, CAST(founder_no AS {{text}}) AS founder, sample_no,
        (l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 7919 + l_suppkey * 31 + CAST(l_quantity AS INT)) % 1000000 AS ordinal, l_linenumber, CAST(l_quantity AS INT) % 41 AS q, l_partkey % 1000 AS edit, (l_suppkey * 31 + l_linenumber) % 118 AS spot,
        substr(translate(md5(CAST(l_orderkey AS {{text}})), {_HEX}), 1, 8) AS tag
      FROM (SELECT *, l_orderkey % 8 AS sample_no, run % 3 + 3 * ((l_orderkey % 8 + CASE WHEN run % 41 = 0 THEN 1 ELSE 0 END) % 8) AS founder_no
        FROM (SELECT *, CAST(floor(l_orderkey / 8) AS BIGINT) AS run FROM {{lineitem}}) r) o) a) b) c) d
"""


def amplicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, sequence, quality, and what the reads were made of: fam, founder_no, sample_no, tag, molecule, read (not turned)."""
    return spark.sql(AMPLICONS_SQL.format(text="STRING", lineitem="{lines}"), lines=lines(spark, sf_dir))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read with its sample and tag, or why it has none."""
    return demultiplex.demultiplexed(amplicons(spark, sf_dir), SAMPLES, Gates(ERROR, SHORT, LONG))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned reads, down-sampled."""
    return demultiplex.downsampled(written(assigned(spark, sf_dir).where("sample_idx IS NOT NULL"), "demultiplexed"), MOST)  # read twice


def dispositions(reads: DataFrame) -> DataFrame:
    """The tags of assigned reads with their disposition, families of two molecules (heteroduplex) told by their qualities."""
    key = F.struct("sample_idx", "umi").alias("fam")
    both = assignment.heteroduplexes(reads.select(key, "quality"), ID_LENGTH, ID_LENGTH + TAG_LENGTH).where("heteroduplex")
    both = both.select(F.col("fam.sample_idx").cast("long").alias("sample_idx"), F.col("fam.umi").alias("umi"), "heteroduplex")
    tags = umi_model.families(ops.umi_counts(reads), LDA, FAMILY).withColumn("sample_idx", F.col("sample_idx").cast("long"))
    is_both = F.coalesce("heteroduplex", F.lit(False)) & (F.col("umi") != umi_model.REJECTS)
    joined = tags.join(both, ["sample_idx", "umi"], "left")
    return joined.withColumn("disposition", F.when(is_both, "heteroduplex").otherwise(F.col("disposition"))).drop("heteroduplex")


def judged_families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Families with their disposition, and the records of those that are likely real."""
    reads = written(kept(spark, sf_dir), "assigned")
    families = written(dispositions(reads), "families")
    real = families.where("disposition = 'likely_real'").select(F.col("sample_idx").cast("int").alias("sample_idx"), "umi")
    primers = {k: s.cdna_primer[len(ADAPTER) :].upper() for k, s in enumerate(SAMPLES)}
    return families, consensus.family_consensus(reads.join(real, ["sample_idx", "umi"], "left_semi"), ["sample_idx", "umi"], primers)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, umi, family_size, sequence, agreement, sites of the families that are likely real."""
    return judged_families(spark, sf_dir)[1]


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, umi, parent, family_size, probability, disposition, and the agreement of families that have a record."""
    tags, found = judged_families(spark, sf_dir)
    own = found.select(F.col("sample_idx").cast("long").alias("sample_idx"), "umi", "agreement")
    return tags.join(own, ["sample_idx", "umi"], "left").select("sample_idx", "umi", "parent", "family_size", "probability", "disposition", "agreement")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each sample: its families and reads by disposition, and its records and their mean agreement."""
    kinds = ("likely_real", "heteroduplex", "BPB-rejects", "LDA-rejects", "UMI_len != 8", "family-size-reject")
    name = lambda kind: kind.replace("-", "_").replace(" != 8", "").lower()
    is_kind = lambda kind: F.col("disposition") == kind
    counts = [F.count_if(is_kind(k)).alias(f"{name(k)}_families") for k in kinds] + [F.coalesce(F.sum(F.when(is_kind(k), F.col("family_size"))), F.lit(0)).alias(f"{name(k)}_reads") for k in kinds]
    found = families(spark, sf_dir).groupBy("sample_idx").agg(F.sum("family_size").alias("reads"), F.count("*").alias("families"), *counts, F.count("agreement").alias("records"), F.avg("agreement").alias("mean_agreement"))
    return found.withColumn("mean_agreement", F.round("mean_agreement", 6))


def identified(found: DataFrame) -> DataFrame:
    """Records with their id, sample and tag."""
    names = F.element_at(F.array(*[F.lit(s.name) for s in SAMPLES]), F.col("sample_idx") + 1)
    return found.withColumn("id", F.concat(names, F.lit("_"), "umi"))


def contaminants(found: DataFrame) -> DataFrame:
    return contamination.calls(found, {k: s.name for k, s in enumerate(SAMPLES)})


def founders(numbers: list[int]) -> list[str]:
    """The inserts of some founders, as the reads are made of them."""
    hexed = str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")
    return ["".join(hashlib.md5(f"{part}{k}".encode()).hexdigest() for part in "ab").translate(hexed) for k in numbers]


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the gates: artefact cutoff by sample, agreement, contamination calls and the panel."""
    found = written(identified(records(spark, sf_dir)), "records")
    gone = contaminants(found).where("discarded").select(F.col("id").alias("fam"))
    scored = panel.panel_scores(found.withColumnRenamed("id", "fam"), PANEL, PANEL_THRESHOLD).withColumn("panel_threshold", F.lit(PANEL_THRESHOLD))
    cutoffs = ops.artefact_cutoffs(found.withColumnRenamed("id", "fam"), QUANTILE, FRACTION)
    return annotations.with_passes(scored, gone, cutoffs, AGREEMENT)


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, variant, name, families, haplotype: different sequences of a sample's records that several families have."""
    found = identified(records(spark, sf_dir)).withColumnRenamed("id", "fam")
    return ops.haplotypes(found).where(F.col("families") >= HAPLOTYPE_FAMILIES).select("sample_idx", "variant", "name", "families", "haplotype")


def aligned_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.multiple_alignment(written(haplotypes(spark, sf_dir), "haplotypes"), "sample_idx", "haplotype")


def hypermutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned haplotypes with the posterior of their G-to-A changes against the sample's most frequent letters."""
    rows = written(aligned_haplotypes(spark, sf_dir), "aligned")
    modal = reports.column_modes(rows.select("sample_idx", F.col("variant").alias("row"), "aligned")).withColumnRenamed("sequence", "modal")
    return posteriors.hypermutation(rows.join(modal, "sample_idx"), "modal", "aligned").drop("modal")


def through_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, sequence, quality of all reads, written as FASTQ text and read again."""
    path = f"{shared_folder(spark)}/reads"
    sequences.write_fastq(amplicons(spark, sf_dir).withColumn("name", F.col("ordinal").cast("string")), path)
    return sequences.read_fastq(spark, path).select("name", "sequence", "quality")


def admitted_on_a_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, sample_idx of the reads that stay when assigned reads are admitted from a stream."""
    folder = shared_folder(spark)
    columns = ["ordinal", "sample_idx", "sampling_hash"]
    rows = written(assigned(spark, sf_dir).where("sample_idx IS NOT NULL").select(*columns), "assigned", folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", STREAM_FILES).parquet(f"{folder}/assigned")
    sink = admission.admitted(stream, STREAM_MOST).writeStream.format("parquet").option("path", f"{folder}/admitted").option("checkpointLocation", f"{folder}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/admitted")
    return admission.settled(found, rows.groupBy("sample_idx").agg(F.count("*").alias("n")), STREAM_MOST).select("ordinal", "sample_idx")


def functional_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes judged by their longest frames against that of a founder."""
    rows = written(haplotypes(spark, sf_dir), "haplotypes")
    return functional.functional_filter(rows, "sample_idx", REFERENCE, "haplotype")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = amplicons(spark, sf_dir).select("ordinal", F.col("molecule").alias("reference"), F.col("read").alias("query"))
    return alignment.global_alignments(pairs, "seeded").select("ordinal", "aligned_reference", "aligned_query")


QUANTILE, FRACTION, AGREEMENT, PANEL_THRESHOLD, HAPLOTYPE_FAMILIES = 0.99, 0.25, 0.6, 4.0, 2
#: Files of a micro-batch, and reads of a sample that stay.
STREAM_FILES, STREAM_MOST = 8, 2_000
#: The founders of the first sample.
PANEL = founders([0, 1, 2])

#: The longest frame that a founder has.
REFERENCE = max((annotations.longest_orf(x) or "" for x in founders(list(range(24)))), key=len)

#: Dynamic programs, EM and clustering are beyond SQL; tests compare them with plain versions on the test tables.
QUERIES = {
    "fastq_reads": (through_fastq, f"SELECT CAST(ordinal AS VARCHAR) AS name, sequence, quality FROM ({AMPLICONS_SQL.format(text='VARCHAR', lineitem='lineitem')})"),
    "stream_admission": (admitted_on_a_stream, None),
    "demultiplexed_reads": (lambda s, d: assigned(s, d).select("ordinal", "status", "sample_idx", "umi", "tag_errors"), None),
    "read_stages": (lambda s, d: demultiplex.stage_counts(amplicons(s, d), SAMPLES, Gates(ERROR, SHORT, LONG)), None),
    "seeded_alignments": (_aligned, None),
    "family_dispositions": (families, None),
    "stage_overview": (overview, None),
    "family_consensus": (records, None),
    "contamination_calls": (lambda s, d: contaminants(identified(records(s, d))), None),
    "panel_scores": (lambda s, d: panel.panel_scores(identified(records(s, d)).select("id", "sequence"), PANEL, PANEL_THRESHOLD), None),
    "sample_alignments": (aligned_haplotypes, None),
    "sample_trees": (lambda s, d: phylogeny.trees(aligned_haplotypes(s, d), "sample_idx"), None),
    "functional_filter": (functional_haplotypes, None),
    "functional_stats": (lambda s, d: reports.functional_stats(functional_haplotypes(s, d)), None),
    "posterior_bins": (lambda s, d: reports.probability_bins(families(s, d)), None),
    "plot_sites": (lambda s, d: reports.plot_sites(identified(records(s, d)).select("id", "sample_idx", "family_size", "sites")), None),
    "hypermutation": (hypermutated, None),
    "distance_map": (lambda s, d: posteriors.distance_map(aligned_haplotypes(s, d), "sample_idx"), None),
    "consensus_filters": (lambda s, d: judged(s, d).select("fam", "sample_idx", "family_size", "panel_score", *annotations.PASSES, "passed", "reasons"), None),
}
