"""Reports over families and consensus records, replay of thresholds, and comparison of alignments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nucleotides as nt
from .annotations import PASSES


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(100.0 * part, whole.cast("double")), F.lit(0.0)), 6)


def filter_stats(records: DataFrame) -> DataFrame:
    """sample_idx, filter, families, families_percent, reads, reads_percent: records that each gate rejects (they can
    overlap), all, and those that pass all gates. One aggregate."""
    kept = F.lit(True)
    for name in PASSES:
        kept = kept & F.col(name)
    groups = {"all": F.lit(True), **{p.removesuffix("_pass"): ~F.col(p) for p in PASSES}, "retained": kept}
    sums = [f(c, k) for k, c in groups.items() for f in (lambda c, k: F.count_if(c).alias(f"{k}_n"), lambda c, k: F.coalesce(F.sum(F.when(c, F.col("family_size"))), F.lit(0)).alias(f"{k}_r"))]
    wide = records.groupBy("sample_idx").agg(*sums)
    row = lambda k: F.struct(
        F.lit(k).alias("filter"), F.col(f"{k}_n").alias("families"), _percent(F.col(f"{k}_n"), F.col("all_n")).alias("families_percent"),
        F.col(f"{k}_r").alias("reads"), _percent(F.col(f"{k}_r"), F.col("all_r")).alias("reads_percent"),
    )
    return wide.select("sample_idx", F.inline(F.array(*map(row, groups))))


# How the reasons of the functional filter begin, by row of the report.
FUNCTIONAL_REASONS = {
    "ambiguous": "ambiguousSymbols-reject",
    "no-orf": "noORF-reject",
    "frameshift": "frameshift-reject",
    "late-start": "lateStart-reject",
    "early-stop": "earlyStop-reject",
    "bad-match": "badMatch-reject",
}


def functional_stats(rows: DataFrame, group: str = "sample_idx", weight: str = "families") -> DataFrame:
    """group, filter, variants, variants_percent, families, families_percent of haplotypes with functional_pass (null: not
    evaluated) and functional_reasons. Reasons can overlap; shares are of all variants of the group and of their families."""
    evaluated = F.col("functional_pass").isNotNull()
    reason = lambda start: evaluated & F.coalesce(F.exists("functional_reasons", lambda r: r.startswith(start)), F.lit(False))
    groups = {
        "all": F.lit(True), "not-evaluated": ~evaluated, "evaluated": evaluated, "passed": evaluated & F.col("functional_pass"),
        "rejected": evaluated & ~F.col("functional_pass"), **{k: reason(start) for k, start in FUNCTIONAL_REASONS.items()},
    }
    sums = []
    for k, c in groups.items():
        sums += [F.count_if(c).alias(f"{k}_n"), F.coalesce(F.sum(F.when(c, F.col(f"`{weight}`"))), F.lit(0)).cast("long").alias(f"{k}_w")]
    row = lambda k: F.struct(
        F.lit(k).alias("filter"), F.col(f"{k}_n").alias("variants"), _percent(F.col(f"{k}_n"), F.col("all_n")).alias("variants_percent"),
        F.col(f"{k}_w").alias("families"), _percent(F.col(f"{k}_w"), F.col("all_w")).alias("families_percent"),
    )
    return rows.groupBy(group).agg(*sums).select(group, F.inline(F.array(*map(row, groups))))


def probability_bins(families: DataFrame, divisions: int = 200, group: str = "sample_idx", value: str = "probability") -> DataFrame:
    """group, bin (0 to divisions), families: how the families' posterior probabilities lie; bins without any have no row.
    Halves go up, and values outside 0 to 1 to the end bins; null values are in no bin."""
    place = F.greatest(F.lit(0), F.least(F.lit(divisions), F.floor(F.col(value) * divisions + 0.5))).cast("int")
    return families.where(F.col(value).isNotNull()).groupBy(group, place.alias("bin")).agg(F.count("*").alias("families"))


def plot_sites(records: DataFrame, most: float = 0.9) -> DataFrame:
    """records with site_position, site_agreement, site_run: of the sites with no more agreement than `most` the first one
    in the longest run of equal letters; records without any have no row."""
    low = F.filter("sites", lambda s: s["agreement"] <= most)
    longest = F.array_max(F.transform(low, lambda s: s["run_length"]))
    site = F.element_at(F.filter(low, lambda s: s["run_length"] == longest), 1)
    rows = records.where(F.size(low) > 0).withColumn("__site", site)
    fields = {"site_position": "position", "site_agreement": "agreement", "site_run": "run_length"}
    return rows.select(*[F.col(f"`{c}`") for c in records.columns if c != "sites"], *[F.col("__site")[f].alias(k) for k, f in fields.items()])


def sample_overview(demultiplexed: DataFrame, families: DataFrame, records: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a sample: reads, families, and the share of reads that each reject takes.

    demultiplexed: sample_idx, reads; families: sample_idx, family_size, disposition; records: with PASSES; groups:
    sample_idx of each collapsed haplotype. Each is aggregated to one row a sample before the join.
    """
    names = {"BPB-rejects": "bpb", "UMI_len != 8": "umi_length", "family-size-reject": "family_size", "LDA-rejects": "lda", "heteroduplex": "heteroduplex"}
    size = F.col("family_size")
    family = families.groupBy("sample_idx").agg(
        F.sum(size).alias("selected_reads"),
        F.count_if(F.col("disposition") != "BPB-rejects").alias("observed_families"),
        *[_percent(F.sum(F.when(F.col("disposition") == d, size).otherwise(0)), F.sum(size)).alias(f"{n}_read_percent") for d, n in names.items()],
    )
    kept = F.col(PASSES[0]) & F.col(PASSES[1]) & F.col(PASSES[2]) & F.col(PASSES[3])
    record = records.groupBy("sample_idx").agg(
        F.count("*").alias("consensus_families"),
        F.count_if(kept).alias("retained_families"),
        *[_percent(F.sum(F.when(~F.col(p), size).otherwise(0)), F.sum(size)).alias(f"{p.removesuffix('_pass')}_read_percent") for p in PASSES],
    )
    haplotypes = groups.groupBy("sample_idx").agg(F.count("*").alias("collapsed_haplotypes"))
    rows = demultiplexed.select("sample_idx", F.col("reads").alias("demultiplexed_reads"))
    for part in (family, record, haplotypes):
        rows = rows.join(part, "sample_idx", "left")
    rows = rows.fillna(0)
    fewer = F.greatest(F.col("demultiplexed_reads") - F.col("selected_reads"), F.lit(0))
    return rows.withColumns({"downsampled_reads": fewer, "downsampled_percent": _percent(fewer, F.col("demultiplexed_reads"))})


def family_category(agreement: float) -> Column:
    """The disposition, or what a likely real family below its sample's cutoff or with little agreement is shown as."""
    real = F.col("disposition") == "likely_real"
    return (
        F.when(~real, F.col("disposition"))
        .when(F.col("family_size") < F.col("cutoff"), "maybe-artefact")
        .when(F.coalesce(F.col("agreement"), F.lit(1.0)) < agreement, "minag-reject")
        .otherwise("likely_real")
    )


def redisposed(families: DataFrame, overrides: DataFrame, threshold: int, lda: float | None = None) -> DataFrame:
    """families with `after`, the disposition under new thresholds, without fitting the model again.

    overrides: sample_idx, threshold of samples with one of their own (one row each); families with a rejected tag stay.
    """
    rows = families.join(F.broadcast(overrides.select("sample_idx", F.col("threshold").alias("own"))), "sample_idx", "left")  # one row a sample
    after = F.when(F.col("disposition") == "BPB-rejects", "BPB-rejects")
    if lda is not None:
        after = after.when(F.col("p") < lda, "LDA-rejects")
    after = after.when(F.length("umi") != 8, "UMI_len != 8").when(F.col("family_size") < F.coalesce("own", F.lit(threshold)), "family-size-reject")
    return rows.withColumn("after", after.otherwise("likely_real")).drop("own")


def alignment_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, change, gaps_only, edits of two alignments (name, aligned; names are unique in each): rows added, removed,
    changed or same; gaps_only where only gaps moved; edits between the ungapped texts of rows in both."""
    rows = before.select("name", F.col("aligned").alias("old")).join(after.select("name", F.col("aligned").alias("new")), "name", "full_outer")
    old, new = nt.degapped(F.col("old")), nt.degapped(F.col("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return rows.select("name", change.alias("change"), F.coalesce((F.col("old") != F.col("new")) & (old == new), F.lit(False)).alias("gaps_only"), F.levenshtein(old, new).cast("long").alias("edits"))


def column_modes(rows: DataFrame) -> DataFrame:
    """sample_idx, sequence: each sample's most frequent letter in every column, ties to the one seen first by row."""
    letters = rows.select("sample_idx", "row", F.posexplode(F.filter(F.split("aligned", ""), lambda c: c != "")).alias("at", "letter"))
    votes = letters.groupBy("sample_idx", "at", "letter").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    best = votes.groupBy("sample_idx", "at").agg(F.min_by("letter", F.struct(-F.col("n"), "first")).alias("letter"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "")
    return best.groupBy("sample_idx").agg(text.alias("sequence"))


def coordinates(selection: str) -> list[tuple[int, int]]:
    """Whole numbers and ranges in either order, as in "1;3;9-7", as pairs from the lower to the higher one; anything
    else is passed over."""
    parts = [re.fullmatch(r"(\d+)(?:-(\d+))?", part) for part in re.split(r"[\s,;]+", selection)]
    return [(min(a, b), max(a, b)) for a, b in ((int(m[1]), int(m[2] or m[1])) for m in parts if m)]


def reference_columns(aligned: Column, selection: str) -> Column:
    """Columns (from 0) of an aligned reference that hold the selected bases, numbered from 1; all without a selection."""
    columns = F.filter(F.sequence(F.lit(0), F.length(aligned) - 1), lambda i: F.length(aligned) > 0)
    if not selection.strip():
        return columns
    bases = F.filter(columns, lambda i: F.substring(aligned, i + 1, F.lit(1)) != "-")

    def chosen(_: Column, k: Column) -> Column:
        found = F.lit(False)
        for low, high in coordinates(selection):
            found = found | (k + 1).between(low, high)
        return found

    return F.filter(bases, chosen)


def uncollapsed_id(name: Column) -> Column:
    """The identifier in a display name."""
    return F.regexp_replace(name, r"\s+fs=\d+\s+minag=\S+$", "")
