"""Registered queries on sample assignment, reports, replay of thresholds and comparison of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nucleotides as nt
from ..functions import statistics as st
from ..operators import annotations, assignment, corrections, reports
from ..operators import reads as ops
from . import records
from .reads import reads
from .records import _RECORDS, _WITH

THRESHOLD, REPLAYED, OWN = 3, 4, 6
IDENTIFIERS = {"s1": "ACGR", "s2": "TTNC", "s3": "GGA", "s4": "CAYT"}
TAG = (5, 13)
SELECTION = "1;3;9-7 , 12"
PRIMERS_SQL = """SELECT n_name AS sample, n_nationkey AS ordinal, substr(translate(md5(CAST(n_regionkey AS {text})), '0123456789abcdef', 'ACGTACGTACGTacgt'), CAST(1 + n_nationkey % 3 AS INT), CAST(8 + n_nationkey % 6 AS INT)) AS primer FROM {nation}"""
QUALITY_SQL = """SELECT fam, concat(CASE WHEN fam % 7 = 0 THEN substr('################', 1, CAST(13 - fam % 2 AS INT)) ELSE '' END, translate(concat(a, b), '0123456789abcdef', '$+4=AFHIJJJJJKKK')) AS quality FROM (
  SELECT l_orderkey AS fam, md5(concat('q', CAST(l_orderkey AS {text}), '-', CAST(l_linenumber AS {text}))) AS a, md5(concat('r', CAST(l_orderkey AS {text}), '-', CAST(l_partkey AS {text}))) AS b FROM {lineitem}) x"""
_PASSED = "artefact_pass AND agreement_pass AND contamination_pass AND panel_pass"
_CALLED = "f AS (SELECT *, CASE WHEN length(umi) <> 8 THEN 'UMI_len != 8' WHEN family_size < {n} THEN 'family-size-reject' ELSE 'likely_real' END AS disposition FROM {rows})"


def _table(spark: SparkSession, sf_dir: str, sql: str, **names: str) -> DataFrame:
    (key, name), = names.items()
    return spark.sql(sql.format(text="STRING", **{key: "{rows}"}), rows=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.umi_counts(reads(spark, sf_dir))
    return counts.withColumn("disposition", ops.disposition(F.col("family_size"), F.col("umi"), THRESHOLD))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and bases by assigned sample; reads without one under id-reject."""
    rows = assignment.assigned(reads(spark, sf_dir), IDENTIFIERS).groupBy(F.coalesce("sample", F.lit("id-reject")).alias("sample"))
    return rows.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.length("rest")), F.lit(0)).alias("bases"), F.min("rest").alias("first_rest"), F.max("rest").alias("last_rest"))


def _heteroduplexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assignment.heteroduplexes(_table(spark, sf_dir, QUALITY_SQL, lineitem="lineitem"), *TAG)
    return rows.withColumn("p", F.round("p", 8))


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected reads are those with a mean error below 0.05; there is no tag model and no functional filter."""
    rows = reads(spark, sf_dir)
    counts = ops.umi_counts(rows.where("error < 0.05")).withColumn("disposition", ops.disposition(F.col("family_size"), F.col("umi"), THRESHOLD))
    demultiplexed = rows.groupBy("sample_idx").agg(F.count("*").alias("reads"))
    return reports.sample_overview(demultiplexed, counts, records._judged(spark, sf_dir), rows.select("sample_idx", "sequence").distinct())


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records._judged(spark, sf_dir).withColumn("disposition", F.when(F.col("family_size") < THRESHOLD, "family-size-reject").otherwise("likely_real"))
    return rows.groupBy("sample_idx", reports.family_category(0.8).alias("category")).agg(F.count("*").alias("families"), F.sum("family_size").alias("reads"))


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes when the threshold becomes 4, and 6 in samples 1 and 5."""
    own = spark.range(8).where("id % 4 = 1").select(F.col("id").alias("sample_idx"), F.lit(OWN).alias("threshold"))
    rows = reports.redisposed(_families(spark, sf_dir), own, REPLAYED).where("disposition <> after")
    return rows.groupBy("sample_idx", "disposition", "after").agg(F.count("*").alias("families"), F.sum("family_size").alias("reads"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = reads(spark, sf_dir).groupBy(F.col("fam").alias("name")).agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"))
    moved = F.when(F.col("name") % 3 == 0, F.concat(F.substring("b", 1, 9), F.lit("--"), F.substring("b", 10, 64))).otherwise(F.col("b"))
    return rows.where("name % 5 <> 0").select("name", F.col("a").alias("aligned")), rows.where("name % 7 <> 0").select("name", moved.alias("aligned"))


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).groupBy("sample_idx", F.col("fam").alias("row")).agg(F.min("sequence").alias("aligned"))
    return reports.column_modes(rows)


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    gapped = F.concat(F.substring("sequence", 1, 2), F.lit("--"), F.substring("sequence", 3, 64))
    rows = reads(spark, sf_dir).select(gapped.alias("aligned")).distinct()
    return rows.select("aligned", F.array_join(reports.reference_columns(F.col("aligned"), SELECTION).cast("array<string>"), ",").alias("columns"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform(F.filter(F.split("sequence", ""), lambda c: c != ""), lambda c: F.when(c.isin("G", "C"), 1).otherwise(-1).cast("long"))
    return reads(spark, sf_dir).select("sequence").distinct().select("sequence", st.best_segment(scores).alias("score"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).groupBy("fam").agg(F.count("*").alias("n"))
    named = rows.select("fam", annotations.display_name(F.col("fam"), F.col("n"), F.lit(0.5)).alias("name"))
    return named.select("fam", "name", reports.uncollapsed_id(F.col("name")).alias("id"))


def _student_sql(t: str, df: int) -> str:
    cos2, total = f"({df} / ({df} + {t} * {t}))", "0.0"
    for c in reversed(st.series(df)):
        total = f"({total} * {cos2} + {c!r})"
    return f"greatest(1 - (atan(abs({t}) / sqrt({df})) + abs({t}) / sqrt({df} + {t} * {t}) * sqrt({cos2}) * {total}) * 2 / pi(), 0)"


def _find_sql(pattern: str) -> str:
    return f"instr(substr(sequence, 1, 10), regexp_extract(substr(sequence, 1, 10), '{assignment.exact_pattern(pattern)}'))"


_HITS = " UNION ALL ".join(
    f"SELECT fam, sequence, '{s}' AS sample, {_find_sql(i)} AS spot FROM r WHERE regexp_matches(substr(sequence, 1, 10), '{assignment.exact_pattern(i)}')" for s, i in IDENTIFIERS.items()
)
_NONE = " AND ".join(f"NOT regexp_matches(substr(sequence, 1, 10), '{assignment.exact_pattern(i)}')" for i in IDENTIFIERS.values())
_SPOTS = (*range(*TAG), *range(TAG[1] + 4, TAG[1] + 25))
_TAG_LIST, _AFTER_LIST = ("[" + ", ".join(f"q{i} / n" for i in spots) + "]" for spots in (_SPOTS[: TAG[1] - TAG[0]], _SPOTS[TAG[1] - TAG[0] :]))
_SHARE = "round(100.0 * sum(CASE WHEN {c} THEN family_size ELSE 0 END) / sum(family_size), 6) AS {n}_read_percent"

QUERIES = {
    "primer_groups": (
        lambda s, d: assignment.primer_groups(_table(s, d, PRIMERS_SQL, nation="nation")),
        f"""WITH o AS (SELECT sample, ordinal, upper(primer) AS primer FROM ({PRIMERS_SQL.format(text="VARCHAR", nation="nation")})), u AS (SELECT primer, min(ordinal) AS first FROM o GROUP BY primer),
        m AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE a.primer <> b.primer AND contains(b.primer, a.primer))),
        p AS (SELECT o.*, m.primer AS primer_group FROM o JOIN m ON contains(m.primer, o.primer) QUALIFY row_number() OVER (PARTITION BY sample ORDER BY length(m.primer), m.first) = 1)
        SELECT sample, primer_group, first_value(primer) OVER (PARTITION BY primer_group ORDER BY ordinal) AS forward FROM p""",
    ),
    "sample_assignment": (
        _assigned,
        _WITH
        + f""", h AS ({_HITS} UNION ALL SELECT fam, sequence, 'id-reject', NULL FROM r WHERE {_NONE}), t AS (SELECT sample, substr(sequence, spot) AS rest FROM h)
        SELECT sample, count(*) AS reads, CAST(coalesce(sum(length(rest)), 0) AS BIGINT) AS bases, min(rest) AS first_rest, max(rest) AS last_rest FROM t GROUP BY sample""",
    ),
    "heteroduplex": (
        _heteroduplexes,
        f"""WITH q AS ({QUALITY_SQL.format(text="VARCHAR", lineitem="lineitem")}),
        s AS (SELECT fam, count(*) AS n, {", ".join(f"sum(greatest(ascii(substr(quality, {i + 1}, 1)) - 33, 0)) AS q{i}" for i in _SPOTS)} FROM q GROUP BY fam),
        m AS (SELECT fam, n, {_TAG_LIST} AS tag, {_AFTER_LIST} AS after FROM s),
        d AS (SELECT *, list_avg(tag) AS tm, list_avg(after) AS am, list_var_samp(tag) * {len(range(*TAG)) - 1} + list_var_samp(after) * 20 AS ss FROM m),
        t AS (SELECT *, abs(tm - am) / (sqrt(ss / {len(_SPOTS) - 2}) * sqrt(1.0 / {len(range(*TAG))} + 1.0 / 21)) AS t FROM d), p AS (SELECT *, {_student_sql("t", len(_SPOTS) - 2)} AS p FROM t)
        SELECT fam, n, round(p, 8) AS p, tm < am AND p < 1 / (5.0 * n * n) AND list_min(tag) < am / 2 AS heteroduplex FROM p""",
    ),
    "filter_stats": (
        lambda s, d: reports.filter_stats(records._judged(s, d)),
        _RECORDS
        + f""", k AS (SELECT sample_idx, family_size, unnest(['all', 'artefact', 'agreement', 'contamination', 'panel', 'retained']) AS filter,
          unnest([true, NOT artefact_pass, NOT agreement_pass, NOT contamination_pass, NOT panel_pass, {_PASSED}]) AS hit FROM rec),
        g AS (SELECT sample_idx, filter, count_if(hit) AS families, CAST(coalesce(sum(family_size) FILTER (WHERE hit), 0) AS BIGINT) AS reads FROM k GROUP BY ALL)
        SELECT sample_idx, filter, CAST(families AS BIGINT) AS families, reads, round(100.0 * families / max(families) OVER w, 6) AS families_percent, round(100.0 * reads / max(reads) OVER w, 6) AS reads_percent FROM g WINDOW w AS (PARTITION BY sample_idx)""",
    ),
    "sample_overview": (
        _overview,
        _RECORDS
        + ", su AS (SELECT sample_idx, umi, count(*) AS family_size FROM r WHERE error < 0.05 GROUP BY ALL), "
        + _CALLED.format(n=THRESHOLD, rows="su")
        + f""", oa AS (SELECT sample_idx, count(*) AS demultiplexed_reads, count(DISTINCT sequence) AS collapsed_haplotypes FROM r GROUP BY sample_idx),
        ob AS (SELECT sample_idx, CAST(sum(family_size) AS BIGINT) AS selected_reads, count(*) AS observed_families, 0.0::DOUBLE AS bpb_read_percent, 0.0::DOUBLE AS lda_read_percent, 0.0::DOUBLE AS heteroduplex_read_percent,
          {_SHARE.format(c="disposition = 'UMI_len != 8'", n="umi_length")}, {_SHARE.format(c="disposition = 'family-size-reject'", n="family_size")} FROM f GROUP BY sample_idx),
        oc AS (SELECT sample_idx, count(*) AS consensus_families, CAST(count_if({_PASSED}) AS BIGINT) AS retained_families, {", ".join(_SHARE.format(c=f"NOT {g}_pass", n=g) for g in ("artefact", "agreement", "contamination", "panel"))} FROM rec GROUP BY sample_idx)
        SELECT *, demultiplexed_reads - selected_reads AS downsampled_reads, round(100.0 * (demultiplexed_reads - selected_reads) / demultiplexed_reads, 6) AS downsampled_percent FROM oa JOIN ob USING (sample_idx) JOIN oc USING (sample_idx)""",
    ),
    "family_categories": (
        _categories,
        _RECORDS
        + f"""SELECT sample_idx, CASE WHEN family_size < {THRESHOLD} THEN 'family-size-reject' WHEN family_size < cutoff THEN 'maybe-artefact' WHEN agreement < 0.8 THEN 'minag-reject' ELSE 'likely_real' END AS category,
        count(*) AS families, CAST(sum(family_size) AS BIGINT) AS reads FROM rec GROUP BY ALL""",
    ),
    "threshold_replay": (
        _replay,
        _WITH
        + ", "
        + _CALLED.format(n=THRESHOLD, rows="u")
        + f""", n AS (SELECT *, CASE WHEN length(umi) <> 8 THEN 'UMI_len != 8' WHEN family_size < CASE WHEN sample_idx % 4 = 1 THEN {OWN} ELSE {REPLAYED} END THEN 'family-size-reject' ELSE 'likely_real' END AS after FROM f)
        SELECT sample_idx, disposition, after, count(*) AS families, CAST(sum(family_size) AS BIGINT) AS reads FROM n WHERE disposition <> after GROUP BY ALL""",
    ),
    "alignment_edits": (
        lambda s, d: reports.alignment_edits(*_versions(s, d)).fillna(0, ["edits"]),
        _WITH
        + """, v AS (SELECT fam AS name, min(sequence) AS a, max(sequence) AS b FROM r GROUP BY fam),
        x AS (SELECT name, a AS old FROM v WHERE name % 5 <> 0), y AS (SELECT name, CASE WHEN name % 3 = 0 THEN concat(substr(b, 1, 9), '--', substr(b, 10)) ELSE b END AS new FROM v WHERE name % 7 <> 0)
        SELECT name, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'changed' ELSE 'same' END AS change, coalesce(old <> new AND replace(old, '-', '') = replace(new, '-', ''), false) AS gaps_only,
        CAST(coalesce(levenshtein(replace(old, '-', ''), replace(new, '-', '')), 0) AS BIGINT) AS edits FROM x FULL JOIN y USING (name)""",
    ),
    "corrected_rows": (lambda s, d: corrections.corrected_rows(*_versions(s, d)), None),
    "correction_totals": (lambda s, d: corrections.correction_totals(*_versions(s, d)), None),
    "column_modes": (
        _modes,
        _WITH
        + """, v AS (SELECT sample_idx, fam, min(sequence) AS aligned FROM r GROUP BY ALL), b AS (SELECT sample_idx, fam, unnest(range(length(aligned))) AS spot, unnest(string_split(aligned, '')) AS letter FROM v),
        g AS (SELECT sample_idx, spot, letter, count(*) AS n, min(fam) AS first FROM b GROUP BY ALL), k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY sample_idx, spot ORDER BY n DESC, first) = 1)
        SELECT sample_idx, string_agg(letter, '' ORDER BY spot) AS sequence FROM k GROUP BY sample_idx""",
    ),
    "reference_columns": (
        _columns,
        _WITH
        + """, g AS (SELECT DISTINCT concat(substr(sequence, 1, 2), '--', substr(sequence, 3)) AS aligned FROM r), b AS (SELECT aligned, list_filter(range(length(aligned)), lambda i: substr(aligned, i + 1, 1) <> '-') AS bases FROM g)
        SELECT aligned, array_to_string(list_filter(list_transform([1, 3, 7, 8, 9, 12], lambda k: bases[k]), lambda c: c IS NOT NULL), ',') AS columns FROM b""",
    ),
    "best_segments": (
        _segments,
        _WITH
        + """, d AS (SELECT DISTINCT sequence FROM r), b AS (SELECT sequence, unnest(range(length(sequence))) AS spot, unnest(string_split(sequence, '')) AS letter FROM d),
        s AS (SELECT sequence, spot, sum(CASE WHEN letter IN ('G', 'C') THEN 1 ELSE -1 END) OVER (PARTITION BY sequence ORDER BY spot) AS upto FROM b),
        m AS (SELECT sequence, upto - least(0, coalesce(min(upto) OVER (PARTITION BY sequence ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS segment FROM s)
        SELECT sequence, CAST(greatest(1, max(segment)) AS BIGINT) AS score FROM m GROUP BY sequence""",
    ),
    "fnv32_hash": (
        lambda s, d: reads(s, d).select("sample_idx", "umi").distinct().select("sample_idx", "umi", st.fnv32(F.col("umi"), F.col("sample_idx")).alias("hash")),
        _WITH
        + f"""SELECT sample_idx, umi, greatest(1, list_reduce(list_prepend(xor({st.FNV_START}::BIGINT, sample_idx::BIGINT), list_transform(string_split(umi, ''), lambda c: ascii(c)::BIGINT)),
        lambda h, c: (xor(h, c) * {st.FNV_FACTOR}) & 4294967295)) AS hash FROM u""",
    ),
    "display_names": (_names, _WITH + "SELECT fam, concat(fam, ' fs=', count(*), ' minag=0.50') AS name, CAST(fam AS VARCHAR) AS id FROM r GROUP BY fam"),
}
