import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import statistics as st
from strandloom.operators import assignment, reports
from strandloom.plans.reports import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [k for k, v in QUERIES.items() if v[1]])
def test_query_equals_sql(spark, name):
    query, sql = QUERIES[name]
    con = duckdb.connect()
    for table in ("lineitem", "nation"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want, got = con.sql(sql).df(), query(spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got)
    want, got = (x[columns].sort_values(columns).reset_index(drop=True) for x in (want, got))
    pd.testing.assert_frame_equal(got, want, rtol=0, atol=1e-7, check_dtype=False)


def test_student_distribution_has_its_known_quantiles(spark):
    for df, t, p in ((1, 12.706204736, 0.05), (2, 4.302652730, 0.05), (10, 2.228138852, 0.05), (27, 2.770682957, 0.01), (60, 3.460200, 0.001)):
        assert abs(spark.range(1).select(st.student_p(F.lit(t), df)).first()[0] - p) < 1e-8
    assert spark.range(1).select(st.student_p(F.lit(0.0), 27)).first()[0] == 1


def test_families_without_enough_quality_are_no_heteroduplexes(spark):
    bad = "#" * 8 + "J" * 52
    rows = spark.createDataFrame([(1, bad), (1, bad), (2, bad[:49]), (2, bad), (3, "J" * 60), (4, None), (5, "")], "fam long, quality string")
    got = {r.fam: (r.heteroduplex, r.p) for r in assignment.heteroduplexes(rows, 0, 8).collect()}
    assert got[1] == (True, 0.0) and got[3] == (False, 1.0) and got[2] == got[4] == got[5] == (False, None)
    assert not assignment.heteroduplexes(rows, 20, 30).where("heteroduplex or p is not null").count()


def test_primers_that_are_parts_of_others_share_a_group(spark):
    rows = [("a", 0, "acgt"), ("b", 1, "TACGTTT"), ("c", 2, "GGACGT"), ("d", 3, "CCC"), ("e", 4, "CCC"), ("f", 5, ""), ("g", 6, None)]
    got = {r.sample: (r.primer_group, r.forward) for r in assignment.primer_groups(spark.createDataFrame(rows, "sample string, ordinal int, primer string")).collect()}
    assert got == {"a": ("GGACGT", "ACGT"), "b": ("TACGTTT", "TACGTTT"), "c": ("GGACGT", "ACGT"), "d": ("CCC", "CCC"), "e": ("CCC", "CCC")}


def test_reads_go_to_every_sample_whose_identifier_they_hold(spark):
    rows = spark.createDataFrame([(1, "AACGATTTT"), (2, "T" * 12), (3, ""), (4, None), (5, "A" * 9 + "CG")], "fam int, sequence string")
    got = sorted((r.fam, r.sample or "", r.rest) for r in assignment.assigned(rows, {"x": "ACGR", "y": "TTT", "z": "CG"}).collect())
    assert got == [(1, "x", "ACGATTTT"), (1, "y", "TTTT"), (1, "z", "CGATTTT"), (2, "y", "T" * 12), (3, "", None), (4, "", None), (5, "", None)]


def test_selected_columns_of_a_reference(spark):
    rows = spark.createDataFrame([("-AC-GT",), ("",), ("--",)], "a string")
    pick = lambda s: [r[0] for r in rows.select(reports.reference_columns(F.col("a"), s)).collect()]
    assert pick(" ") == [[0, 1, 2, 3, 4, 5], [], [0, 1]]
    assert pick("4-3;1,x;99") == [[1, 4, 5], [], []]


def test_thresholds_apply_without_a_new_fit(spark):
    rows = [(0, "A" * 8, 5, "likely_real", 0.9), (1, "A" * 8, 5, "likely_real", 0.9), (0, "A" * 7, 9, "likely_real", 1.0), (0, "C" * 8, 9, "BPB-rejects", 1.0), (0, "G" * 8, 9, "likely_real", 0.1)]
    families = spark.createDataFrame(rows, "sample_idx long, umi string, family_size long, disposition string, p double")
    own = spark.createDataFrame([(1, 6)], "sample_idx long, threshold int")
    got = {(r.sample_idx, r.umi): r.after for r in reports.redisposed(families, own, 5, 0.5).collect()}
    assert list(map(got.get, [(0, "A" * 8), (1, "A" * 8), (0, "A" * 7), (0, "C" * 8), (0, "G" * 8)])) == ["likely_real", "family-size-reject", "UMI_len != 8", "BPB-rejects", "LDA-rejects"]
