import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import nucleotides as nt
from strandloom.operators import reads as ops
from strandloom.plans import records, registry
from strandloom.plans.reads import reads
from strandloom.sources.sequences import read_fasta, read_fastq
from strandloom.streaming.admission import live_counters

DATA = "/root/testdata/sf0.001"


QUERIES = {k: v for k, v in (registry.QUERIES | records.QUERIES).items() if v[1]}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    query, sql = QUERIES[name]
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{DATA}/lineitem.parquet'")
    want, got = con.sql(sql).df(), query(spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    want, got = (x[columns].sort_values(columns).reset_index(drop=True) for x in (want, got))
    pd.testing.assert_frame_equal(got, want, rtol=0, atol=1e-9)


def test_nucleotide_functions(spark):
    row = spark.sql("select 'ACGTRYMK' a, 'ATG---' b, 'ATGGCCTAAGA' c, 'xxacgtNNNNNNNNGTCA' p, 'I' q, '' e, 'ATGNCC' x").select(
        nt.reverse_complement(F.col("a")), nt.degapped(F.col("b")), nt.translated(F.col("c")), nt.sample_id(F.col("p")), nt.umi_length(F.col("p")),
        nt.mean_error(F.col("q")), nt.mean_error(F.col("e")), nt.translated(F.col("e")), nt.translated(F.col("x")),
    ).first()
    assert list(row) == ["MKRYACGT", "ATG", "MA*", "XXACGT", 8, pytest.approx(1e-4), 1.0, "", "MX"]


def test_fastq_and_fasta(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nacgt\n+\nIIII\n@r2\nAC\r\n+r2\n@I\n")
    assert [tuple(r)[1:] for r in read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("ordinal").collect()] == [(1, "r1 x", "ACGT", "IIII"), (2, "r2", "AC", "@I")]
    (tmp_path / "b.fastq").write_text("@r1\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="malformed FASTQ record 1"):
        read_fastq(spark, str(tmp_path / "b.fastq")).collect()
    (tmp_path / "a.fasta").write_text("; note\n>one\nac\nGT\n>\nAA\n")
    assert [tuple(r)[1:] for r in read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("ordinal").collect()] == [(1, "one", "ACGT"), (2, "sequence_2", "AA")]


def test_consensus_of_a_split_family(spark):
    rows = [(1, "ACGTACGTACGTACGTACGT")] * 3 + [(1, "ACGTACGTATGTACGTACGT")] * 2
    assert tuple(ops.consensus(spark.createDataFrame(rows, "fam long, sequence string")).first()) == (1, "ACGTACGTACGTACGTACGT", 0.6)


def test_streamed_counters_equal_batch(spark, tmp_path):
    batch = reads(spark, DATA).select("sample_idx", "sequence", "error")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_counters(stream, 0.05, 42, 62).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("live").collect()}
    assert got == {tuple(r) for r in live_counters(batch, 0.05, 42, 62).collect()}
