"""Reads derived from the line items of the test tables, by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: sample, family and UMI follow the order; the sequence is one of 97 founders with a base replaced in some reads.
READS_SQL = """
SELECT fam, sample_idx, umi, substr(seq, 1, CAST(40 + l_partkey % 25 AS INT)) AS sequence, error FROM (
  SELECT fam, sample_idx, umi, l_partkey, error,
    CASE WHEN l_suppkey % 3 = 0 THEN concat(substr(founder, 1, CAST(spot AS INT)), substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1), substr(founder, CAST(spot + 2 AS INT), 64)) ELSE founder END AS seq
  FROM (
    SELECT l_orderkey AS fam, l_orderkey % 8 AS sample_idx, l_partkey, l_suppkey, (l_linenumber * 7 + l_suppkey) % 64 AS spot,
      substr(translate(md5(CAST(l_orderkey AS {text})), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 8) AS umi,
      concat(translate(md5(concat('f', CAST(l_orderkey % 97 AS {text}))), '0123456789abcdef', 'ACGTACGTACGTACGT'),
             translate(md5(concat('g', CAST(l_orderkey % 97 AS {text}))), '0123456789abcdef', 'ACGTACGTACGTACGT')) AS founder,
      power(10.0, -(CAST(l_quantity AS INT) % 41) / 10.0) AS error
    FROM {lineitem}) a) b
"""

DUCK_READS = READS_SQL.format(text="VARCHAR", lineitem="lineitem")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too few to be read by as many tasks; otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads are made of."""
    return spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fam, sample_idx, umi, sequence, error: one row per read."""
    return spark.sql(READS_SQL.format(text="STRING", lineitem="{lines}"), lines=lines(spark, sf_dir))
