"""A corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontamination, jaccard_join, packing, quality_rules, secret_scan
from strandloom.llm.storage import small_side, written

#: Five-word shingles, linked at a Jaccard similarity of 0.8 or more.
NEAR = jaccard_join.Law(k=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component, once; documents without a doc_id or words stay."""
    found = written(jaccard_join.joined(docs, NEAR), "components")
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small_side(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    twice = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    twice = small_side(twice)
    first = kept.join(twice, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(first)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the test set."""
    return docs.where(~decontamination.is_leaked(F.col("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text."""
    out = docs.withColumn("text", secret_scan.redacted(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", sequences),
]

#: Learned rules and tokenization are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
