"""FASTQ and FASTA text as DataFrames, and FASTQ text from them. Files are read by Spark's text reader, so any store and gzip will do.

FASTQ files are read split by split. A first pass counts the lines of each split and keeps its first and last three; from the
counts of the splits before it each split knows its first line's number in the file. A second pass then makes records of the
lines of a split, and those that lie across splits are put together from the lines that were kept.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import shared_folder, written

_RECORD = "file string, ordinal long, name string, sequence string, quality string"
_NAMES = ["file", "ordinal", "name", "sequence", "quality"]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
#: Splits up to which their numbers are broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 100_000


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file and number from 0; a whole file is split inside its row, so lines stay in order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("value", "\n+$", ""), "\n")).alias("line", "value"))
    return lines


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block: lines in order within each split of a file; block is where the split starts."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _summarized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, n, at, text): the lines of each split, the numbers of its first and last three, and these."""
    counts: Counter = Counter()
    first: dict[tuple[str, int], list[tuple[int, str]]] = defaultdict(list)
    last: dict[tuple[str, int], list[tuple[int, str]]] = defaultdict(list)
    for batch in batches:
        for key, text in zip(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()), batch.column("value").to_pylist()):
            k = counts[key]
            counts[key] = k + 1
            if k < 3:
                first[key].append((k, text))
            else:
                last[key].append((k, text))
                del last[key][:-3]
    rows = [(*key, n, [k for k, _ in first[key] + last[key]], [t for _, t in first[key] + last[key]]) for key, n in counts.items()]
    columns = list(zip(*rows)) or [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "block", "n", "at", "text"])


def _record(file: str, ordinal: int, lines: list[str]) -> tuple[str, int, str, str, str]:
    head, sequence, plus, quality = (x.rstrip("\r") for x in lines)
    if not head.startswith("@") or not plus.startswith("+") or len(sequence) != len(quality):
        raise ValueError(f"malformed FASTQ record {ordinal} of {file}")
    return file, ordinal, head[1:], sequence.upper(), quality


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, _TYPES)], _NAMES)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whose four lines lie in one split; before: lines of the file before the split."""
    now, at, lines = None, 0, []
    for batch in batches:
        rows = []
        for file, block, before, text in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "before", "value"))):
            if (file, block) != now:
                now, at, lines = (file, block), before, []
            if lines or at % 4 == 0:
                lines.append(text)
            at += 1
            if len(lines) == 4:
                rows.append(_record(file, at // 4, lines))
                lines = []
        yield _batch(rows)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from their lines, given as (file, record, lines); a record without all four raises an error."""
    for batch in batches:
        rows = []
        for file, record, lines in zip(*(batch.column(c).to_pylist() for c in ("file", "record", "lines"))):
            texts = [x["text"] for x in sorted(lines, key=lambda x: x["line"])]
            if len(texts) < 4:
                raise ValueError(f"malformed FASTQ record {record + 1} of {file}")
            rows.append(_record(file, record + 1, texts))
        yield _batch(rows)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal (from 1 in each file), name, sequence (upper case), quality; a malformed or truncated record raises an error.

    Files are read twice, by as many tasks as they have splits; only lines of records across splits are shuffled. A gzip file
    is one split. Empty lines at a file's end do not count.
    """
    folder = shared_folder(spark)
    lines = _split_lines(spark, path)
    summary = written(lines.mapInArrow(_summarized, "file string, block long, n long, at array<long>, text array<string>"), "splits", folder)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = written(summary.withColumn("before", earlier), "numbered", folder)  # a row for each split
    starts = numbered.select("file", "block", "before")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_SPLITS else starts
    whole = lines.join(starts, ["file", "block"]).select("file", "block", "before", "value").mapInArrow(_whole, _RECORD)
    kept = numbered.select("file", "before", "n", F.explode(F.arrays_zip("at", "text")).alias("x")).select("file", "before", "n", (F.col("before") + F.col("x.at")).alias("line"), F.col("x.text").alias("text"))
    kept = kept.withColumn("record", F.floor(F.col("line") / 4))
    # Lines of records that begin before their split or end behind it.
    crossing = kept.where((F.col("record") * 4 < F.col("before")) | (F.col("record") * 4 + 4 > F.col("before") + F.col("n")))
    parts = crossing.groupBy("file", "record").agg(F.collect_list(F.struct("line", "text")).alias("lines"))
    parts = parts.where(F.exists("lines", lambda x: F.trim(x["text"]) != ""))
    return whole.unionByName(parts.mapInArrow(_across, _RECORD))


def write_fastq(reads: DataFrame, path: str) -> None:
    """Records (name, sequence, quality) as FASTQ text files in a folder, one for each partition."""
    reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality").alias("value")).write.text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of whole files as they lie there, of up to 2 GB each."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, name, sequence (upper case) of FASTA records; lines that start with ; are comments."""
    lines = _numbered(spark, path).where(~F.col("value").startswith(";") & (F.trim("value") != ""))
    tagged = lines.withColumn("ordinal", F.sum(F.col("value").startswith(">").cast("int")).over(Window.partitionBy("file").orderBy("line")))
    parts = F.array_sort(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("line", F.trim("value").alias("value")))))
    name = F.max(F.when(F.col("value").startswith(">"), F.trim(F.substring("value", 2, 1 << 30))))
    rows = tagged.groupBy("file", "ordinal").agg(name.alias("name"), F.upper(F.array_join(F.transform(parts, lambda p: p["value"]), "")).alias("sequence"))
    return rows.select("file", "ordinal", F.when(F.col("name") == "", F.concat(F.lit("sequence_"), "ordinal")).otherwise(F.col("name")).alias("name"), "sequence")
