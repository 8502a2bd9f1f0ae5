"""FASTQ files cut into many splits, and admission on a stream against the batch form."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import demultiplex
from strandloom.plans import amplicons
from strandloom.sources import sequences
from strandloom.streaming import admission

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)


def plain(text):
    lines = text.rstrip("\n").split("\n")
    return [(k // 4 + 1, lines[k].rstrip("\r")[1:], lines[k + 1].rstrip("\r").upper(), lines[k + 3].rstrip("\r")) for k in range(0, len(lines), 4)]


def test_fastq_in_a_hundred_splits(spark, tmp_path, small_splits):
    rng = np.random.default_rng(1)
    made = {}
    for name, n, end in (("a.fastq", 300, "\n"), ("b.fastq", 40, ""), ("c.fastq", 3, "\n\n")):
        records = []
        for k in range(n):
            size = int(rng.integers(0, 3000 if k % 50 == 7 else 150))
            quality = "".join(rng.choice(list("@+I!~"), size))
            records.append(f"@r{k} x\r\n{''.join(rng.choice(list('acgtN'), size))}\r\n+\r\n{quality}\r\n" if k % 5 == 0 else f"@r{k}\n{''.join(rng.choice(list('ACGT'), size))}\n+r{k}\n{quality}\n")
        made[name] = "".join(records).rstrip("\n") + end
        (tmp_path / name).write_bytes(made[name].encode())
    with gzip.open(tmp_path / "d.fastq.gz", "wb") as f:
        f.write(made["b.fastq"].encode())
    made["d.fastq.gz"] = made["b.fastq"]
    rows = sequences.read_fastq(spark, str(tmp_path)).collect()
    assert sequences._split_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 50
    for name, text in made.items():
        got = sorted((r.ordinal, r["name"], r.sequence, r.quality) for r in rows if r.file.endswith("/" + name))
        assert got == plain(text), name
    digests = {r.file.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in sequences.file_digests(spark, str(tmp_path)).collect()}
    raw = made["a.fastq"].encode()
    assert digests["a.fastq"] == (len(raw), hashlib.sha256(raw).hexdigest())


@pytest.mark.parametrize("text, which", [("@a\nAC\n+\nI\n", 1), ("@a\nAC\n+\nII\n@b\nAC\n", 2), ("a\nAC\n+\nII\n", 1), ("@a\nAC\n-\nII\n", 1)])
def test_bad_fastq_raises(spark, tmp_path, text, which):
    (tmp_path / "x.fastq").write_text(text)
    with pytest.raises(Exception, match=f"malformed FASTQ record {which}"):
        sequences.read_fastq(spark, str(tmp_path)).collect()


def test_fastq_of_the_test_table_and_of_nothing(spark, tmp_path, small_splits):
    frame = amplicons.amplicons(spark, DATA).where("fam < 200").select(F.col("ordinal").cast("string").alias("name"), "sequence", "quality")
    sequences.write_fastq(frame, str(tmp_path / "out"))
    assert sorted(sequences.read_fastq(spark, str(tmp_path / "out")).select("name", "sequence", "quality").collect()) == sorted(frame.collect())
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.fastq").write_text("")
    assert not sequences.read_fastq(spark, str(tmp_path / "empty")).count()


def test_stream_ends_with_what_down_sampling_keeps(spark, monkeypatch):
    monkeypatch.setattr(amplicons, "STREAM_MOST", 60)
    monkeypatch.setattr(amplicons, "STREAM_FILES", 1)
    got = amplicons.QUERIES["stream_admission"][0](spark, DATA).collect()
    rows = amplicons.assigned(spark, DATA).where("sample_idx IS NOT NULL")
    want = demultiplex.downsampled(rows, 60).select("ordinal", "sample_idx").collect()
    assert sorted(got) == sorted(want) and 0 < len(got) < rows.count()


def test_cutoffs_only_fall():
    values = [admission.cutoff(k, 10) for k in range(1, 200)]
    assert values == sorted(values, reverse=True) and values[9] == (1 << 64) - 1 and values[19] == ((1 << 64) - 1) // 2
