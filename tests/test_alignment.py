import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import nucleotides as nt
from strandloom.operators import alignment


def _brute(a, b):
    """Global alignment by the recurrence, one cell after another."""
    score, step = {(0, 0): 0}, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                score[i, j], step[i, j] = -99 * (i + j), 2 if i == 0 else 3
                continue
            diagonal = score[i - 1, j - 1] + (100 if a[i - 1] == b[j - 1] else -100)
            left = score[i, j - 1] - (99 if i == len(a) else 100)
            up = score[i - 1, j] - (99 if j == len(b) else 100)
            score[i, j], step[i, j] = (diagonal, 1) if diagonal >= max(left, up) else (left, 2) if left >= up else (up, 3)
    i, j, x, y = len(a), len(b), "", ""
    while i or j:
        s = step[i, j]
        x, y = (a[i - 1] if s != 2 else "-") + x, (b[j - 1] if s != 3 else "-") + y
        i, j = i - (s != 2), j - (s != 3)
    return x, y


def test_alignment_equals_recurrence(spark):
    rng = np.random.default_rng(1)
    some = lambda: "".join(rng.choice(list("ACGT"), int(rng.integers(0, 14))))
    pairs = [(some(), some()) for _ in range(120)] + [("", ""), ("ACGT", ""), ("ACGTACGT", "ACGACGT")]
    assert alignment.aligned(*map(list, zip(*pairs))) == [_brute(a, b) for a, b in pairs]
    rows = [(k, a, b) for k, (a, b) in enumerate(pairs)] + [(999, None, "A")]
    got = {r.id: (r.aligned_reference, r.aligned_query) for r in alignment.global_alignments(spark.createDataFrame(rows, "id long, reference string, query string")).collect()}
    assert got == {k: _brute(a, b) for k, (a, b) in enumerate(pairs)} | {999: (None, None)}


def test_stable_hash_and_downsampling(spark):
    def brute(seed, a, b):
        value, mask = 1469598103934665603 ^ seed, (1 << 64) - 1
        for byte in (*a.encode(), 255, *b.encode(), 255):
            value = ((value ^ byte) * 1099511628211) & mask
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            value = ((value ^ (value >> 33)) * factor) & mask
        return value ^ (value >> 33)

    a, b = ["", "s1", "é", "abc"], ["x", "", "read 7", "y" * 40]
    assert alignment.stable_hashes(a, b, 5).tolist() == [brute(5, x, y) for x, y in zip(a, b)]
    rows = spark.createDataFrame([("big", f"r{i}") for i in range(4000)] + [("small", f"r{i}") for i in range(50)], "sample string, name string")
    counts = dict(map(tuple, alignment.downsampled(rows, 400).groupBy("sample").count().collect()))
    want = sum(brute(0, "big", f"r{i}") / 2**64 * 4000 <= 400 for i in range(4000))
    assert counts == {"small": 50, "big": want} and 300 < want < 500


def test_aligned_translation_and_codons(spark):
    row = spark.sql("select 'ATG---GC-TAAG' a, 'ACGTXJ' b, 'aU-g' c, 'M-A*' p, 'ATGGCCTAA' n").select(
        nt.translated_alignment(F.col("a")), nt.translated_alignment(F.col("a"), 1), nt.reverse_complement(F.col("b")), nt.degapped(F.col("c")),
        nt.backtranslated(F.col("p"), F.col("n")), nt.backtranslated(F.col("p"), F.lit("ATG")), nt.translated_alignment(F.lit("")),
    ).first()
    assert list(row) == ["M-X*X", "XXXK", "NNACGT", "ATG", "ATG---GCCTAA", None, ""]
