import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.operators import annotations, trimming, umi_model
from strandloom.plans import records

DATA = "/root/testdata/sf0.001"
PLAIN = {c: set(b) for c, b in trimming.CODES.items()}


def brute_find(text, pattern, tolerance):
    """(start, end, errors) by a table of all prefixes: fewest edits, then the latest start."""
    cost = [(r, 0) for r in range(len(pattern) + 1)]
    for at, letter in enumerate(text):
        new = [(0, -(at + 1))]
        for r, wanted in enumerate(pattern, 1):
            step = 0 if PLAIN.get(letter, set()) & PLAIN[wanted] else 1
            (a, s), (b, t), (c, u) = cost[r - 1], cost[r], new[r - 1]
            new.append(min((a + step, s), (b + 1, t), (c + 1, u)))
        cost = new
        if cost[-1][0] <= tolerance:
            return -cost[-1][1], at + 1, cost[-1][0]


def brute_last(text, pattern, tolerance):
    found, at = None, 0
    while hit := brute_find(text[at:], pattern, tolerance):
        found, at = (hit[0] + at, hit[1] + at, hit[2]), at + hit[1]
    return found


@pytest.mark.parametrize("tolerance", [0, 1, 2])
def test_search_equals_brute_force(tolerance):
    texts = ["".join(t) for t in itertools.islice(itertools.product("ACGT", repeat=6), 0, 4096, 7)] + ["", "A", "ACGTNACGTTACGA", "ACG" * 12]
    for last, brute in ((False, brute_find), (True, brute_last)):
        hits = trimming.find(texts, "ACNGT", tolerance, last)
        for i, text in enumerate(texts):
            want = brute(text, "ACNGT", tolerance)
            assert (want is not None) == bool(hits.found[i])
            if want:
                assert want == (hits.start[i], hits.end[i], hits.errors[i]), (text, last)


@pytest.mark.parametrize("m", [15, 16, 17, 32, 33, 64, 65])
def test_search_of_patterns_around_the_size_of_a_word(m):
    rng = np.random.default_rng(m)
    some = lambda n: "".join(rng.choice(list("ACGT"), n))
    pattern = some(m)
    texts = [some(5) + pattern[:7] + pattern[8:] + some(3) + pattern + some(9), some(3) + pattern[: m - 4] + some(6), pattern, pattern + pattern[:5] + "A" + pattern[5:], some(m), "", some(20) + pattern[2:]]
    for tolerance, last in itertools.product((0, 1, 2), (False, True)):
        hits, plain = trimming.find(texts, pattern, tolerance, last), brute_last if last else brute_find
        got = [(int(s), int(e), int(x)) if f else None for f, s, e, x in zip(*hits)]
        assert got == [plain(t, pattern, tolerance) for t in texts]
        assert trimming.find(texts, pattern, tolerance, last, starts=False).end.tolist() == hits.end.tolist()


def test_an_empty_pattern_is_found_at_once():
    assert trimming.find(["ACGT"], "", 0).found.tolist() == [True]


def test_reads_are_trimmed_in_both_orientations(spark):
    insert = "GATTACAGATTACA"
    read = "TTCCGCT" + insert + trimming.reverse_complements(["CACTAGG"])[0] + "A"
    rows = [(1, read), (2, trimming.reverse_complements([read])[0]), (3, "ACGT"), (4, None), (5, "")]
    out = trimming.primer_trimmed(spark.createDataFrame(rows, "id long, sequence string"), "CCGCT", "CACTAGG", 0)
    got = {r.id: (r.insert, r.orientation) for r in out.collect()}
    assert got == {1: (insert, "forward"), 2: (insert, "reverse"), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_umi_rounds_over_tables_equal_one_task(spark):
    tags = [("AACCGGT", 3), ("AACCGGTA", 4), ("AACCGGTT", 100), ("AACCGTT", 2), ("AAACCGGTT", 2), ("TTGGCCAA", 20), ("TTGGCCAT", 1)]
    counts = spark.createDataFrame([(s, u, n + s) for s in (0, 1) for u, n in tags], "sample_idx long, umi string, family_size long")
    one, rounds = ({(r.sample_idx, r.umi): r for r in umi_model.families(counts, 0.995, 1, sample_tags=k).collect()} for k in (1000, 0))
    assert len(one) == 14 and one.keys() == rounds.keys()
    assert all(r.parent == rounds[k].parent and abs(r.probability - rounds[k].probability) < 1e-9 and r.disposition == rounds[k].disposition for k, r in one.items())


@pytest.mark.parametrize("lengths", [(3, 4, 5), (2, 4, 9, 18)])
def test_steps_equal_edges(lengths, monkeypatch):
    rng = np.random.default_rng(5)
    names = sorted({"".join(rng.choice(list("ACGT"), rng.choice(lengths))) for _ in range(500)})
    rows = pd.DataFrame({"sample_idx": 0, "umi": names, "family_size": rng.geometric(0.05, len(names)) * rng.choice([1, 50], len(names))})
    monkeypatch.setattr(umi_model, "FAR", 90)
    monkeypatch.setattr(umi_model, "NEAR", 70)
    assert len(umi_model.Steps(umi_model._numbers(names), np.array([len(x) for x in names])).full) in (2, 3)
    one, other = umi_model._assigned(rows), umi_model._assigned_by_steps(rows)
    assert one.parent.tolist() == other.parent.tolist() and np.allclose(one.probability, other.probability, rtol=1e-10, atol=0)


def test_tags_one_edit_away_are_not_broadcast(spark):
    counts = spark.createDataFrame([(0, "AACCGGTT", 3), (0, "AACCGGTA", 1)], "sample_idx long, umi string, family_size long")
    assert "Broadcast" not in umi_model.two_edit_likelihoods(counts)._jdf.queryExecution().executedPlan().toString()


def test_likelihoods_in_parts_equal_a_join(spark, monkeypatch):
    monkeypatch.setattr(umi_model, "PART", 9)
    rng = np.random.default_rng(6)
    names = {(s, "".join(rng.choice(list("ACGT"), rng.choice((3, 4))))) for s in (0, 1) for _ in range(60)} | {(1, "ANGT"), (2, "A" * 19), (2, "A" * 18)}
    counts = spark.createDataFrame([(s, u, 1) for s, u in sorted(names)], "sample_idx long, umi string, family_size long")
    parts, joined = ({tuple(r)[:3]: r.p for r in df.collect()} for df in (umi_model.likelihoods(counts), umi_model.two_edit_likelihoods(counts, unknown=True)))
    assert parts.keys() == joined.keys() and all(p == pytest.approx(joined[k], rel=1e-12) for k, p in parts.items())


def test_umi_model_of_seven_tags(spark):
    sizes = {"AACCGGT": 3, "AACCGGTA": 4, "AACCGGTT": 100, "AACCGTT": 2, "AAACCGGTT": 2, "TTGGCCAA": 20, "TTGGCCAT": 1}
    rows = [(0, k, v) for k, v in sizes.items()] + [(0, "REJECTS", 9), (1, "ACGTACGT", 1)]
    got = {r.umi: r for r in umi_model.families(spark.createDataFrame(rows, "sample_idx long, umi string, family_size long"), 0.995, 1).collect()}
    want = {
        "AACCGGTT": 0.9997206706751125, "TTGGCCAA": 0.9999752185102442, "TTGGCCAT": 0.9953653034063791, "AACCGGTA": 0.9908394985083859,
        "AACCGGT": 0.9705613797748646, "AACCGTT": 0.9595958824590427, "AAACCGGTT": 0.76905089963505,
    }
    for umi, p in want.items():
        assert got[umi].probability == pytest.approx(p, abs=1e-9) and got[umi].parent == umi
        assert got[umi].disposition == ("likely_real" if p > 0.995 else "LDA-rejects")
    assert (got["REJECTS"].parent, got["REJECTS"].disposition) == ("REJECTED", "BPB-rejects")
    assert got["ACGTACGT"].probability == 1.0


def test_a_rare_neighbour_belongs_to_its_parent(spark):
    rows = [(0, "AACCGGTT", 100_000), (0, "AACCGGTA", 1)]
    got = umi_model.families(spark.createDataFrame(rows, "sample_idx long, umi string, family_size long")).where("umi = 'AACCGGTA'").first()
    assert got.parent == "AACCGGTT"


def test_umi_queries_keep_every_tag(spark):
    query, _ = records.QUERIES["umi_families"]
    rows = query(spark, DATA)
    assert rows.count() == rows.select("sample_idx", "umi").distinct().count() > 0
    assert rows.where("probability is null or parent is null or probability > 1 + 1e-9").count() == 0


def test_orf_names_and_fasta(spark):
    rows = spark.createDataFrame([("CATGAAATAAATGCCCGGGTGA",), ("GCTGCTGCTTAA",), ("",), (None,), ("ATGTGA",)], "sequence string")
    assert {r.orf for r in annotations.longest_orfs(rows).collect()} == {"ATGCCCGGGTGA", "ATGTGA"}
    row = spark.range(1).select(
        annotations.display_name(F.lit("a_b"), F.lit(5), F.lit(0.8)), annotations.fasta_record(F.lit("n"), F.lit("ACGTAC"), 3), annotations.fasta_record(F.lit("n"), F.lit("ACGT"), 0)
    ).first()
    assert list(row) == ["a_b fs=5 minag=0.80", ">n\nACG\nTAC", ">n\nACGT"]


def test_shares_are_rounded_as_printf_does(spark):
    rng = np.random.default_rng(7)
    shares = [0.0, 1.0, 0.5, 0.625, 0.375, 0.125, 0.875, 0.615, 0.285, 0.005, 0.0049, 0.995, 0.9950000000000001, 1e-9, 2.0**-9, *rng.random(500).tolist(), *(rng.integers(0, 200, 300) / 200).tolist()]
    rows = spark.createDataFrame([(x,) for x in shares], "share double").select("share", annotations.two_decimals(F.col("share")).alias("text")).collect()
    assert all(r.text == f"{r.share:.2f}" for r in rows)


def test_references_beyond_the_exact_range_are_refused(spark):
    rows = spark.createDataFrame([(1, 1, "ACGTACGT")], "fam long, group long, sequence string")
    with pytest.raises(ValueError):
        annotations.nearest_references(rows, rows.withColumnRenamed("fam", "ref"), 0.5)


def test_references_in_tasks_equal_the_join(spark):
    rng = np.random.default_rng(8)
    some = lambda n: "".join(rng.choice(list("ACGT"), n, p=(0.6, 0.2, 0.1, 0.1)))
    odd = [("", 0), (None, 1), ("ACG", 2), ("AAAAAA", None), ("ac-gu" * 4, 3), ("NNé😀NNACGTAA", 1), ("A" * 300, 2), ("".join(map(chr, range(200, 1900))), 0), ("CCCCCCGGGGGG", 77)]
    texts = [*odd, *((some(rng.integers(4, 40)), int(rng.integers(0, 5))) for _ in range(60))]
    records = spark.createDataFrame([(k, g, t) for k, (t, g) in enumerate(texts)], "fam long, group long, sequence string")
    own = [(f"r{k}", int(rng.integers(0, 5)), some(rng.integers(5, 30))) for k in range(12)] + [("none", None, "AAAAAAAA"), ("twin", 0, "AAAAAAAA"), ("same", 1, "AAAAAAAA"), ("empty", 1, None)]
    references = spark.createDataFrame(own, "ref string, group long, sequence string")
    joined, plan = annotations.nearest_references(records, references, 0.1), annotations.nearest_references(records, references, 0.1, different=True)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, joined.collect())) and plan.schema == joined.schema
