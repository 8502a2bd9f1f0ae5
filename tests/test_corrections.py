import random
from collections import Counter

from conftest import DATA
from strandloom.operators import corrections, reports
from strandloom.plans import amplicons
from strandloom.plans.reports import QUERIES, _versions


def plain_kinds(a: str, b: str) -> tuple[int, int, int]:
    """One cell at a time: (cost, substituted, inserted, removed), the first of the cheapest of diagonal, removal, insertion."""
    table = {(0, 0): (0, 0, 0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            steps = []
            if i and j:
                c, s, n, r = table[i - 1, j - 1]
                steps.append((c + (a[i - 1] != b[j - 1]), s + (a[i - 1] != b[j - 1]), n, r))
            if i:
                c, s, n, r = table[i - 1, j]
                steps.append((c + 1, s, n, r + 1))
            if j:
                c, s, n, r = table[i, j - 1]
                steps.append((c + 1, s, n + 1, r))
            if steps:
                table[i, j] = min(steps, key=lambda x: x[0])
    return table[len(a), len(b)][1:]


def test_edit_kinds_equal_the_whole_table():
    rng = random.Random(3)
    assert corrections.edit_kinds("", "ACG") == (0, 3, 0) and corrections.edit_kinds("ACG", "") == (0, 0, 3) and corrections.edit_kinds("A", "C") == (1, 0, 0)
    for n in range(300):
        a = "".join(rng.choices("ACGT"[: 2 + n % 3], k=rng.randrange(14)))
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choices("ACGTNé", k=rng.randrange(3))
        assert corrections.edit_kinds(a, "".join(b)) == plain_kinds(a, "".join(b)), (a, b)


def test_pairs_are_compared_together(monkeypatch):
    rng, pairs = random.Random(4), [("", "ACG"), ("ACG", ""), ("A", "A")]
    for n in range(400):
        a = "".join(rng.choices("ACGT"[: 2 + n % 3], k=rng.randrange(20)))
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choices("ACGTNé😀", k=rng.randrange(4))
        pairs.append((a, "".join(b)))
    want, one, plain = [plain_kinds(a, b) for a, b in pairs], [], corrections.edit_kinds
    monkeypatch.setattr(corrections, "edit_kinds", lambda a, b: one.append(a) or plain(a, b))
    assert corrections.edit_kinds_of_all(pairs) == want and len(one) < 16
    monkeypatch.setattr(corrections, "TOGETHER", 37)
    assert corrections.edit_kinds_of_all(pairs) == want
    far = [("".join(rng.choices("ACGT", k=3990)), "".join(rng.choices("ACGT", k=rng.randrange(30)))) for _ in range(20)]
    assert corrections.edit_kinds_of_all(far) == [plain(a, b) for a, b in far]


def test_corrections_of_small_alignments(spark):
    before = spark.createDataFrame([("same", "AC-G"), ("gaps", "AC-G"), ("gone", "ACG"), ("sub", "ACGT"), ("ins", "A--T"), ("null", None), ("twin", "ACGT")], "name string, aligned string")
    after = spark.createDataFrame([("same", "AC-G"), ("gaps", "A-CG"), ("new", "TTT"), ("sub", "AGGT"), ("ins", "ACCT"), ("null", "AC"), ("twin", "AGGT")], "name string, aligned string")
    got = {r.name: tuple(r)[1:] for r in corrections.corrected_rows(before, after).collect()}
    assert got["same"] == ("same", False, 0, 0, 0) and got["gaps"] == ("changed", True, 0, 0, 0) and got["gone"] == ("removed", False, 0, 0, 0)
    assert got["new"] == ("added", False, 0, 0, 0) and got["sub"] == got["twin"] == ("changed", False, 1, 0, 0) and got["ins"] == ("changed", False, 0, 2, 0)
    (total,) = corrections.correction_totals(before.where("name <> 'null'"), after.where("name <> 'null'")).collect()
    assert tuple(total) == (6, 6, 1, 1, 4, 1, 2, 2, 0)
    (empty,) = corrections.correction_totals(before.limit(0), after.limit(0)).collect()
    assert tuple(empty) == (0,) * 9


def test_corrections_of_the_test_table(spark):
    before, after = ({r.name: r.aligned for r in df.collect()} for df in _versions(spark, DATA))
    got = {r.name: tuple(r)[3:] for r in QUERIES["corrected_rows"][0](spark, DATA).collect()}
    bare = lambda t: t.replace("-", "").upper().replace("U", "T")
    assert set(got) == set(before) | set(after) and any(n for n in got.values())
    for name, found in got.items():
        assert found == (plain_kinds(bare(before[name]), bare(after[name])) if name in before and name in after else (0, 0, 0))
    (total,) = QUERIES["correction_totals"][0](spark, DATA).collect()
    assert (total.substituted, total.inserted, total.removed) == tuple(sum(x) for x in zip(*got.values()))
    assert (total.rows_before, total.rows_after, total.rows_added) == (len(before), len(after), len(set(after) - set(before)))


def test_functional_statistics(spark):
    rows = [(1, 5, True, []), (1, 3, False, ["noORF-reject"]), (1, 2, False, ["frameshift-reject", "badMatch-reject (0.5)"]), (1, 10, None, None), (2, 4, None, ["noORF-reject"]), (None, 1, True, None)]
    frame = spark.createDataFrame(rows, "sample_idx int, families long, functional_pass boolean, functional_reasons array<string>")
    got = {(r.sample_idx, r.filter): tuple(r)[2:] for r in reports.functional_stats(frame).collect()}
    assert len(got) == 3 * 11
    assert got[1, "all"] == (4, 100.0, 20, 100.0) and got[1, "evaluated"] == (3, 75.0, 10, 50.0) and got[1, "not-evaluated"] == (1, 25.0, 10, 50.0)
    assert got[1, "passed"] == (1, 25.0, 5, 25.0) and got[1, "rejected"] == (2, 50.0, 5, 25.0) and got[1, "no-orf"] == (1, 25.0, 3, 15.0)
    assert got[1, "frameshift"] == got[1, "bad-match"] == (1, 25.0, 2, 10.0) and got[1, "late-start"] == (0, 0.0, 0, 0.0)
    assert got[2, "no-orf"] == (0, 0.0, 0, 0.0) and got[None, "passed"] == (1, 100.0, 1, 100.0)
    assert not reports.functional_stats(frame.limit(0)).count()


def test_probability_bins(spark):
    values = [0.0, 0.0025, 0.00249, 1.0, 0.9975, 1.5, -0.1, None, 0.5]
    frame = spark.createDataFrame([(1, v) for v in values], "sample_idx int, probability double")
    assert {r.bin: r.families for r in reports.probability_bins(frame).collect()} == {0: 3, 1: 1, 200: 3, 100: 1}


def test_plot_sites(spark):
    site = "array<struct<position int, agreement float, modal_base string, run_length int>>"
    rows = [("a", [(3, 0.95, "A", 9), (5, 0.8, "C", 2), (7, 0.9, "G", 4), (9, 0.5, "T", 4)]), ("b", [(1, 0.99, "A", 1)]), ("c", []), ("d", None)]
    got = reports.plot_sites(spark.createDataFrame(rows, f"id string, sites {site}")).collect()
    assert [(r.id, r.site_position, r.site_run) for r in got] == [("a", 7, 4)]


def test_reports_of_the_raw_reads(spark):
    run = lambda name: amplicons.QUERIES[name][0](spark, DATA).collect()
    found = run("family_dispositions")
    want = Counter((r.sample_idx, min(200, int(r.probability * 200 + 0.5))) for r in found if r.probability is not None)
    assert {(r.sample_idx, r.bin): r.families for r in run("posterior_bins")} == want and want
    verdicts = run("functional_filter")
    stats = {(r.sample_idx, r.filter): (r.variants, r.families) for r in run("functional_stats")}
    for sample in {r.sample_idx for r in verdicts}:
        own = [r for r in verdicts if r.sample_idx == sample]
        for name, some in (("all", own), ("passed", [r for r in own if r.functional_pass]), ("no-orf", [r for r in own if any(x.startswith("noORF") for x in r.functional_reasons)])):
            assert stats[sample, name] == (len(some), sum(r.families for r in some))
    sites = {(r.sample_idx, r.umi): r.sites for r in run("family_consensus")}
    low = {k: [s for s in v if s.agreement <= 0.9] for k, v in sites.items()}
    assert len(run("plot_sites")) == sum(1 for v in low.values() if v)
