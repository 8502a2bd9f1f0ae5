"""The functional filter against a plain version over whole alignment rows."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from strandloom.operators import functional, msa, panel
from strandloom.operators.annotations import longest_orf
from strandloom.plans import amplicons

DATA = "/root/testdata/sf0.001"


def plain(proteins, frames, reference, threshold):
    """proteins: aligned rows; each frame's verdict by nucleotide rows with the reference as one more row."""
    rows, own = panel.added(proteins, functional.translated(reference))

    def back(row, coding):
        codons = iter(re.findall("...", coding))
        return "".join("---" if c == "-" else next(codons) for c in row)

    line = back(own, reference)
    first, last = re.search("[^-]", line).start(), len(line.rstrip("-"))
    out = []
    for row, frame in zip(rows, frames):
        query, why = back(row, frame)[first:last], []
        if query[:3] != "ATG":
            why.append("lateStart-reject")
        if query.endswith("---"):
            why.append("earlyStop-reject")
        share = sum(a == b for a, b in zip(query, line[first:last])) / (last - first)
        ratio = float(f"{share:.3g}")
        if ratio < threshold:
            why.append(f"badMatch-reject (match={ratio:g})")
        out.append((not why, why, round(share, 2), query.replace("-", "")))
    return out


def test_verdicts_equal_whole_rows(spark):
    good = "ATGGCTTGCGATGAATTTGGTCATATTAAATAA"
    rows = [(1, k, t) for k, t in enumerate([good, good, good[:9] + "GCA" + good[9:], good[:12] + good[15:], "CC" + good + "GG", "ATGCCCTAA", "ATG" + good[12:], good.replace("GATGAA", "CCCCCC")])]
    rows += [(1, 20, good[:5] + "N" + good[6:]), (1, 21, "CCCC"), (1, 22, None), (1, 23, "atg-gct tgcgatgaatttggtcatattaaauaa"), (2, 1, "GGGG"), (None, 1, good)]
    frame = spark.createDataFrame(rows, "g int, id int, sequence string").withColumn("group", F.lit("clash"))
    got = {(r.g, r.id): r for r in functional.functional_filter(frame, "g", good + "AC").collect()}
    assert set(got) == {(g, i) for g, i, _ in rows}
    assert got[1, 20].functional_reasons == ["ambiguousSymbols-reject"] and got[1, 21].functional_reasons == got[1, 22].functional_reasons == got[2, 1].functional_reasons == ["noORF-reject"]
    frames = {k: longest_orf("".join((t or "").split()).replace("-", "").upper().replace("U", "T")) for g, k, t in rows if g == 1 and k != 20}
    frames = {k: f for k, f in frames.items() if f}
    made = spark.createDataFrame([(1, k, functional.translated(f)) for k, f in frames.items()], "g int, id int, protein string")
    aligned = {r.id: r.aligned for r in msa.multiple_alignment(made, "g", "protein").collect()}
    for (k, f), want in zip(frames.items(), plain([aligned[k] for k in frames], list(frames.values()), good, 0.7)):
        r = got[1, k]
        assert (r.functional_pass, r.functional_reasons, r.reference_match, r.trimmed_nt) == want and r.trimmed_aa == functional.translated(r.trimmed_nt)
    assert got[1, 0].functional_pass and got[1, 4].functional_pass and got[1, 23].functional_pass and got[None, 1].reference_match == 1.0 and not got[1, 5].functional_pass
    assert not functional.functional_filter(frame.where("false"), "g", good).count()


def test_rounding_is_half_up_on_three_digits():
    assert functional.significant(0.12345) == 0.123 and functional.significant(0.0012345) == 0.00123 and functional.significant(0) == 0
    assert functional.rounded(0.125, 2) == 0.13 and functional.rounded(0.5, 0) == 1


def test_functional_haplotypes_of_the_test_table(spark):
    rows = amplicons.QUERIES["functional_filter"][0](spark, DATA).collect()
    by = defaultdict(list)
    for r in rows:
        frame = longest_orf(r.haplotype)
        assert (frame is None) == (r.functional_reasons == ["noORF-reject"])
        if frame:
            by[r.sample_idx].append((r, frame))
    assert any(r.functional_pass for r in rows) and by
    for own in by.values():
        made = spark.createDataFrame([(1, k, functional.translated(f)) for k, (_, f) in enumerate(own)], "g int, id int, protein string")
        aligned = {r.id: r.aligned for r in msa.multiple_alignment(made, "g", "protein").collect()}
        want = plain([aligned[k] for k in range(len(own))], [f for _, f in own], amplicons.REFERENCE, 0.7)
        assert [(r.functional_pass, r.functional_reasons, r.trimmed_nt) for r, _ in own] == [(p, w, t) for p, w, _, t in want]
