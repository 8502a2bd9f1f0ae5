"""From raw reads to judged consensus records, each stage against a plain version on the test tables."""

import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import alignment, consensus, contamination, demultiplex, panel, trimming, umi_model
from strandloom.plans import amplicons

DATA = "/root/testdata/sf0.001"
TURN = str.maketrans("ACGTN", "TGCAN")


def mutated(rng, text, rate):
    out = ""
    for letter in text:
        u = rng.random()
        if u < rate / 3:
            continue
        out += rng.choice(list("ACGT")) if u < 2 * rate / 3 else ""
        out += rng.choice(list("ACGT")) if 2 * rate / 3 < u < rate else letter
    return out


def some(rng, n):
    return "".join(rng.choice(list("ACGT"), n))


# Alignment


def in_band(a, b, banded):
    """Global alignment by the recurrence over the cells of the band."""
    half = math.ceil(math.sqrt((len(a) + len(b)) / 2)) if banded and a and b else 10**6
    low, high = -half - max(0, len(a) - len(b)), half + max(0, len(b) - len(a))
    never, score, step = -(10**9), {}, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not low <= j - i <= high:
                continue
            if not i or not j:
                score[i, j], step[i, j] = -99 * (i + j), 3 if i else 2
                continue
            ways = [score.get((i - 1, j - 1), never) + (100 if a[i - 1] == b[j - 1] else -100), score.get((i, j - 1), never) - (99 if i == len(a) else 100), score.get((i - 1, j), never) - (99 if j == len(b) else 100)]
            score[i, j], step[i, j] = max(ways), 1 + ways.index(max(ways))
    i, j, x, y = len(a), len(b), "", ""
    while i or j:
        s = 2 if not i else 3 if not j else step[i, j]
        x, y = (a[i - 1] if s != 2 else "-") + x, (b[j - 1] if s != 3 else "-") + y
        i, j = i - (s != 2), j - (s != 3)
    return x, y


def test_banded_alignment_equals_recurrence():
    rng = np.random.default_rng(0)
    pairs = []
    for _ in range(150):
        a = some(rng, rng.integers(0, 40))
        pairs.append((a, mutated(rng, a, 0.3) if rng.random() < 0.7 else some(rng, rng.integers(0, 40))))
    assert alignment.aligned(*zip(*pairs), banded=True) == [in_band(a, b, True) for a, b in pairs]
    assert alignment.aligned(*zip(*pairs)) == [in_band(a, b, False) for a, b in pairs]
    assert alignment.aligned(*zip(*pairs[:3]), banded=True) == [in_band(a, b, True) for a, b in pairs[:3]]


def test_seeds_are_chained_and_long_reads_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    block, unit = some(rng, 60), some(rng, 45)
    words = alignment.seeds(block + unit + unit)
    assert all((block + unit + unit).count(w) >= 1 and at % 10 == 0 for w, at in words.items())
    # a word that the query repeats is no seed, and crossed stretches leave the longest run in order
    assert alignment.anchors(alignment.seeds(block), block + block) == []
    a, b, c = (some(rng, 60) for _ in range(3))
    assert [x[:2] for x in alignment.anchors(alignment.seeds(a + b + c), b + c + a)] == [(60, 0)]
    read = some(rng, 50_000)
    other = mutated(rng, read, 0.02)
    tracemalloc.start()
    both = alignment.written_out(read, other, alignment.seeded_steps([(read, other)])[0])
    banded = alignment.aligned([read[:20_000]], [other[:20_000]], banded=True)[0]
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert both[0].replace("-", "") == read and both[1].replace("-", "") == other
    assert sum(x == y for x, y in zip(*both)) > 0.98 * len(read)
    assert banded[0].replace("-", "") == read[:20_000]
    short = [(x, mutated(rng, x, 0.05)) for x in (some(rng, 200) for _ in range(20))]
    for (x, y), path in zip(short, alignment.seeded_steps(short)):
        found, full = alignment.written_out(x, y, path), in_band(x, y, False)
        assert sum(p == q for p, q in zip(*found)) >= sum(p == q for p, q in zip(*full)) - 3


def test_seeded_alignments_of_the_test_table(spark):
    rows = amplicons.amplicons(spark, DATA).select("ordinal", "molecule", "read").collect()
    got = {r.ordinal: (r.aligned_reference, r.aligned_query) for r in amplicons.QUERIES["seeded_alignments"][0](spark, DATA).collect()}
    assert len(got) == len(rows) > 5000
    for r in rows[::40]:
        reference, query = got[r.ordinal]
        assert len(reference) == len(query) and reference.replace("-", "") == r.molecule and query.replace("-", "") == r.read
        score = lambda pair: sum(100 if x == y else -100 for x, y in zip(*pair))
        assert score((reference, query)) == score(in_band(r.molecule, r.read, False))


# Demultiplexing


def plain_tag(text, fixed):
    """Tag, errors and score by the recurrence, one cell after another."""
    ins = dele = -4.605170185988091
    rows = len(fixed) + 2
    score, step = [[0.0] * (len(text) + 1) for _ in range(rows)], {}
    for i in range(1, rows):
        score[i][0], step[i, 0] = score[i - 1][0] + (0 if i == rows - 1 else dele), "d"
    for j in range(1, len(text) + 1):
        score[0][j], step[0, j] = score[0][j - 1] + ins, "i"
    fits = lambda a, b: bool(trimming._MASK[ord(a)] & trimming._MASK[ord(b)])
    for i in range(1, rows):
        for j in range(1, len(text) + 1):
            if i == rows - 1:
                down = score[i - 1][j] > score[i][j - 1] - 1e-10
                score[i][j], step[i, j] = (score[i - 1][j], "d") if down else (score[i][j - 1], "i")
                continue
            emission = -1.3862943611198906 if fixed[i - 1] is None else -0.0010005003335835344 if fits(fixed[i - 1], text[j - 1]) else -8.006367567650246
            a, b, c = score[i - 1][j - 1] + emission, score[i][j - 1] + ins, score[i - 1][j] + dele
            score[i][j], step[i, j] = (a, "m") if a > c - 1e-10 and a > b - 1e-10 else (b, "i") if b > c - 1e-10 else (c, "d")
    i, j, tag, errors = rows - 1, len(text), "", 0
    is_tag = [False, *(x is None for x in fixed), False, False]
    while i or j:
        s = step[i, j]
        if s == "m":
            tag += text[j - 1] if is_tag[i] else ""
            errors += not is_tag[i] and not fits(fixed[i - 1], text[j - 1])
        elif s == "i":
            tag += text[j - 1] if is_tag[i] or is_tag[i + 1] else ""
            errors += i != rows - 1
        else:
            errors += i != rows - 1
        i, j = i - (s != "i"), j - (s != "d")
    return tag[::-1].upper(), errors, score[-1][-1]


def test_tags_equal_recurrence():
    rng = np.random.default_rng(2)
    sample = demultiplex.Sample("s", "CCGCTacgtNNNNNNCAGT", "AAA")
    profile = demultiplex.Profile.of(sample)
    assert profile.fixed == ["A", "C", "G", "T", *[None] * 6, "C", "A", "G", "T"]
    texts = [mutated(rng, "ACGT" + some(rng, 6) + "CAGT" + some(rng, 6), rng.choice([0, 0.1, 0.4]))[: rng.integers(3, 24)] for _ in range(300)] + ["", "N", "RYSW"]
    found = demultiplex.tags(texts, profile)
    assert list(zip(found.tag, found.errors.tolist(), found.score.tolist())) == [plain_tag(t, profile.fixed) for t in texts]
    assert demultiplex.Profile.of(demultiplex.Sample("s", "CCGCTacgt", "A")) is None
    assert demultiplex.tags(["ACGT"], None).errors.tolist() == [4]


def plain_find_last(text, pattern, tolerance):
    """The last of the repeated first hits of a pattern, as its (start, end)."""
    at, last = 0, None
    while True:
        state = [(k, -at) for k in range(len(pattern) + 1)]
        hit = None
        for j in range(at, len(text)):
            new = [(0, -(j + 1))]
            for i in range(1, len(pattern) + 1):
                miss = not trimming._MASK[ord(text[j])] & trimming._MASK[ord(pattern[i - 1])]
                new.append(min((state[i - 1][0] + miss, state[i - 1][1]), (state[i][0] + 1, state[i][1]), (new[i - 1][0] + 1, new[i - 1][1])))
            state = new
            if state[-1][0] <= tolerance:
                hit = (-state[-1][1], j + 1)
                break
        if hit is None:
            return last
        last, at = hit, hit[1]


def plain_demultiplexed(ordinal, sequence, quality):
    total = 0.0
    for c in quality:
        total += 10.0 ** (-(ord(c) - 33) / 10)
    error = total / len(quality) if quality else 1.0
    for bad, why in ((error >= amplicons.ERROR, "quality-reject"), (len(sequence) <= amplicons.SHORT, "short-reject"), (len(sequence) >= amplicons.LONG, "long-reject")):
        if bad:
            return [(ordinal, why, None, None, None)]
    out, primed = [], False
    for forward, members in (("TAGGATCATG", range(4)), ("ATTGACGATC", range(4, 8))):
        for text in (sequence, sequence.translate(TURN)[::-1]):
            a = plain_find_last(text[:200], forward, 1)
            b = a and plain_find_last(text[-200:].translate(TURN)[::-1], amplicons.ADAPTER, 1)
            if a and b and a[1] < len(text) - b[1]:
                primed = True
                insert = text[a[1] : len(text) - b[1]].translate(TURN)[::-1]
                for k in members:
                    at = insert[:10].find(amplicons.IDENTIFIERS[k].upper())
                    if at >= 0:
                        fixed = [*amplicons.IDENTIFIERS[k].upper(), *[None] * 8, *amplicons.TAIL]
                        tag, errors, _ = plain_tag(insert[at:][: 6 + 19 + 2], fixed)
                        out.append((ordinal, "BPB-reject" if errors > 4 else "assigned", k, "REJECTS" if errors > 4 else tag or "NO_TAG", errors))
                break
    return out or [(ordinal, "id-reject" if primed else "primer-reject", None, None, None)]


def test_demultiplexed_reads_equal_plain_version(spark):
    reads = amplicons.amplicons(spark, DATA).where("ordinal % 6 < 1").select("ordinal", "sequence", "quality").collect()
    want = sorted((r for x in reads for r in plain_demultiplexed(*x)), key=repr)
    got = amplicons.QUERIES["demultiplexed_reads"][0](spark, DATA).where("ordinal % 6 < 1").collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert {r[1] for r in want} >= {"assigned", "quality-reject", "id-reject", "primer-reject"}


def test_only_tags_that_do_not_fit_are_aligned(spark, monkeypatch):
    sample = amplicons.SAMPLES[0]
    head, profile = "ACGTCA", demultiplex.Profile.of(sample)
    tail, aligned, plain = amplicons.TAIL, [], demultiplex._aligned_tags
    texts = [f"{head}AACCGGTT{tail}GG", f"{head}nnNNACGT{tail}", f"{head}AACCGTT{tail}GGG", f"{head}AACCGGTT{tail[:-1]}", f"{head}AACCGGTT{tail[:3]}X{tail[4:]}AA"]
    want = [demultiplex.tags([t], profile) for t in texts]
    every = np.array([[demultiplex._MASK[ord(x)] if x else 255] * len(texts) for x in profile.fixed], np.uint8)
    whole = plain(texts, tuple(x is None for x in profile.fixed), every)
    assert whole.tag == [w.tag[0] for w in want] and whole.errors.tolist() == [int(w.errors[0]) for w in want] and whole.score.tolist() == [float(w.score[0]) for w in want]
    monkeypatch.setattr(demultiplex, "_aligned_tags", lambda texts, *rest: aligned.extend(texts) or plain(texts, *rest))
    demultiplex.tags(texts, profile)
    assert aligned == texts[2:]


def test_stages_are_counted_in_tasks(spark):
    rows = amplicons.amplicons(spark, DATA).limit(3000).cache()
    gates = demultiplex.Gates(amplicons.ERROR, amplicons.SHORT, amplicons.LONG)
    counted, listed = (sorted(map(tuple, df.collect()), key=str) for df in (demultiplex.stage_counts(rows, amplicons.SAMPLES, gates), demultiplex.status_counts(demultiplex.demultiplexed(rows, amplicons.SAMPLES, gates))))
    assert counted == listed and sum(n for *_, n in counted) >= 3000


def test_demultiplexing_of_odd_reads(spark):
    rows = [(1, None, None), (2, "", ""), (3, "ACGT" * 40, "I"), (4, "ACGT" * 40, None), (5, "ACGT" * 200, "I" * 800), (6, "ACGT" * 40, "I" * 160)]
    frame = spark.createDataFrame(rows, "ordinal long, sequence string, quality string").withColumn("status", F.lit("clash"))
    got = {r.ordinal: r.status for r in demultiplex.demultiplexed(frame, amplicons.SAMPLES, demultiplex.Gates(0.05, 80, 400)).collect()}
    assert got == {1: "quality-reject", 2: "quality-reject", 3: "quality-reject", 4: "quality-reject", 5: "long-reject", 6: "primer-reject"}
    assert not demultiplex.demultiplexed(frame.where("false"), amplicons.SAMPLES).count()
    made = [demultiplex.Sample("a", "CCGTacNN", "GATTACA"), demultiplex.Sample("b", "CCGTgtNN", "ATTAC"), demultiplex.Sample("c", "CCGAacNN", "TTTT")]
    assert demultiplex.adapter(made) == "CCG" and demultiplex.groups(made) == [("GATTACA", [0, 1]), ("TTTT", [2])]


def test_stages_add_up_and_down_sampling_keeps_the_lowest_hashes(spark):
    rows = amplicons.assigned(spark, DATA).cache()
    stages = amplicons.QUERIES["read_stages"][0](spark, DATA).collect()
    assert sum(r.n for r in stages) == rows.count() and {r.status for r in stages if r.sample_idx is not None} <= {"assigned", "BPB-reject"}
    mine = rows.where("sample_idx = 3")
    n = mine.count()
    kept = demultiplex.downsampled(mine, 50).collect()
    cutoff = ((1 << 64) - 1) * 50 // n
    assert {r.ordinal for r in kept} == {r.ordinal for r in mine.collect() if int(r.sampling_hash) <= cutoff} and 20 < len(kept) < 90
    one = mine.first()
    assert alignment.stable_hashes([one["name"]], [one.umi], 3).tolist() == [int(one.sampling_hash)]
    rows.unpersist()


# The UMI model


def plain_edges(tags):
    def near(tag, same):
        out = [(tag[:p] + b + tag[p:], umi_model.INSERTION) for b in "ACTG" for p in range(len(tag) + 1)] + [(tag[:p] + tag[p + 1 :], umi_model.DELETION) for p in range(len(tag))]
        return out + [(tag[:p] + b + tag[p + 1 :], umi_model.SUBSTITUTION) for b in "ACTG" for p in range(len(tag)) if same or tag[p] != b]

    out = defaultdict(float)
    for seen in tags:
        for middle, p in near(seen, True):
            for real, q in [*near(middle, False), (middle, (1 - umi_model.ERROR) ** len(middle))]:
                if real in tags:
                    out[seen, real] += p * q
        out[seen, seen] = (1 - umi_model.ERROR) ** len(seen)
    return out


def test_edges_of_tags_equal_plain_version(monkeypatch):
    rng = np.random.default_rng(3)
    names = sorted({some(rng, rng.integers(4, 7)) for _ in range(120)} | {"ACNGT", "ACGT", "AACGT", "A"})
    numbers = np.array([int("1" + "".join(format("ACTG".find(c) & 7, "03b") for c in n), 2) for n in names])
    monkeypatch.setattr(umi_model, "PAIRS", 500)
    seen, real, p = umi_model._edges(numbers, np.array([len(n) for n in names]))
    want = plain_edges(set(names))
    assert {(names[a], names[b]) for a, b in zip(seen, real)} == set(want)
    assert all(x == pytest.approx(want[names[a], names[b]], rel=1e-12) for a, b, x in zip(seen, real, p))


# Family consensus


def columns(reference, read):
    x, y = alignment.written_out(reference, read, alignment.seeded_steps([(reference, read)])[0])
    return y, [k for k, c in enumerate(x) if c != "-"]


def plain_mode(values):
    seen, best, most = Counter(), "", 0
    for v in values:
        seen[v] += 1
        if seen[v] > most:
            best, most = v, seen[v]
    return best


def plain_overhang(values, front):
    found = ""
    for _ in range(max(map(len, values), default=0) + 1):
        if 2 * sum(map(bool, values)) <= len(values):
            break
        values_before, active = values, [v for v in values if v]
        found, values = plain_mode(active), []
        for v in active:
            x, y = alignment.aligned([found], [v])[0]
            at = [k for k, c in enumerate(x) if c != "-"]
            values.append((y[: at[0]] if front else y[at[-1] + 1 :]).replace("-", ""))
        if values == values_before:
            break
    return found


def plain_consensus(reads):
    if len(set(reads)) == 1:
        return reads[0], 1.0, []
    words = [Counter(r[k : k + 6] for k in range(len(r) - 5)) for r in reads]
    keys = sorted(set().union(*words))
    mean = {k: sum(w[k] for w in words) / len(reads) for k in keys}
    total = sum(sum(w.values()) for w in words) / len(reads)
    gaps = [sum((w[k] - mean[k]) ** 2 for k in keys) / (6 * (sum(w.values()) + total)) if total else 0 for w in words]
    candidate = reads[next(k for k, g in enumerate(gaps) if g <= min(gaps) + 1e-12)]
    for _ in range(3):
        rows = [columns(candidate, r) for r in reads]
        good = [True] * len(candidate)
        for p in range(len(candidate) - 1):
            if sum(y[m[p] : m[p + 1] + 1].replace("-", "") == candidate[p : p + 2] for y, m in rows) / len(reads) < 0.7:
                good[p] = good[p + 1] = False
        then, p = candidate, 0
        if len(candidate) > 1:
            then = plain_overhang([y[: m[0]].replace("-", "") for y, m in rows], True)
            while p < len(candidate):
                q = p
                while q < len(candidate) and good[q] == good[p]:
                    q += 1
                then += candidate[p:q] if good[p] else plain_mode([y[m[p] : m[q - 1] + 1].replace("-", "") for y, m in rows])
                p = q
            then += plain_overhang([y[m[-1] + 1 :].replace("-", "") for y, m in rows], False)
        if then == candidate:
            break
        candidate = then
    rows = [columns(candidate, r) for r in reads]
    half_up = lambda x: int(x * 100 + 0.5) / 100
    votes = [[y[m[p]] for y, m in rows] for p in range(len(candidate))]
    share = [half_up(sum(v == c for v in vote) / len(reads)) for vote, c in zip(votes, candidate)]
    least = min(share[1:-1]) if len(share) > 2 else 0.0
    modal = [plain_mode(v) for v in votes]
    sites = []
    for p in range(len(candidate)):
        if share[p] <= least and modal[p] != "-":
            first = end = p
            while first and modal[first - 1] == modal[p]:
                first -= 1
            while end + 1 < len(candidate) and modal[end + 1] == modal[p]:
                end += 1
            sites.append((len(candidate) - p, share[p], modal[p].translate(TURN), end - first + 1))
    return candidate, least, sites


def test_consensus_equals_plain_version_on_families_with_indels():
    rng = np.random.default_rng(7)
    families = []
    for _ in range(120):
        text = some(rng, rng.integers(1, 140))
        rate = rng.choice([0, 0.02, 0.1])
        families.append([mutated(rng, text, rate)[rng.integers(0, 4) :] if rng.random() < 0.7 else text for _ in range(rng.integers(1, 9))])

    def distinct(reads):
        at = defaultdict(list)
        for k, r in enumerate(reads):
            at[r].append(k)
        return [consensus.Read(r, len(v), v[0], v[-1]) for r, v in at.items()]

    got = consensus.consensuses([distinct(f) for f in families])
    assert [(c.sequence, c.agreement, [tuple(s) for s in c.sites]) for c in got] == [plain_consensus(f) for f in families]


def test_primer_is_cut_with_wildcards_and_errors():
    primer = "ACGTNNNNCAGT"
    assert consensus.primer_cut(["ACGTGGGGCAGTTTGCA", "ACGGGGGCAGTTTGCA", "ACGTGGGGCAATTTGCA", "AC", ""], primer) == ["TTGCA", "TTGCA", "TTGCA", "", ""]
    assert consensus.primer_cut(["ACGT"], "") == ["ACGT"]


def test_family_consensus_of_the_test_table(spark):
    reads = amplicons.kept(spark, DATA).cache()
    want = defaultdict(list)
    for r in sorted(reads.collect(), key=lambda r: r.ordinal):
        want[r.sample_idx, r.umi].append(r.sequence)
    got = amplicons.QUERIES["family_consensus"][0](spark, DATA).collect()
    assert len(got) > 300 and len({(r.sample_idx, r.umi) for r in got}) == len(got)
    for r in got:
        own = want[r.sample_idx, r.umi]
        text, least, sites = plain_consensus(own)
        primer = amplicons.SAMPLES[r.sample_idx].cdna_primer[len(amplicons.ADAPTER) :].upper()
        assert (r.family_size, r.agreement) == (len(own), least)
        assert r.sequence == consensus.primer_cut([text], primer)[0].translate(TURN)[::-1]
        assert [(s.position, s.modal_base, s.run_length) for s in r.sites] == [(p, m, n) for p, _, m, n in sites]
    reads.unpersist()


def test_family_consensus_of_odd_reads(spark):
    rows = [("a", 1, "ACGTACGT"), ("a", 2, None), ("a", 3, "ACGTACGT"), (None, 1, "acgt"), (None, 1, "ACGT"), ("e", 1, ""), ("e", 2, None)]
    frame = spark.createDataFrame(rows, "k string, ordinal long, sequence string").withColumn("n", F.lit("clash"))
    got = {r.k: (r.family_size, r.sequence, r.agreement) for r in consensus.family_consensus(frame, ["k"]).collect()}
    assert got == {"a": (3, "ACGTACGT", 0.67), None: (2, "ACGT", 1.0), "e": (2, "", 1.0)}
    assert not consensus.family_consensus(frame.where("false"), ["k"]).count()


# Contamination


def plain_profile(text):
    out = np.zeros(4096)
    for k in consensus.profile(text):
        out[k] += 1
    return out


def plain_distance(a, b):
    total = a.sum() + b.sum()
    return max(0.0, ((a - b) ** 2).sum()) / (6 * total) if total else 0.0


def plain_clusters(vectors, radius):
    centres, assigned = [vectors[0]], [-1] * len(vectors)
    for _ in range(3):
        changed = False
        for k, v in enumerate(vectors):
            gaps = [plain_distance(v, c) for c in centres]
            at = int(np.argmin(gaps))
            if gaps[at] > radius:
                centres.append(v)
                at = len(centres) - 1
            changed |= assigned[k] != at
            assigned[k] = at
        centres = [np.mean([v for v, a in zip(vectors, assigned) if a == k], axis=0) if k in assigned else np.zeros(4096) for k in range(len(centres))]
        if not changed:
            break
    return [(assigned.count(k), c) for k, c in enumerate(centres) if k in assigned]


@pytest.mark.parametrize("radius", [0.015, 0.05, 0.1])
def test_dp_means_equals_plain_version(radius):
    rng = np.random.default_rng(5)
    for _ in range(6):
        base = [some(rng, 80) for _ in range(4)]
        texts = []
        for _ in range(50):
            text = list(base[rng.integers(4)])
            for _ in range(rng.integers(0, 4)):
                text[rng.integers(80)] = rng.choice(list("ACGT"))
            texts.append("".join(text))
        texts += [texts[k] for k in rng.integers(0, 50, 30)]
        places = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        got = contamination.dp_means(contamination.Profiles(list(places)), np.array([places[t] for t in texts]), radius)
        want = plain_clusters([plain_profile(t) for t in texts], radius)
        assert [c.members for c in got] == [n for n, _ in want]
        assert all(np.allclose(c.centre, w) for c, (_, w) in zip(got, want))


def plain_calls(records, names, foreign, groups, limits=contamination.Thresholds()):
    """records by sample, in order: (id, sequence)."""
    entries = []
    for k in sorted(records):
        vectors = [plain_profile(s) for _, s in records[k]]
        for i, (n, c) in enumerate(plain_clusters(vectors, limits.cluster)):
            share = n / len(vectors)
            tenths = int(1000 * share + 0.5)
            entries.append((f"{names[k]}_cluster{i + 1}_{tenths // 10}{f'.{tenths % 10}' if tenths % 10 else ''}%", groups[k], share > limits.proportion, c))
        entries.append((f"{names[k]}_All", groups[k], True, np.mean(vectors, axis=0)))
    entries += [(name, None, True, plain_profile(s)) for name, s in foreign]
    out = set()
    for k in records:
        for name, s in records[k]:
            gaps = [(plain_distance(plain_profile(s), e[3]), i) for i, e in enumerate(entries)]
            other = min(((d, i) for d, i in gaps if entries[i][1] != groups[k] and entries[i][2]), default=(9, 0))
            own = min((d for d, i in gaps if entries[i][1] == groups[k] and entries[i][2]), default=9)
            any_ = min(((d, i) for d, i in gaps if entries[i][1] != groups[k]), default=(9, 0))
            if other[0] < limits.distance:
                out.add((k, name, entries[other[1]][0], round(other[0], 9), own > limits.distance, False))
            elif any_[0] < limits.distance:
                out.add((k, name, entries[any_[1]][0], round(any_[0], 9), False, True))
    return out


def test_contamination_calls_equal_plain_version(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK", 5)
    found = amplicons.identified(amplicons.records(spark, DATA)).select("sample_idx", "id", "sequence").where("sample_idx < 4").cache()
    records = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.sample_idx, r.id)):
        records[r.sample_idx].append((r.id, r.sequence))
    names = {k: s.name for k, s in enumerate(amplicons.SAMPLES)}
    foreign = [("lab", amplicons.founders([2])[0])]
    for donors in (None, {1: "d", 2: "d"}):
        groups = {k: donors.get(k, f"s{k}") if donors else f"s{k}" for k in names}
        got = contamination.calls(found, names, foreign, donors)
        rows = {(r.sample_idx, r.id, r.nearest, round(r.distance, 9), r.discarded, r.suspect_only) for r in got.collect()}
        assert rows == plain_calls(records, names, foreign, groups) and got.count() == len(rows)
    assert {r[4] for r in rows} == {True, False}
    found.unpersist()


def test_ambiguous_letters_are_picked_by_id_and_place(spark):
    state, value = contamination.seed("S1_AC", 3), 0x811C9DC5 ^ 3
    for c in b"S1_AC":
        value = ((value ^ c) * 0x01000193) % 2**32
    assert state == value and contamination.picked("AC-GT", state) == "ACGT" and contamination.picked("ac!u", 7) == "AC!T"
    many = contamination.picked("N" * 400 + "R" * 400, 9)
    assert set(many[:400]) == set("ACGT") and set(many[400:]) == set("AG")
    rows = [(0, "a", "N" * 60), (0, "b", None), (0, "c", ""), (1, "d", "N" * 60), (1, "d", "N" * 60)]
    frame = spark.createDataFrame(rows, "sample_idx int, id string, sequence string").withColumn("label", F.lit("clash"))
    assert contamination.calls(frame, {0: "S0", 1: "S1"}).count() <= 4
    assert not contamination.calls(frame.where("false"), {0: "S0"}).count()


# The panel


def full_panel_columns(rows, query):
    """Affine alignment with the panel over all cells, in fractions."""
    never, n, m = Fraction(-(10**12)), len(rows[0]), len(query)
    share = [{c: Fraction(sum(r[k] == c for r in rows), len(rows)) for c in set("ACGTN-")} for k in range(n)]
    best = {(0, 0): [Fraction(0), never, never]}
    step = {}
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            cell, how = [never] * 3, [0, 1, 2]
            if not i:
                cell[2] = Fraction(-2) - Fraction(j, 5)
            elif not j:
                cell[1] = Fraction(-2) - Fraction(i, 5)
            else:
                came = best[i - 1, j - 1]
                how[0] = came.index(max(came))
                cell[0] = max(came) + 2 * share[i - 1].get(query[j - 1], 0) - 1
                up, left = best[i - 1, j], best[i, j - 1]
                how[1] = int(up[1] - Fraction(1, 5) > up[0] - 2)
                cell[1] = max(up[0] - 2, up[1] - Fraction(1, 5))
                how[2] = 2 * int(left[2] - Fraction(1, 5) > left[0] - 2)
                cell[2] = max(left[0] - 2, left[2] - Fraction(1, 5))
            best[i, j], step[i, j] = cell, how
    i, j, out = n, m, [-1] * m
    state = best[n, m].index(max(best[n, m]))
    while i or j:
        state = 2 if not i else 1 if not j else state
        then = step[i, j][state]
        if state == 0:
            out[j - 1] = i - 1
        i, j = i - (state != 2), j - (state != 1)
        state = then
    return out


def plain_score(rows, query, columns_of):
    now, best = 0.0, 1.0
    for letter, k in zip(query, columns_of):
        if k >= 0:
            now += -math.log(sum(r[k] == letter for r in rows) / len(rows) + 0.01) + math.log(0.25)
            best, now = max(best, now), max(now, 0.0)
    return best


def test_panel_alignment_equals_full_program(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(25):
        width = int(rng.integers(1, 36))
        base, rows = rng.choice(list("ACGT"), width), []
        for _ in range(rng.integers(1, 5)):
            row = base.copy()
            other = rng.random(width) < 0.15
            row[other] = rng.choice(list("ACGT-"), other.sum())
            rows.append("".join(row))
        queries = []
        for _ in range(4):
            a, b = sorted(rng.integers(0, width + 1, 2))
            text = "".join(base)
            queries.append(text[:a] + some(rng, rng.integers(0, 12)) + text[b if rng.random() < 0.5 else a :] or "A")
        own = panel.Panel.of(rows)
        for q, found in zip(queries, panel.mapped(own, queries)):
            want = full_panel_columns(rows, q)
            assert found.tolist() == want and panel.scored(own, q, found) == pytest.approx(plain_score(rows, q, want), abs=1e-9)
    base = some(rng, 300)
    query = base[:100] + some(rng, 90) + base[100:]
    wide = panel.mapped(panel.Panel.of([base]), [query])[0].tolist()
    monkeypatch.setattr(panel, "BAND", 4)
    assert panel.mapped(panel.Panel.of([base]), [query])[0].tolist() == wide


def test_sequence_is_added_to_a_profile_without_moving_its_rows():
    rows, own = panel.added(["AC-GTACGT", "ACTGTACGT"], "ACGTTTTACG")
    assert len({*map(len, rows), len(own)}) == 1 and own.replace("-", "") == "ACGTTTTACG"
    kept = [k for k in range(len(own)) if any(r[k] != "-" for r in rows)]
    assert ["".join(r[k] for k in kept) for r in rows] == ["AC-GTACGT", "ACTGTACGT"]


def test_panel_scores_of_the_test_table(spark):
    rows = [r for r in amplicons.QUERIES["panel_scores"][0](spark, DATA).collect()]
    by_text = {r.sequence: (r.panel_score, r.panel_pass, r.extracted) for r in rows}
    for text in sorted(by_text)[::25]:
        want = full_panel_columns(amplicons.PANEL, text)
        score, passed, extracted = by_text[text]
        assert score == pytest.approx(plain_score(amplicons.PANEL, text, want), abs=1e-9) and passed == (score < amplicons.PANEL_THRESHOLD)
        at = [k for k, c in enumerate(want) if c >= 0]
        assert extracted == text[at[0] : at[-1] + 1]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "--"), (4, "ac-gt")], "id long, sequence string")
    got = {r.id: (r.panel_score, r.panel_pass) for r in panel.panel_scores(odd, ["ACGT"]).collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (None, False), 4: (1.0, True)}


def test_filters_follow_calls_and_panel(spark):
    rows = amplicons.QUERIES["consensus_filters"][0](spark, DATA).collect()
    calls = {r.id for r in amplicons.QUERIES["contamination_calls"][0](spark, DATA).where("discarded").collect()}
    assert rows and {r.fam for r in rows if not r.contamination_pass} == calls
    for r in rows:
        assert r.panel_pass == (r.panel_score < amplicons.PANEL_THRESHOLD) and r.passed == (r.artefact_pass and r.agreement_pass and r.contamination_pass and r.panel_pass)
        assert ("distance_from_panel >= 4.0" in r.reasons) == (not r.panel_pass)
    assert {r.panel_pass for r in rows} == {True, False}


def test_dispositions_follow_model_and_qualities(spark):
    reads = amplicons.kept(spark, DATA).cache()
    rows = amplicons.QUERIES["family_dispositions"][0](spark, DATA).collect()
    made = defaultdict(list)
    for r in reads.collect():
        made[r.sample_idx, r.umi].append(r.quality)

    def is_both(qualities):
        if any(len(q) < 50 for q in qualities):
            return False
        mean = [sum(max(0, ord(q[k]) - 33) for q in qualities) / len(qualities) for k in range(50)]
        tag, after = mean[6:14], mean[18:39]
        a, b = sum(tag) / 8, sum(after) / 21
        pooled = math.sqrt((sum((x - a) ** 2 for x in tag) + sum((x - b) ** 2 for x in after)) / 27)
        if a >= b or min(tag) >= b / 2:
            return False
        t = (b - a) / (pooled * math.sqrt(1 / 8 + 1 / 21)) if pooled else math.inf
        size = math.gamma(14) / (math.sqrt(27 * math.pi) * math.gamma(13.5))
        x = np.linspace(0, min(t, 50), 20_001)
        inner = np.trapezoid(size * (1 + x * x / 27) ** -14, x)
        return 1 - 2 * inner < 1 / (5 * len(qualities) ** 2)

    assert len(rows) == len(made) and all(r.family_size == len(made[r.sample_idx, r.umi]) for r in rows)
    found = {(r.sample_idx, r.umi) for r in rows if r.disposition == "heteroduplex"}
    assert found and found == {k for k, q in made.items() if k[1] != "REJECTS" and is_both(q)}
    model = {(r.sample_idx, r.umi): r.disposition for r in umi_model.families(reads.groupBy("sample_idx", "umi").agg(F.count("*").alias("family_size")), amplicons.LDA, amplicons.FAMILY).collect()}
    assert all(r.disposition == model[r.sample_idx, r.umi] for r in rows if (r.sample_idx, r.umi) not in found)
    assert {(r.sample_idx, r.umi) for r in rows if r.agreement is not None} == {(r.sample_idx, r.umi) for r in rows if r.disposition == "likely_real"}
    for r in amplicons.QUERIES["stage_overview"][0](spark, DATA).collect():
        own = [x for x in rows if x.sample_idx == r.sample_idx]
        assert (r.families, r.reads, r.records) == (len(own), sum(x.family_size for x in own), sum(x.agreement is not None for x in own))
        assert r.heteroduplex_families == sum(x.disposition == "heteroduplex" for x in own) and r.lda_rejects_reads == sum(x.family_size for x in own if x.disposition == "LDA-rejects")
    reads.unpersist()
