"""Spelling variants, fill-in-the-middle and nearest vectors against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import fill_middle, nearest_vectors, spelling_variants

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n long, form string, ids array<long>, digest binary"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "clash", 1, "clash", [1], b"x") for k, t in rows], SCHEMA).repartition(3)


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    less = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[i, w[:i] + w[i + 1 :]].add(w)
    out = {}
    for w, k in words.items():
        near = set().union(*(less[i, w[:i] + w[i + 1 :]] for i in range(len(w)))) | {w[:i] + w[i + 1 :] for i in range(len(w))} & set(words)
        near |= {x for i in range(len(w) + 1) for x in less.get((i, w), ())}
        near.discard(w)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 10 * k else None, k, len(near))
    return words, out


def assert_variants(got, rows):
    words, want = brute_variants(rows)
    assert {r.word for r in got} == set(want) and len(got) == len(want)
    for r in got:
        form, n, near = want[r.word]
        root = r.word
        while want[root][0]:
            root = want[root][0]
        assert (r.form, r.n, r.n_near, r.root, r.form_n) == (form, n, near, root, words[form] if form else None), r


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcd"), rng.integers(7, 10))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words, 200))) for i in range(30)]
    chain = [(100, "straightly " * 300 + "straightl " * 25 + "traightl " * 2), (101, "STRAIGHTLY Ünüberwachte ünüberwachte 'rückwärts' " * 3)]
    long = "q" * 40
    odd = [(102, None), (103, ""), (None, "straightly straightlx"), (104, f"{long} {long} {long}x {long}x " + "z" * 5000), (0, rows[0][1]), (105, "short abcd×defg÷h " * 3)]
    return rows + chain + odd


def test_spelling_variants(spark, texts):
    got = spelling_variants.grouped(docs_of(spark, texts)).collect()
    assert_variants(got, texts)
    few = spelling_variants.grouped(docs_of(spark, texts), shard_words=7, block_words=11).collect()
    assert sorted(map(repr, few)) == sorted(map(repr, got))
    roots = {r.word: (r.form, r.root) for r in got}
    assert roots["straightl"] == ("straightly", "straightly") and roots["traightl"] == ("straightl", "straightly")


def test_spelling_variants_on_the_test_table_and_on_none(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert_variants(spelling_variants.grouped(docs).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert not spelling_variants.grouped(docs.where("false")).count()


def test_halves_decide_what_is_near(monkeypatch):
    """Pairs come from the automaton's hits, also where a half is common to thousands of words; without hits there are none."""
    rng = np.random.default_rng(2)
    words = sorted({"aaaa" + "".join(rng.choice(list("abc"), rng.integers(3, 6))) for _ in range(400)} | {"x" * n for n in (31, 32, 33, 34)} | {"x" * 33 + "y"})
    lexicon = spelling_variants.Lexicon("\n".join(words))
    automaton = spelling_variants.HalvesAutomaton(lexicon)
    monkeypatch.setattr(spelling_variants, "PAIRS", 100)
    v, u = automaton.near(lexicon)
    found = {(words[a], words[b]) for a, b in zip(v.tolist(), u.tolist())}

    def distance_one(a, b):
        cut = lambda w: {(i, w[:i] + w[i + 1 :]) for i in range(len(w))}
        return a != b and (bool(cut(a) & cut(b)) if len(a) == len(b) else any(x == min(a, b, key=len) for _, x in cut(max(a, b, key=len))))

    assert found == {(a, b) for a in words for b in words if distance_one(a, b)}
    none = lambda words: (np.zeros(0, np.int64), np.zeros(0, np.int64))
    monkeypatch.setattr(automaton, "hits", none)
    assert not len(automaton.near(lexicon)[0])


def test_elias_fano_lists():
    rng = np.random.default_rng(3)
    for values in ([1], [5, 6, 7], [1 << 30], np.cumsum(rng.integers(1, 100, 500)), np.cumsum(rng.integers(1, 3, 500)), [3, 1 << 20, (1 << 20) + 1]):
        values = np.array(values, np.int64)
        lines = fill_middle.EliasFano.of(values)
        assert lines.select(np.arange(len(values))).tolist() == values.tolist()
        assert 8 * (len(lines.low) + len(lines.high)) <= len(values) * (2 + max(1, np.log2(values[-1] / len(values)) + 1)) + 16


def brute_cut(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or doc_id is None or any(m in text for m in ("<P>", "<S>", "<M>")):
        form, parts, output = "plain", (None, None), text
    else:
        digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
        h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        form, parts = "spm" if h[3] % 100 < 50 else "psm", (len(pre), len(mid))
        output = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(lines), form, *parts, sha(output), sha(text)), output


def test_fill_middle(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "\n" * (i % 3) + "\n".join("wörd\U0001f600 "[: int(k)] for k in rng.integers(0, 7, 20)) + "\n" * (i % 2)) for i in range(60)]
    rows += [(100 + i, "one text\nof many\n\ndocuments") for i in range(300)]
    rows += [(1, None), (2, ""), (None, "no id\nat all"), (3, "has <M> in it\nx"), (4, "<\nS><P\n>"), (5, "ends in <S"), (6, "\n"), (7, "a\r\nb\x0bc d\n" * 9), (8, "line\n" * 50_000), rows[0]]
    want = sorted((repr(brute_cut(*r)) for r in rows))
    got = fill_middle.transformed(docs_of(spark, rows), with_text=True).collect()
    assert sorted(repr(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256), r.output)) for r in got) == want
    assert all(fill_middle.restored(r.output, r.form) == text for r in got for i, text in rows if r.doc_id == i and i is not None and i >= 100)
    assert len({r.form for r in got if r.doc_id and r.doc_id >= 100}) == 2
    assert {r.form for r in fill_middle.transformed(docs_of(spark, rows), rate=0).collect()} == {"plain"}
    index = {bytes(r.digest): r for r in fill_middle.boundary_index(docs_of(spark, rows)).collect()}
    assert len(index) == len({t or "" for _, t in rows})
    one = index[hashlib.sha256(b"one text\nof many\n\ndocuments").digest()]
    assert fill_middle.EliasFano(one.n, one.width, bytes(one.low), bytes(one.high)).select(np.arange(4)).tolist() == [9, 17, 18, 27]
    assert not fill_middle.transformed(docs_of(spark, rows).where("false")).count()


def test_fill_middle_deals_a_large_group_over_tasks(spark):
    rows = [(i, "the same text\nin most rows") for i in range(4000)] + [(10_000 + i, f"text {i}\n") for i in range(400)]
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        dealt = fill_middle.distinct_texts(docs_of(spark, rows)).where("text LIKE 'the same%'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 150


def exact(ids, x, k=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = reduce(lambda a, b: a + b, (float(a) * np.array(b, float) for a, b in zip(x[i], zip(*x))))
            best = {}
            for j in range(len(ids)):
                if ids[j] != ids[i]:
                    best[ids[j]] = max(best.get(ids[j], -np.inf), s[j])
            out[ids[i]] = [(j, best[j]) for j in sorted(best, key=lambda j: (-best[j], j))[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


QUERIES = "vec_id % 20 = 0"


def test_nearest_vectors_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    want = exact([r.vec_id for r in rows], [r.embedding for r in rows])
    got = found(nearest_vectors.searched(vectors.withColumn("score", F.lit("clash")).withColumn("vector", F.lit(1)), QUERIES))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    scores = {(q, j): s for q, x in want.items() for j, s in x}
    assert all(scores.get((q, j), s) == s for q, x in got.items() for j, s in x)


def test_nearest_vectors_of_clusters_norms_ties_and_broken_rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 10)) * 3
    x = [((centres[i % 12] + rng.normal(size=10)) * (1 + i % 5)).tolist() for i in range(400)]
    x[40:140] = [x[40]] * 100
    rows = [(i, v) for i, v in enumerate(x)] + [(7, x[7]), (20, x[20])]
    broken = [(500, None), (520, [0.0] * 10), (540, [1.0] * 9 + [None]), (560, [1.0] * 9 + [float("nan")]), (580, [float("inf")] * 10), (600, [1.0] * 7), (None, x[1])]
    made = spark.createDataFrame(rows + broken, "vec_id long, embedding array<double>").repartition(3)
    got, want = found(nearest_vectors.searched(made, QUERIES, probes=32, row_block=50)), exact([i for i, _ in rows], [v for _, v in rows])
    assert got == want
    few = spark.createDataFrame(rows[:9] + broken, made.schema)
    assert found(nearest_vectors.searched(few, QUERIES)) == {0: exact(list(range(9)), x[:9])[0]}
    assert not nearest_vectors.searched(made.where("false"), QUERIES).count()
    assert not nearest_vectors.searched(made.where("vec_id = 20").limit(1), QUERIES).count()


def test_equal_vectors_give_way_to_smaller_ids():
    x = np.array([[1.0, 2.0]] * 50 + [[3.0, 4.0]] * 3)
    ids = np.arange(53)[::-1].copy()
    left = nearest_vectors._trimmed(ids, x, 5)
    assert sorted(ids[left].tolist()) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_near_words_are_verified_in_little_memory():
    words = ["aaa" + "".join(p) + "bbb" for p in itertools.product("abcdefgh", repeat=4)]
    lexicon = spelling_variants.Lexicon("\n".join(words))
    automaton = spelling_variants.HalvesAutomaton(lexicon)
    tracemalloc.start()
    v, _ = automaton.near(lexicon)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(v) == len(words) * 4 * 7 and peak < 60e6
