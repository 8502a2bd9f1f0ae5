"""Multiple alignment, trees and parsimony: contracts, round trips, exhaustive search on small trees."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import msa, phylogeny as ph
from strandloom.plans import amplicons

DATA = "/root/testdata/sf0.001"


def checked(got, want):
    """got: (group, id, sequence, aligned); rectangular by group, rows kept, letters kept."""
    widths = defaultdict(set)
    for r in got:
        widths[r.g].add(len(r.aligned))
        assert r.aligned.replace("-", "") == (r.sequence or "").replace("-", "").upper(), r
    assert all(len(w) == 1 for w in widths.values())
    assert sorted((repr(r.g), r.id) for r in got) == sorted((repr(g), i) for g, i, _ in want)


def test_alignment_is_rectangular_and_keeps_rows_and_letters(spark):
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("ACGT"), 120))
    rows = []
    for k in range(9000):
        at, kind = int(rng.integers(120)), rng.integers(4)
        rows.append((1, k, base[:at] + ["", "A", "ACGTT", base[at : at + 1]][kind] + base[at + (kind != 1) :]))
    rows += [(2, 1, "AC-GT"), (2, 2, None), (2, 3, ""), (2, 4, "acgtt"), (None, 1, "AAA"), (None, 2, "AAA"), (3, 1, "")]
    frame = spark.createDataFrame(rows, "g int, id long, sequence string").withColumn("anchor", F.lit("clash")).repartition(4)
    got = msa.multiple_alignment(frame, "g").collect()
    checked(got, rows)
    own = [r.aligned for r in got if r.g == 1]
    columns = np.stack([np.frombuffer(x.encode(), np.uint8) for x in own[:2000]])
    agree = np.mean([np.bincount(c, minlength=128).max() / len(c) for c in columns.T])
    assert agree > 0.97 and len(own[0]) < 120 * 5
    assert not msa.multiple_alignment(frame.where("false"), "g").count()


def test_rounds_move_the_anchor_to_what_most_sequences_have(spark):
    base = "ACGTTGCAAGGCTTACCGATAGGCTTAACCGTAGGATC"
    rows = [(1, k, base[:10] + "TT" + base[10:20] + "ACGT"[k % 4] + base[21:]) for k in range(4)] + [(1, 9, base), (1, 10, base)]
    frame = spark.createDataFrame(rows, "g int, id long, sequence string")
    got = msa.multiple_alignment(frame, "g").collect()
    checked(got, rows)
    assert {len(r.aligned) for r in got} == {len(base) + 2}


def test_parts_and_rows_of_an_anchor():
    from strandloom.operators import alignment

    anchor, text = "ACGTACGT", "TTACGGTCGTA"
    between, at = msa.parts(anchor, text, alignment.steps([(anchor, text)])[0])
    assert len(between) == 9 and len(at) == 8 and "".join(b + a for b, a in itertools.zip_longest(between, at, fillvalue="")) == text
    assert msa.row(["T", "", "G"], ["A", ""], [3, 1, 2]) == "--TA--G-"


def test_joining_gives_back_additive_distances():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(3, 12))
        nodes = [ph.Node(f"t{k}", float(rng.uniform(0.1, 1))) for k in range(n)]
        names = [x.name for x in nodes]
        while len(nodes) > 3:
            a, b = (nodes.pop(int(rng.integers(len(nodes)))) for _ in range(2))
            nodes.append(ph.Node(length=float(rng.uniform(0.1, 1)), children=[a, b]))
        tree = ph.Node(children=nodes)
        d = path_lengths(tree, names)
        joined = ph.neighbour_joining(d, names)
        assert np.allclose(path_lengths(joined, names), d)
        for other in (ph.midpoint_rooted(joined), ph.rooted_on(joined, "t1"), ph.ladderized(joined), ph.parsed(ph.newick(joined))):
            assert np.allclose(path_lengths(other, names), d)
        middle = ph.midpoint_rooted(joined)
        depth = {p.name: p.depth for p in ph.layout(middle) if p.is_tip}
        assert max(depth.values()) == pytest.approx(d.max() / 2)
        assert sum(abs(x - d.max() / 2) < 1e-9 for x in depth.values()) >= 2


def path_lengths(root, names):
    above = {c: n for n in root.preorder() for c in n.children}
    ways = {}
    for tip in root.leaves():
        way, node, total = {}, tip, 0.0
        while node is not None:
            way[node] = total
            total += node.length
            node = above.get(node)
        ways[tip.name] = way
    return np.array([[min(ways[a][n] + ways[b][n] for n in ways[a] if n in ways[b]) if a != b else 0.0 for b in names] for a in names])


def test_small_and_flat_trees():
    assert ph.newick(ph.neighbour_joining(np.zeros((0, 0)), [])) == ";"
    assert ph.newick(ph.neighbour_joining(np.zeros((1, 1)), ["a"])) == "a;"
    assert ph.newick(ph.neighbour_joining(np.array([[0, 0.3], [0.3, 0]]), ["a", "b"]), 5) == "(a:0.15000,b:0.15000);"
    flat = ph.parsed("(a:0,b:0,(c:0,d:0):0);")
    assert ph.newick(ph.midpoint_rooted(flat)) == ph.newick(flat)
    assert ph.newick(ph.rooted_on(ph.parsed("(a:1,b:2);"), "a")) == "(a:0,(b:2):1);"
    with pytest.raises(ValueError):
        ph.rooted_on(flat, "x")


def test_newick_in_noisy_output():
    text = "\x1b[1mread (2 rows)\x1b[0m\n((a:1,'b c':2e-1)x:0.5,[note (1)]d:nan);\nTotal (seconds): 1;\n"
    tree = ph.parsed(text)
    assert [(n.name, n.length) for n in tree.preorder()] == [("", 0), ("x", 0.5), ("a", 1), ("b c", 0.2), ("d", 0)]
    assert ph.newick(tree) == "((a:1,b_c:0.2)x:0.5,d:0);"
    for bad in ("no tree", "((a,b)", "(a,b)"):
        with pytest.raises(ValueError):
            ph.parsed(bad)
    deep = "(" * 5000 + "a" + ",b)" * 5000 + ";"
    assert sum(1 for _ in ph.parsed(deep).preorder()) == 10001 and ph.newick(ph.parsed(deep)).count("b") == 5000


def test_order_of_children_and_short_branches():
    tree = ph.parsed("(e:1,(d:1,c:1):1,((b:1,a:1):0.000000001,f:1):1);")
    assert ph.newick(ph.ladderized(tree)) == "(((a:1,b:1):1e-09,f:1):1,(c:1,d:1):1,e:1);"
    assert ph.newick(ph.ladderized(tree, False)) == "(e:1,(c:1,d:1):1,(f:1,(a:1,b:1):1e-09):1);"
    assert ph.newick(ph.collapsed(tree)[0]) == "((a:1,b:1,f:1):1,(c:1,d:1):1,e:1);" and ph.collapsed(tree)[1] == 1
    assert ph.clade(tree.children[1]) == "c\0d"
    rows = ph.layout(tree, cladogram=True)
    assert {p.depth for p in rows if p.is_tip} == {3.0} and sorted(p.row for p in rows if p.is_tip) == list(range(6))


def test_jukes_cantor_leaves_gaps_out():
    d = ph.jukes_cantor(["ACGTACGT", "ACGAAC-T", "--------", "TGCATGCA"])
    assert d[0, 1] == pytest.approx(-0.75 * np.log(1 - 4 / 3 / 7)) and d[0, 2] == 0 and d[0, 3] == np.inf and (d == d.T).all()


def test_parsimony_equals_exhaustive_search():
    rng = np.random.default_rng(3)
    for _ in range(25):
        n = int(rng.integers(2, 6))
        nodes = [ph.Node(f"t{k}") for k in range(n)]
        while len(nodes) > 1:
            take = min(len(nodes), int(rng.integers(2, 4)))
            nodes.append(ph.Node(children=[nodes.pop(int(rng.integers(len(nodes)))) for _ in range(take)]))
        tree = nodes[0]
        aligned = {f"t{k}": "".join(rng.choice(list("ACGT-NR"), 6)) for k in range(n)}
        found = ph.parsimony(tree, aligned)
        inner, total = [x for x in tree.preorder() if x.children], 0
        for column in range(6):
            best = 10**9
            for states in itertools.product(ph.STATES, repeat=len(inner)):
                at, cost = dict(zip(inner, states)), 0
                for node in inner:
                    for c in node.children:
                        allowed = [at[c]] if c.children else [s for k, s in enumerate(ph.STATES) if ph.MASKS[aligned[c.name][column]] >> k & 1]
                        cost += at[node] not in allowed
                best = min(best, cost)
            total += best
        assert found.score == total == len(found.mutations)
        for node in tree.preorder():
            for c in node.children:
                a, b, own = found.sequences[ph.clade(node)], found.sequences[ph.clade(c)], ph.clade(c)
                if own != ph.clade(node):
                    assert [(m.column, m.old, m.new) for m in found.mutations if m.clade == own] == [(k, x, y) for k, (x, y) in enumerate(zip(a, b)) if x != y]


def test_amino_acid_changes():
    found = ph.amino_mutations("ATG---GCNTAA", "ATA---GCCTGG", "x")
    assert [(m.column, m.old, m.new) for m in found] == [(0, "M", "I"), (4 - 1, "*", "W")][:2]


def test_sample_trees_of_the_test_table(spark):
    rows = amplicons.QUERIES["sample_alignments"][0](spark, DATA).collect()
    by = defaultdict(dict)
    for r in rows:
        assert r.aligned.replace("-", "") == r.haplotype and r.families >= 2
        by[r.sample_idx][r["name"]] = r.aligned
    assert all(len({*map(len, x.values())}) == 1 for x in by.values())
    got = amplicons.QUERIES["sample_trees"][0](spark, DATA).collect()
    assert {int(r.group) for r in got} == set(by)
    for r in got:
        tree, names = ph.parsed(r.newick) if r.tips > 1 else ph.Node(next(iter(by[int(r.group)]))), sorted(by[int(r.group)])
        assert sorted(t.name for t in tree.leaves()) == names and r.tips == len(names)
        assert r.score == len(r.mutations) == ph.parsimony(tree, by[int(r.group)]).score
        d = ph.jukes_cantor([by[int(r.group)][n] for n in names])
        d[~np.isfinite(d)] = d[np.isfinite(d)].max(initial=0) + 1
        assert np.allclose(path_lengths(tree, names), path_lengths(ph.neighbour_joining(d, names), names), atol=1e-9)


def test_trees_of_odd_rows(spark):
    rows = [("a", "x", "ACGT"), ("a", None, "ACGT"), ("a", "y", None), ("b", "p", "AC"), ("b", "q", "AG"), (None, "z", "A")]
    frame = spark.createDataFrame(rows, "g string, name string, aligned string").withColumn("score", F.lit("clash"))
    got = {r.group: (r.tips, r.newick, r.score) for r in ph.trees(frame, "g").collect()}
    assert got["a"] == (1, "x;", 0) and got["b"][::2] == (2, 1) and got[None] == (1, "z;", 0)
    assert not ph.trees(frame.where("false"), "g").count()
