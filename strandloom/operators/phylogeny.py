"""Trees of aligned sequences: distances, neighbour joining, Newick texts, roots, order of children, and parsimony.

A tree is at rest a Newick text. Each task takes whole groups, one tree for each, as arrays of parents and lengths.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotides import AMINO_ACIDS, CODON_BASES

#: States of parsimony, the states that a letter stands for, internal branches that count as none, and decimals.
STATES = "ACGT-"
MASKS = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15, "X": 15, "?": 15, "-": 16, ".": 16}
NO_BRANCH, DECIMALS, NEVER = 1e-8, 5, 1_000_000


@dataclass(eq=False)
class Node:
    name: str = ""
    length: float = 0.0
    children: list[Node] = field(default_factory=list)

    def preorder(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += node.children[::-1]

    def leaves(self) -> list[Node]:
        return [n for n in self.preorder() if not n.children]


# Distances and joining


def jukes_cantor(rows: list[str]) -> np.ndarray:
    """Distances of aligned rows: shares of mismatches where neither has a gap, corrected; infinite from three quarters on."""
    letters = np.stack([np.frombuffer(r.upper().encode("latin-1", "replace"), np.uint8) for r in rows]) if rows else np.zeros((0, 0), np.uint8)
    n, out = len(rows), np.zeros((len(rows), len(rows)))
    solid = letters != ord("-")
    for k in range(n):
        both = solid[k] & solid
        sizes = both.sum(axis=1)
        share = np.divide((both & (letters != letters[k])).sum(axis=1), sizes, out=np.zeros(n), where=sizes > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[k] = np.where(share < 0.75, -0.75 * np.log(np.maximum(0, 1 - share * 4 / 3)), np.inf)
    return np.abs(out)


def neighbour_joining(distances: np.ndarray, names: list[str]) -> Node:
    """The tree of a distance matrix; of equal pairs the first is joined, and the last two share their distance."""
    d = np.array(distances, float)
    nodes = [Node(name) for name in names]
    if not nodes:
        return Node()
    while len(nodes) > 2:
        n = len(nodes)
        sums = d.sum(axis=1)
        q = (n - 2) * d - sums[:, None] - sums
        q[np.tril_indices(n)] = np.inf
        i, j = divmod(int(q.argmin()), n)
        nodes[i].length = 0.5 * d[i, j] + (sums[i] - sums[j]) / (2 * (n - 2))
        nodes[j].length = d[i, j] - nodes[i].length
        rest = [k for k in range(n) if k not in (i, j)]
        to_new = 0.5 * (d[i, rest] + d[j, rest] - d[i, j])
        d = np.block([[d[np.ix_(rest, rest)], to_new[:, None]], [to_new[None], np.zeros((1, 1))]])
        nodes = [nodes[k] for k in rest] + [Node(children=[nodes[i], nodes[j]])]
    if len(nodes) == 2:
        nodes[0].length = nodes[1].length = float(d[0, 1]) / 2
        return Node(children=nodes)
    return nodes[0]


# Newick


def found_newick(text: str) -> str:
    """The longest complete tree in a program's output, with its semicolon; quotes and comments in brackets are skipped over."""
    text, best = re.sub(r"\x1b\[[0-9;]*m", "", text), ""
    token = re.compile(r"'(?:\\'|[^'])*'|\"(?:\\\"|[^\"])*\"|\[[^\]]*\]|[()]")
    for start in (m.start() for m in re.finditer(r"\(", text)):
        depth = 0
        for m in token.finditer(text, start):
            depth += {"(": 1, ")": -1}.get(m.group(), 0)
            if m.group() == ")" and not depth:
                tail = re.compile(r"[^;\n\r]*;").match(text, m.end())
                whole = text[start : tail.end()].strip() if tail else ""
                if len(whole) > len(best) and re.search("[,:]", whole):
                    best = whole
                break
    if not best:
        raise ValueError("no complete tree in the text")
    return best.rstrip(";") + ";"


_TOKEN = re.compile(r"\s*(?:'([^']*)'?|\"([^\"]*)\"?|([(),:;])|([^\s(),:;]+))")


def parsed(text: str) -> Node:
    """The tree of a Newick text, which may stand in other output; missing and bad lengths are 0."""
    source = re.sub(r"\[[^\]]*\]", "", found_newick(text))
    root = node = Node()
    path: list[Node] = []
    expects_length = False
    for m in _TOKEN.finditer(source):
        mark, word = m.group(3), next((g for g in (m.group(1), m.group(2), m.group(4)) if g is not None), None)
        if mark == "(":
            path.append(node)
            node = Node()
            path[-1].children.append(node)
        elif mark == ",":
            if not path:
                raise ValueError("more than one tree in the text")
            node = Node()
            path[-1].children.append(node)
        elif mark == ")":
            if not path:
                raise ValueError("a bracket too many")
            node = path.pop()
        elif mark == ";":
            break
        elif mark is None and expects_length:
            try:
                node.length = float(word) if math.isfinite(float(word)) else 0.0
            except ValueError:
                node.length = 0.0
        elif mark is None:
            node.name = word
        expects_length = mark == ":"
    if path:
        raise ValueError("a bracket too few")
    return root


def newick(root: Node, decimals: int | None = None) -> str:
    """The text of a tree: a length for each branch, and marks in names replaced by underscores."""
    length = lambda x: "0" if not x or not math.isfinite(x) else f"{x:.{decimals}f}" if decimals is not None else f"{x:.15g}"
    done: dict[Node, str] = {}
    for node in reversed(list(root.preorder())):
        inner = f"({','.join(done.pop(c) for c in node.children)})" if node.children else ""
        done[node] = inner + re.sub(r"[\s():;,]", "_", node.name) + ("" if node is root else f":{length(node.length)}")
    return done[root] + ";"


# Roots and order


def _neighbours(root: Node) -> dict[Node, list[tuple[Node, float]]]:
    out: dict[Node, list[tuple[Node, float]]] = {n: [] for n in root.preorder()}
    for node in out:
        for child in node.children:
            out[node].append((child, child.length))
            out[child].append((node, child.length))
    return out


def _hung(around: dict[Node, list[tuple[Node, float]]], start: Node, parent: Node | None, length: float) -> Node:
    """The part of a tree that hangs from a node, seen from one of its neighbours."""
    top = Node(start.name, length)
    todo = [(start, parent, top)]
    while todo:
        old, came, new = todo.pop()
        for other, size in around[old]:
            if other is not came:
                new.children.append(Node(other.name, size))
                todo.append((other, old, new.children[-1]))
    return top


def rooted_on(root: Node, outgroup: str) -> Node:
    """The tree rooted at a tip, whose own branch becomes 0; the rest keeps the whole branch."""
    tips = [t for t in root.leaves() if t.name == outgroup]
    if not tips:
        raise ValueError(f"the tree has no tip {outgroup}")
    around = _neighbours(root)
    if not around[tips[0]]:
        return Node(outgroup)
    other, length = around[tips[0]][0]
    return Node(children=[Node(outgroup), _hung(around, other, tips[0], length)])


def midpoint_rooted(root: Node) -> Node:
    """The tree rooted in the middle of its longest path between tips (ties: the first names); only one branch is split.

    Negative lengths count as 0 for the path and stay in the tree.
    """
    around, tips = _neighbours(root), sorted(root.leaves(), key=lambda t: t.name)
    if len(tips) < 2:
        return Node(tips[0].name)

    def farthest(start: Node) -> tuple[Node, float, dict[Node, tuple[Node, float]]]:
        distance, came, todo = {start: 0.0}, {}, [start]
        while todo:
            node = todo.pop()
            for other, length in around[node]:
                if other not in distance:
                    distance[other], came[other] = distance[node] + max(0.0, length), (node, max(0.0, length))
                    todo.append(other)
        end = max(tips, key=lambda t: distance[t])  # the first of equal ones
        return end, distance[end], came

    first = farthest(tips[0])[0]
    last, total, came = farthest(first)
    if total <= 0:
        return Node(root.name, 0.0, root.children)
    node, left, close = last, total / 2, max(1.0, total) * 1e-12
    while node is not first:
        towards, length = came[node]
        if left < length - close and left > close:
            return Node(children=[_hung(around, towards, node, length - left), _hung(around, node, towards, left)])
        if left <= close:
            break
        node, left = towards, left - length
    return _hung(around, node, None, 0.0)


def clade(node: Node) -> str:
    """The names of a node's tips, sorted: the same for any order of children."""
    return "\0".join(sorted(t.name for t in node.leaves()))


def _ordered(root: Node, rank) -> Node:
    sizes: dict[Node, tuple[int, str]] = {}
    made: dict[Node, Node] = {}
    for node in reversed(list(root.preorder())):
        children = sorted(node.children, key=lambda c: rank(*sizes[c]))
        made[node] = Node(node.name, node.length, [made[c] for c in children])
        sizes[node] = (sum(sizes[c][0] for c in children), "\0".join(sorted(sizes[c][1] for c in children))) if children else (1, node.name)
    return made[root]


def ladderized(root: Node, large_first: bool = True) -> Node:
    """Children by their number of tips, then by their names."""
    return _ordered(root, lambda n, key: (-n if large_first else n, key))


def canonical(root: Node) -> Node:
    """Children by their names."""
    return _ordered(root, lambda n, key: key)


def collapsed(root: Node, threshold: float = NO_BRANCH) -> tuple[Node, int]:
    """The tree without internal branches up to a length, in canonical order, and how many these were."""
    n, made = 0, {}
    for node in reversed(list(root.preorder())):
        children = []
        for child in (made[c] for c in node.children):
            short = bool(child.children) and child.length <= threshold
            n += short
            children += child.children if short else [child]
        made[node] = Node(node.name, node.length, children)
    return canonical(made[root]), n


class Place(NamedTuple):
    name: str
    parent: int
    depth: float
    row: float
    is_tip: bool


def layout(root: Node, cladogram: bool = False) -> list[Place]:
    """Nodes in preorder with their distance from the root (in branches for a cladogram, tips last) and their row; tips fill the rows."""
    nodes = list(root.preorder())
    at = {n: k for k, n in enumerate(nodes)}
    parent = {c: n for n in nodes for c in n.children}
    depth: dict[Node, float] = {}
    for n in nodes:
        depth[n] = depth[parent[n]] + (1.0 if cladogram else max(0.0, n.length)) if n in parent else 0.0
    deepest = max(depth.values())
    rows: dict[Node, float] = {tip: float(k) for k, tip in enumerate(root.leaves())}
    for n in reversed(nodes):
        if n.children:
            rows[n] = (rows[n.children[0]] + rows[n.children[-1]]) / 2
        elif cladogram:
            depth[n] = deepest
    return [Place(n.name, at[parent[n]] if n in parent else -1, depth[n], rows[n], not n.children) for n in nodes]


# Parsimony


class Mutation(NamedTuple):
    column: int
    old: str
    new: str
    clade: str


class Parsimony(NamedTuple):
    score: int
    sequences: dict[str, str]
    mutations: list[Mutation]


def parsimony(root: Node, aligned: dict[str, str]) -> Parsimony:
    """Fewest changes on a tree, gaps being a state, for all columns at once: the sequence of each clade and what changes on
    its branch. Of equal states a node takes its parent's, or else the first; tips without a sequence are N throughout."""
    widths = {len(s) for s in aligned.values()}
    if len(widths) != 1:
        raise ValueError("parsimony needs sequences of one length")
    width, nodes = widths.pop(), list(root.preorder())
    states = np.arange(len(STATES))
    cost: dict[Node, np.ndarray] = {}
    for node in reversed(nodes):
        if node.children:
            # from a parent's state to the cheapest state of each child
            cost[node] = sum(np.minimum(cost[c], cost[c].min(axis=1, keepdims=True) + 1) for c in node.children)
        else:
            seen = np.array([MASKS.get(c.upper(), 15) for c in aligned.get(node.name, "N" * width)], int)
            cost[node] = np.where(seen[:, None] >> states & 1, 0, NEVER)
    state = {root: cost[root].argmin(axis=1)}
    score = int(cost[root].min(axis=1).sum())
    mutations: list[Mutation] = []
    letters = np.frombuffer(STATES.encode(), "S1")
    sequences: dict[str, str] = {}
    for node in nodes:
        sequences[clade(node)] = b"".join(letters[state[node]].tolist()).decode()
        for child in node.children:
            above = state[node]
            total = cost[child] + (states != above[:, None])
            best, stays = total.min(axis=1), total[np.arange(width), above]
            state[child] = np.where(stays == best, above, total.argmin(axis=1))
            for k in np.flatnonzero(state[child] != above).tolist():
                mutations.append(Mutation(k, STATES[above[k]], STATES[state[child][k]], clade(child)))
    return Parsimony(score, sequences, mutations)


def _amino(text: str) -> list[str]:
    out = []
    for k in range(0, len(text), 3):
        codon = text[k : k + 3].upper()
        if codon == "---":
            out.append("-")
        else:
            at = [CODON_BASES.find(c) for c in codon]
            out.append(AMINO_ACIDS[at[0] * 16 + at[1] * 4 + at[2]] if len(at) == 3 and min(at) >= 0 else "X")
    return out


def amino_mutations(parent: str, child: str, clade_of: str, frame: int = 0) -> list[Mutation]:
    """What changes between two aligned sequences' amino acids, leaving out unknown ones."""
    pairs = enumerate(zip(_amino(parent[frame:]), _amino(child[frame:])))
    return [Mutation(k, a, b, clade_of) for k, (a, b) in pairs if a != b and "X" not in (a, b)]


# Grouped kernels


def _trees(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("name", kind="stable")
    names, aligned = rows["name"].tolist(), rows["aligned"].tolist()
    distances = jukes_cantor(aligned)
    finite = distances[np.isfinite(distances)]
    distances[~np.isfinite(distances)] = finite.max(initial=0) + 1  # beyond the correction's range: farther than all others
    joined = neighbour_joining(distances, names)
    tree = ladderized(midpoint_rooted(joined))
    best = parsimony(tree, dict(zip(names, aligned)))
    return pd.DataFrame({
        "group": [rows["group"].iloc[0]], "tips": [len(names)], "joined": [newick(joined, DECIMALS)], "newick": [newick(tree)], "score": [best.score],
        "mutations": [[{"column": m.column, "old": m.old, "new": m.new, "tips": m.clade.split("\0")} for m in best.mutations]],
    })


_TREE = "group string, tips int, joined string, newick string, score long, mutations array<struct<column int, old string, new string, tips array<string>>>"


def trees(rows: DataFrame, group: str, name: str = "name", aligned: str = "aligned") -> DataFrame:
    """group, tips, joined, newick, score, mutations: the neighbour-joining tree of each group of aligned rows, as joined and
    rooted in the middle and ladderized, with its most parsimonious changes.

    A tree is made in one task from all pairs of its tips, so rows should be a group's different sequences, with names of
    their own. Rows with a null name or sequence take no part.
    """
    own = rows.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{name}`").alias("name"), F.col(f"`{aligned}`").alias("aligned"))
    return own.where("name IS NOT NULL AND aligned IS NOT NULL").groupBy("group").applyInPandas(_trees, _TREE)
