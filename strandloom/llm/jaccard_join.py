"""N-gram Jaccard join: an exact metric-space join of shingle sets, with links as connected components.

Jaccard distance is a metric, and linked sets lie within the radius r = 1 - percent/100. The join runs in rounds over
tables; documents with equal sets form a class, for which its first document stands.

1. Pivots. Shingles have one global order: those that one document has, those of which that is not known, those of several
   by how many these are (LEVELS). It is known for a share of the shingles (`Law.counted`), counted over all documents; the
   order steers the cost, never the result. Sets within a distance share one of their first shingles in it (`Law.prefix`).
   Documents that share such a shingle for the distance r are neighbours; a document without neighbours links with nothing.
   All shingles of those with neighbours are counted anew among these alone, which gives the order of the rounds. Documents
   that come first among all their neighbours are the round's pivots, so no shingle leads to two of them.
2. Voronoi regions. Every document learns its exact distance to every pivot within 2r. The nearest pivot within r is its
   home; that is a link, so a region hangs together as it is.
3. Windows. If x has the home p, all that links with x lies within d(x,p) + r of p by the triangle inequality. Documents at
   the boundary, beyond r but within the region's radius + r, are replicated into the region and compared there with the
   members in the ring that the inequality leaves, d(y,p) - r and more. Regions are dealt out in blocks of bounded size.
4. Recursion. Links of documents with a home are all found. Those without one are joined among themselves in the next
   round, with pivots of their own. What ROUNDS rounds leave (documents alike, but too far apart to be in a ball) is
   compared with its neighbours: those that share a shingle with few others pair by pair, those that share one with many
   (SMALL_GROUP) in connected groups, dealt out in blocks, by sizes and by a bound from part digests.
5. Links, or a spanning forest of them, give components.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; repeated rows
and equal texts belong to one class; rows that share a doc_id count as one document, so what either links with is one
component; a row with a null doc_id has a null component; the result has one row per row. A percentage of 50 or less is
refused, as balls of 2r would then hold sets without a common shingle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import Tables, small_side
from .words import mixed, shingle_sets, slices, words_of

ROUNDS = 3
#: Bits of the maps of shingles that occur again, and how many of these they may hold; more are joined to their documents.
COUNT_BITS = 26
MAPPED = 1 << 25
#: Documents with a shingle from which on it comes later in the order, by levels.
LEVELS = (2, 4, 16, 64)
#: Bits of the map of shingles in question; shingles beyond its discrimination are sorted out by the join that follows.
MARK_BITS = 24
#: Rows of a pivot or a region in one block.
BLOCK_ROWS = 2_000
#: Documents left over that share a shingle are compared pair by pair up to this number, more in blocks.
SMALL_GROUP = 32
#: Bytes of sets in a block of a group that was left over; a task holds two blocks.
BLOCK_BYTES = 12 << 20
_EPSILON = 1e-9


@dataclass(frozen=True)
class Law:
    """Shingles of k words link where 100 * intersection >= percent * union."""

    k: int = 5
    percent: int = 80

    def __post_init__(self) -> None:
        if not 50 < self.percent <= 100:
            raise ValueError("percent must be above 50 and at most 100")

    def linked(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def least(self, times: int) -> int:
        """Percent of similarity that is left at so many radii."""
        return 100 - times * (100 - self.percent)

    def prefix(self, n: int, times: int) -> int:
        """How many first shingles of a set with n: it shares one of them with the first ones of any set within the distance."""
        return n + (-self.least(times) * n // 100) + 1

    @property
    def counted(self) -> float:
        """Share of the shingles that is counted: enough for the first ones of a set of which a third occurs nowhere else."""
        return min(1.0, 3 * (100 - self.percent) / 100)

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100


def counted(share: float, found: np.ndarray) -> np.ndarray:
    """Which shingles are among those that are counted."""
    return mixed(found ^ np.uint64(0x51A3)) <= np.uint64(int(share * float(2**64 - 2**12)))


def _in_map(bits: np.ndarray, found: np.ndarray, prefix_bits: int) -> np.ndarray:
    """Whether a packed bitmap by first bits holds each shingle."""
    at = found >> np.uint64(64 - prefix_bits)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


def ordered(law: Law, found: np.ndarray, *levels: np.ndarray, share: float | None = None) -> np.ndarray:
    """A sorted set in the global order, given which of its shingles are known to occur in several and in more documents."""
    level = np.where(counted(law.counted if share is None else share, found), 0, 1)
    for k, some in enumerate(levels):
        level[some] = 2 + k
    key = (level.astype(np.uint64) << np.uint64(61)) | (mixed(found ^ np.uint64(0xA5A5A5A5)) >> np.uint64(3))
    return found[np.argsort(key, kind="stable")]


def _sets(batch: pa.RecordBatch, law: Law) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of each text of a batch."""
    texts = batch.column("text")
    for a, b in slices(texts):
        yield from enumerate(shingle_sets(words_of(texts.slice(a, b - a), lower=True), law.k), a)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _alias(doc_id: int, digest: bytes) -> int:
    """The node of one of several texts with the same doc_id."""
    return int.from_bytes(hashlib.blake2b(digest + str(doc_id).encode(), digest_size=8).digest(), "little", signed=True)


def _digests(law: Law) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, aliases = [], [], []
            for doc_id, (_, found) in zip(batch.column("doc_id").to_pylist(), _sets(batch, law)):
                sizes.append(len(found))
                keys.append(_digest(found) if len(found) else None)
                aliases.append(_alias(doc_id, keys[-1]) if len(found) and doc_id is not None else None)
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(aliases, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "digest", "alias"])

    return run


def _counted_rows(law: Law, share: float) -> Callable:
    """(token, node) of the shingles that are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, odd = batch.column("doc_id").to_pylist(), batch.column("odd").to_pylist()
            tokens, nodes, total = [], [], 0
            for row, found in _sets(batch, law):
                some = found[counted(share, found)]
                if len(some):
                    tokens.append(some.view(np.int64))
                    nodes.append(np.full(len(some), _alias(ids[row], _digest(found)) if odd[row] else ids[row], np.int64))
                    total += len(some)
                if total > 1 << 17 or (tokens and row == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))], ["token", "node"])
                    tokens, nodes, total = [], [], 0
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))], ["token", "node"])

    return run


def _word_bits(prefix_bits: int) -> tuple[Column, Column]:
    """Number of the 64-bit word for the first bits of a token, and that word with the token's bit."""
    word = F.shiftrightunsigned("token", 64 - prefix_bits + 6)
    bit = F.shiftrightunsigned("token", 64 - prefix_bits).bitwiseAND(F.lit(63)).cast("int")
    return word, F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def token_maps(tokens: DataFrame, prefix_bits: int, *conditions: Column) -> list[np.ndarray]:
    """For each condition a bitmap of the tokens that meet it, by their first bits, packed. 2**prefix_bits / 64 rows at most."""
    word, bits = _word_bits(prefix_bits)
    sums = [F.coalesce(F.bit_or(F.when(c, bits)), F.lit(0)).alias(f"m{k}") for k, c in enumerate(conditions)]
    rows = tokens.groupBy(word.alias("w")).agg(*sums).toArrow()
    out = []
    for k in range(len(conditions)):
        words = np.zeros(1 << (prefix_bits - 6), np.int64)
        words[rows.column("w").to_numpy()] = rows.column(f"m{k}").to_numpy()
        out.append(np.packbits(np.unpackbits(words.astype("<i8").view(np.uint8), bitorder="little")))
    return out


def with_counts(docs: DataFrame, law: Law, share: float, tables: Tables):
    """docs with an array of shingles for each of LEVELS, or null arrays and the broadcast maps that say the same."""
    rows = docs.mapInArrow(_counted_rows(law, share), "token long, node long")
    again = rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    again = tables.written(again, "again")
    if again.count() <= MAPPED:
        maps = token_maps(again, COUNT_BITS, *(F.col("n") >= n for n in LEVELS))
        tables.drop(again)
        nulls = {f"level{k}": F.lit(None).cast("array<bigint>") for k in range(len(LEVELS))}
        return docs.withColumns(nulls), docs.sparkSession.sparkContext.broadcast(maps)  # 2**COUNT_BITS bits each
    kinds = [F.collect_list(F.when(F.col("n") >= n, F.col("token"))).alias(f"level{k}") for k, n in enumerate(LEVELS)]
    own = rows.join(again, "token").groupBy("node").agg(*kinds)
    return docs.join(own.withColumnRenamed("node", "doc_id"), "doc_id", "left"), docs.sparkSession.sparkContext.broadcast(None)


def _prefix_rows(law: Law, share: float, times: int, shared) -> Callable:
    """(node, n, near, tokens): the first shingles for so many radii, of which the first `near` are those for r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        for batch in batches:
            ids, odd = batch.column("doc_id").to_pylist(), batch.column("odd").to_pylist()
            lists = [batch.column(f"level{k}") for k in range(len(LEVELS))]
            nodes, sizes, near, tokens, ends = [], [], [], [], [0]
            for row, found in _sets(batch, law):
                n = len(found)
                if not n:
                    continue
                if maps:
                    some, levels = np.flatnonzero(counted(share, found)), []
                    for bits in maps:
                        some = some[_in_map(bits, found[some], COUNT_BITS)]
                        levels.append(some)
                else:
                    levels = [np.isin(found.view(np.int64), x[row].values.to_numpy()) if x[row].is_valid else np.zeros(n, bool) for x in lists]
                nodes.append(_alias(ids[row], _digest(found)) if odd[row] else ids[row])
                sizes.append(n)
                near.append(law.prefix(n, 1))
                tokens.append(ordered(law, found, *levels, share=share)[: law.prefix(n, times)].view(np.int64))
                ends.append(ends[-1] + len(tokens[-1]))
            if nodes:
                arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(near, pa.int32()), arrays], ["node", "n", "near", "tokens"])

    return run


def _set_rows(law: Law) -> Callable:
    """(node, found): the set of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, odd = batch.column("doc_id").to_pylist(), batch.column("odd").to_pylist()
            rows = [(_alias(ids[k], _digest(s)) if odd[k] else ids[k], s.tobytes()) for k, s in _sets(batch, law) if len(s)]
            for a in range(0, len(rows), 500):
                nodes, sets = zip(*rows[a : a + 500])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "found"])

    return run


def _marked(near: bool, shared) -> Callable:
    """(token, node, at, n): those first shingles that the bitmap marks, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            lists = batch.column("tokens")
            size, tokens = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            at = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            wanted = _in_map(marks, tokens.view(np.uint64), MARK_BITS)
            if near:
                wanted &= at < np.repeat(batch.column("near").to_numpy(), size)
            arrays = [tokens[wanted], np.repeat(batch.column("node").to_numpy(), size)[wanted], at[wanted], np.repeat(batch.column("n").to_numpy(), size)[wanted]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["token", "node", "at", "n"])

    return run


_MARKED = "token long, node long, at long, n long"


def neighbours(prefixes: DataFrame, tables: Tables) -> DataFrame:
    """(node, first) of the documents that have neighbours: the first one of these and itself."""
    tokens = prefixes.select("node", F.explode(F.slice("tokens", F.lit(1), F.col("near"))).alias("token"))
    groups = tokens.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    groups = tables.written(groups.where("first < last").drop("last"), "groups")
    # most shingles occur once: those that share no prefix with a group's are left out before the join
    marks = prefixes.sparkSession.sparkContext.broadcast(token_maps(groups, MARK_BITS, F.lit(True))[0])  # 2**MARK_BITS bits
    again = prefixes.mapInArrow(_marked(True, marks), _MARKED).select("token", "node")
    found = tables.written(again.join(small_side(groups), "token").groupBy("node").agg(F.min("first").alias("first")), "neighbours")
    tables.drop(groups)
    return found


def may_reach(law: Law, times: int) -> Column:
    """Whether sets of n and pn shingles that share the ones at places at and pat may lie within so many radii."""
    least = law.least(times)
    rest = F.least(F.col("n") - F.col("at"), F.col("pn") - F.col("pat"))  # so many can be common from here on
    return (rest * (100 + least) >= least * (F.col("n") + F.col("pn"))) & (least * F.greatest("n", "pn") <= 100 * F.least("n", "pn"))


def candidates(law: Law, prefixes: DataFrame, pivots: DataFrame, tables: Tables) -> DataFrame:
    """(node, p): documents with the pivots that may lie within 2r of them."""
    own = prefixes.join(small_side(pivots), "node").select(F.col("node").alias("p"), F.col("n").alias("pn"), F.posexplode("tokens").alias("pat", "token"))
    own = tables.written(own, "pivot_tokens")
    marks = prefixes.sparkSession.sparkContext.broadcast(token_maps(own, MARK_BITS, F.lit(True))[0])  # 2**MARK_BITS bits
    rows = prefixes.mapInArrow(_marked(False, marks), _MARKED)
    pairs = rows.join(small_side(own), "token").where((F.col("node") != F.col("p")) & may_reach(law, 2)).select("node", "p").distinct()
    pairs = tables.written(pairs, "pairs")
    tables.drop(own)
    return pairs


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _compared(law: Law) -> Callable:
    """(node, p, d, linked) within 2r, of rows sorted by (p, block) with the pivot's own row first in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for p, node, found in zip(batch.column("p").to_pylist(), batch.column("node").to_pylist(), batch.column("found")):
                found = np.frombuffer(found.as_buffer(), np.uint64)
                if node is None:
                    pivot = found
                    continue
                common = common_count(pivot, found)
                d = 1 - common / (len(pivot) + len(found) - common)
                if d <= 2 * law.radius + _EPSILON:
                    for column, value in zip(out, (node, p, d, law.linked(common, len(pivot), len(found)))):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["node", "p", "d", "linked"])

    return run


def _block(node: str, n: str) -> Column:
    return F.pmod(F.xxhash64(node), F.col(n)).cast("int")


def distances(law: Law, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, p, d, linked) of the pairs within 2r."""
    sizes = pairs.groupBy("p").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    rows = pairs.join(sizes, "p").withColumn("block", _block("node", "blocks")).join(sets, "node").select("p", "block", "node", "found")
    own = sizes.join(sets.withColumnRenamed("node", "p"), "p")
    own = own.select("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("node"), "found")
    both = own.unionByName(rows).repartition("p", "block").sortWithinPartitions("p", "block", F.col("node").asc_nulls_first())
    return both.mapInArrow(_compared(law), "node long, p long, d double, linked boolean")


def part_marks(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One byte for each of m parts of the hash range; sets that differ in a byte differ in that part."""
    out, edges = np.zeros((len(sets), m), np.uint8), (np.arange(m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
    for row, found in enumerate(sets):
        at = np.append(np.searchsorted(found, edges), len(found))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(found))))
        out[row] = ((sums[at[1:]] - sums[at[:-1]]) >> np.uint64(56)).astype(np.uint8)
    return out


class Compared:
    """Sets with what bounds their common shingles, for the pairs that no cheaper test has ruled out."""

    def __init__(self, law: Law, sets: list[np.ndarray]):
        self.law, self.sets, self.sizes = law, sets, np.array([len(s) for s in sets])
        self.marks = part_marks(sets, int(max(8, min(4096, np.median(self.sizes) // 2))) if sets else 8)

    def linked(self, i: int, others: np.ndarray) -> Iterator[int]:
        """Those of the others that link with i: a symmetric difference shows in at most so many parts."""
        share = (100 - self.law.percent) / (100 + self.law.percent)
        near = np.minimum(self.sizes[others], self.sizes[i]) * 100 >= np.maximum(self.sizes[others], self.sizes[i]) * self.law.percent
        others = others[near]
        differing = (self.marks[others] != self.marks[i]).sum(axis=1)
        for j in others[differing <= (self.sizes[others] + self.sizes[i]) * share + _EPSILON].tolist():
            if self.law.linked(common_count(self.sets[i], self.sets[j]), int(self.sizes[i]), int(self.sizes[j])):
                yield j


def window_links(law: Law, d: np.ndarray, guest: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each guest of a region one member that links with it, if any; d: distances to the region's pivot."""
    compared, members, out = Compared(law, sets), np.flatnonzero(~guest), []
    for i in np.flatnonzero(guest).tolist():
        ring = members[np.abs(d[members] - d[i]) <= law.radius + _EPSILON]
        out += [(j, i) for j in [next(compared.linked(i, ring), None)] if j is not None]
    return out


def _window_rows(law: Law) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, sets = table.column("node").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("found").to_pylist()]
        edges = window_links(law, table.column("d").to_numpy(), table.column("guest").to_numpy(zero_copy_only=False), sets)
        return pa.table({"a": pa.array([int(nodes[i]) for i, _ in edges], pa.int64()), "b": pa.array([int(nodes[j]) for _, j in edges], pa.int64())})

    return run


def homes(near: DataFrame, pivots: DataFrame) -> DataFrame:
    """(node, p, d): the nearest pivot within r of each document that has one, pivots being their own."""
    best = near.where("linked").join(small_side(pivots), "node", "left_anti").groupBy("node").agg(F.min(F.struct("d", "p")).alias("best")).select("node", "best.p", "best.d")
    return best.unionByName(pivots.select("node", F.col("node").alias("p"), F.lit(0.0).alias("d")))


def windows(law: Law, near: DataFrame, home: DataFrame) -> DataFrame:
    """(node, p, d): documents replicated into regions that are not their home.

    A document with a home goes only into regions of smaller pivots: its links with larger ones are found the other way.
    """
    reach = home.where("node <> p").groupBy("p").agg(F.max("d").alias("reach"))
    rows = near.where("not linked").join(reach, "p").where(F.col("d") <= F.col("reach") + law.radius + _EPSILON)
    rows = rows.join(home.select("node", F.col("p").alias("home")), "node", "left")
    return rows.where("home is null or home > p").select("node", "p", "d")


def region_links(law: Law, home: DataFrame, guests: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of documents in windows with members of the regions."""
    blocks = lambda n: F.ceil(F.count("*") / F.lit(n)).cast("int")
    wanted = guests.groupBy("p").agg(F.min("d").alias("nearest"), blocks(BLOCK_ROWS).alias("bj"))
    members = home.where("node <> p").join(wanted, "p").where(F.col("d") >= F.col("nearest") - law.radius - _EPSILON)
    sizes = members.groupBy("p").agg(blocks(BLOCK_ROWS).alias("bi"), F.first("bj").alias("bj"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.select("node", "p", "d").join(sizes, "p").select("node", "p", "d", _block("node", "bi").alias("i"), every("bj").alias("j"), F.lit(False).alias("guest"))
    right = guests.join(sizes, "p").select("node", "p", "d", every("bi").alias("i"), _block("node", "bj").alias("j"), F.lit(True).alias("guest"))
    rows = left.unionByName(right).join(sets, "node").repartition("p", "i", "j")
    return rows.groupBy("p", "i", "j").applyInArrow(_window_rows(law), "a long, b long")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def forest_links(law: Law, sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, or of those across two sides."""
    compared, forest, out = Compared(law, sets), _Forest(len(sets)), []
    order = np.argsort(compared.sizes, kind="stable")
    sizes = compared.sizes[order]
    ends = np.searchsorted(sizes * law.percent, sizes * 100, side="right")  # partners at most so much larger
    for row, i in enumerate(order.tolist()):
        others = order[row + 1 : ends[row]]
        if side is not None:
            others = others[side[others] != side[i]]
        for j in compared.linked(i, others):
            if forest.join(i, j):
                out.append((i, j))
    return out


def _forest_rows(law: Law) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, blocks = table.column("node").to_numpy(), table.column("block").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("found").to_pylist()]
        edges = forest_links(law, sets, blocks if len(np.unique(blocks)) > 1 else None)
        return pa.table({"a": pa.array([int(nodes[i]) for i, _ in edges], pa.int64()), "b": pa.array([int(nodes[j]) for _, j in edges], pa.int64())})

    return run


def leftover_links(law: Law, docs: DataFrame, prefixes: DataFrame, tables: Tables) -> list[DataFrame]:
    """(a, b): links among documents that the rounds have left without a home, enough to connect all that links connect."""
    tokens = prefixes.select("node", "n", F.posexplode(F.slice("tokens", F.lit(1), F.col("near"))).alias("at", "token"))
    groups = tokens.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size")).where("first < last")
    tokens = tables.written(tokens.join(groups.select("token", "first", "size"), "token"), "leftover")
    # linked documents share a shingle of a small group and are a pair of it, or of a large one and belong to its region
    own = tokens.where(F.col("size") <= SMALL_GROUP).select("token", "node", "n", "at")
    other = own.select("token", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("at").alias("pat"))
    pairs = tables.written(own.join(other, "token").where((F.col("node") > F.col("p")) & may_reach(law, 1)).select("node", "p").distinct(), "pairs")
    out = []
    if pairs.limit(1).count():
        nodes = pairs.select("node").union(pairs.select("p")).distinct()
        sets = tables.written(sets_of(law, docs, nodes), "sets")
        found = distances(law, pairs, sets).where("linked").select(F.col("p").alias("a"), F.col("node").alias("b"))
        out.append(tables.written(found, "links"))
        tables.drop(sets)
    tables.drop(pairs)
    edges = tokens.where(F.col("size") > SMALL_GROUP).select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b")
    regions = tables.written(components(edges, tables).select("node", F.col("label").alias("region")), "regions")
    if regions.limit(1).count():
        sets = tables.written(sets_of(law, docs, regions.select("node")).join(regions, "node"), "leftover_sets")
        blocks = sets.groupBy("region").agg(F.ceil(F.sum(F.length("found")) / F.lit(BLOCK_BYTES)).cast("int").alias("n"))
        rows = sets.join(blocks, "region").withColumn("block", _block("node", "n"))
        rows = rows.select("region", "node", "found", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        rows = rows.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "found", "block")
        found = rows.repartition("region", "i", "j").groupBy("region", "i", "j").applyInArrow(_forest_rows(law), "a long, b long")
        out.append(tables.written(found, "links"))
        tables.drop(sets)
    tables.drop(tokens)
    return out


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """docs of some nodes, and all documents with several texts."""
    some = small_side(nodes.withColumnRenamed("node", "doc_id"))
    return docs.where("not odd").join(some, "doc_id", "left_semi").select("doc_id", "text", "odd").unionByName(docs.where("odd").select("doc_id", "text", "odd"))


def sets_of(law: Law, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, found) of some nodes; those of documents with several texts are sorted out after they were read."""
    return texts_of(docs, nodes).mapInArrow(_set_rows(law), "node long, found binary")


def first_shingles(law: Law, docs: DataFrame, share: float, times: int, tables: Tables) -> DataFrame:
    """(node, n, near, tokens) of the docs, in an order for which that share of their shingles is counted."""
    counts, maps = with_counts(docs, law, share, tables)
    return tables.written(counts.mapInArrow(_prefix_rows(law, share, times, maps), "node long, n long, near int, tokens array<long>"), "prefixes")


def links(docs: DataFrame, law: Law, tables: Tables) -> DataFrame:
    """(a, b): links among documents (doc_id, text, odd), enough to connect all that links connect."""
    prefixes = first_shingles(law, docs, law.counted, 1, tables)
    found = neighbours(prefixes, tables)
    live = tables.written(texts_of(docs, found.select("node")), "live")
    tables.drop(docs, prefixes, found)
    docs, out = live, []
    prefixes = first_shingles(law, docs, 1.0, 2, tables)
    for _ in range(ROUNDS):
        found = neighbours(prefixes, tables)
        if not found.limit(1).count():
            return _union(docs, out)
        pivots = tables.written(found.where("node = first").select("node"), "pivots")
        live = prefixes.join(small_side(found.select("node")), "node", "left_semi")
        pairs = candidates(law, live, pivots, tables)
        nodes = pairs.select("node").union(pairs.select("p")).distinct()
        sets = tables.written(sets_of(law, docs, nodes), "sets")
        near = tables.written(distances(law, pairs, sets), "near")
        home = tables.written(homes(near, pivots), "homes")
        out.append(tables.written(near.where("linked").select(F.col("p").alias("a"), F.col("node").alias("b")), "links"))
        guests = tables.written(windows(law, near, home), "windows")
        out.append(tables.written(region_links(law, home, guests, sets), "links"))
        rest = found.select("node").join(home.select("node"), "node", "left_anti")
        rest = tables.written(rest, "rest")
        left = rest.count()
        if not left:
            return _union(docs, out)
        rest = tables.written(prefixes.join(small_side(rest, left), "node", "left_semi"), "prefixes")
        tables.drop(prefixes, found, pivots, pairs, sets, near, home, guests)
        prefixes = rest
    return _union(docs, out + leftover_links(law, docs, prefixes, tables))


def _union(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    out = docs.sparkSession.createDataFrame([], "a long, b long") if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def joined(docs: DataFrame, law: Law, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) of every row."""
    tables = Tables(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = tables.written(own.mapInArrow(_digests(law), "doc_id long, n_shingles long, digest binary, alias long"), "digests")
    full = rows.where("digest is not null and doc_id is not null")
    # documents with several texts: each text is a node of its own, and the nodes are linked
    odd = full.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.min("alias").alias("a")).where("x <> y").select("doc_id", "a")
    odd = tables.written(odd, "odd")
    marked = full.join(small_side(odd), "doc_id", "left").withColumn("node", F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(F.col("alias")))
    classes = marked.groupBy("digest").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("digest", F.col("first.doc_id").alias("first"), "first.node")
    classes = tables.written(classes, "classes")
    copies = marked.where("a is null").join(classes.select("digest", "first"), "digest").where("doc_id <> first").select("doc_id")
    empty = rows.where("digest is null and doc_id is not null").select("doc_id")
    empty = empty.join(full.select("doc_id"), "doc_id", "left_anti")
    out_of = tables.written(copies.union(empty).distinct(), "copies")
    firsts = own.where("doc_id is not null").join(small_side(out_of), "doc_id", "left_anti")
    firsts = firsts.join(small_side(odd), "doc_id", "left").select("doc_id", "text", F.col("a").isNotNull().alias("odd"))
    firsts = tables.written(firsts, "firsts")
    several = marked.where("a is not null").select("a", F.col("alias").alias("b")).where("a <> b")
    labels = components(links(firsts, law, tables).unionByName(several), tables)
    named = classes.join(labels, "node", "left").select("digest", "first", F.coalesce("label", "node").alias("label"))
    named = named.select("digest", "label").join(named.groupBy("label").agg(F.min("first").alias("component")), "label").drop("label")
    named = tables.written(named, "components")
    tables.keep(rows, named)
    out = rows.join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
