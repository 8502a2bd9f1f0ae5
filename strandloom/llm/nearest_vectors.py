"""Approximate nearest neighbours by cross-polytope hashing, for the largest inner product.

1. Vectors are scaled by the largest norm, and one coordinate is added that makes them unit vectors (queries get 0 there, so
   the order of inner products stays). Three rounds of random signs and a fast Hadamard transform rotate them; a vector's
   bucket in a table is the signed axis nearest to it. TABLES rotations make as many tables.
2. A query probes the PROBES nearest signed axes of each table. The buckets of GROUP axes go to one task, in blocks of
   ROW_BLOCK rows; a query goes to a block once, whatever it probes there.
3. A task multiplies each bucket with the queries that probe it and keeps each query's best, whose inner products are taken
   again, one component after the other in double precision. Queries' lists of all tasks are merged.
4. Queries that found fewer than k rows, as on small tables, look into all buckets of one table, so they find all that there is.

Every row is indexed. Of equal vectors a batch of rows keeps the k+1 smallest ids: more can be in no result. What is found
depends on the share of buckets probed, not on the number of rows: on vectors without any structure (the hardest case) 4
tables with 72 of 256 buckets look at two thirds of the rows.

Defined cases: vectors that are null, zero, or hold null or non-finite components, rows with a null id and vectors whose
length is not the most common one take no part; rows that share the query's id are its own row; a repeated id is found once,
with its best score; ties go to the smaller id; an empty table gives no rows. Components may be up to 1e150.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .storage import Tables
from .words import mixed

TABLES, PROBES, NEAREST = 4, 72, 20
#: Axes whose buckets go together, and rows of them that one task holds.
GROUP, ROW_BLOCK = 16, 131_072
QUERY_CHUNK = 512
#: Pairs whose components are held at once.
PAIRS = 65_536
_SEED = 0xC405
#: How far a product from the matrix multiplication may lie from the one taken component by component, of the norms' product.
_SLACK = 1e-12


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the number of columns is a power of two."""
    rows, n = x.shape
    span = 1
    while span < n:
        x = x.reshape(rows, n // (2 * span), 2, span)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(rows, n)
        span *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """Buckets of vectors in each table: axis 2a is the positive and 2a + 1 the negative direction of coordinate a."""

    def __init__(self, dims: int, largest: float, tables: int):
        self.dims, self.largest, self.size = dims, largest, 1 << dims.bit_length()
        self.signs = np.random.default_rng(_SEED).choice([-1.0, 1.0], (tables, 3, self.size))

    def rotated(self, x: np.ndarray, table: int, filled: bool) -> np.ndarray:
        """Rotated vectors; filled: with the coordinate that makes them unit vectors."""
        y = np.zeros((len(x), self.size))
        y[:, : self.dims] = x / self.largest
        if filled:
            y[:, self.dims] = np.sqrt(np.maximum(0, 1 - (y**2).sum(axis=1)))
        for signs in self.signs[table]:
            y = hadamard(y * signs)
        return y

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        y = self.rotated(x, table, True)
        axis = np.abs(y).argmax(axis=1)
        return 2 * axis + (y[np.arange(len(y)), axis] < 0)

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n nearest signed axes of each vector, nearest first."""
        y = self.rotated(x, table, False)
        both = np.stack((y, -y), axis=2).reshape(len(y), 2 * self.size)
        return np.argsort(-both, axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def _trimmed(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows without those that have `most` equal vectors with smaller ids."""
    order = np.lexsort((ids, *x.T[::-1]))
    same = np.concatenate(([False], (x[order[1:]] == x[order[:-1]]).all(axis=1)))
    heads = np.flatnonzero(~same)
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return np.sort(order[rank < most])


def _counted(index: CrossPolytope, tables: int, most: int):
    """(table_no, part, n): rows of each group of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = -(-index.size // GROUP)
        total = np.zeros((tables, parts), np.int64)
        for batch in batches:
            x = _matrix(batch.column("vector"), index.dims)
            x = x[_trimmed(batch.column("vec_id").to_numpy(), x, most)]
            for t in range(tables):
                total[t] += np.bincount(index.bucket(x, t) // (2 * GROUP), minlength=parts)
        t, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(p, pa.int32()), pa.array(total[t, p])], ["table_no", "part", "n"])

    return run


_ROW = "table_no int, part int, block int, bucket int, vec_id long, probes binary, vector binary"


def _batch(table: int, part, block, bucket, ids, probes, vectors) -> pa.RecordBatch:
    n = len(ids)
    arrays = [
        pa.array(np.full(n, table), pa.int32()), pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array(bucket, pa.int32()),
        pa.array(ids, pa.int64()), pa.array(probes, pa.binary()), pa.array(vectors, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["table_no", "part", "block", "bucket", "vec_id", "probes", "vector"])


def _rows(index: CrossPolytope, tables: int, blocks: np.ndarray, most: int):
    """Rows by (table, part, block), with their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"), index.dims)
            own = _trimmed(ids, x, most)
            ids, x = ids[own], x[own]
            vectors, spread = [row.tobytes() for row in x], (mixed(ids.view(np.uint64) ^ mixed(x[:, 0].astype(np.float64).view(np.uint64))) >> np.uint64(1)).astype(np.int64)
            for t in range(tables):
                bucket = index.bucket(x, t)
                part = bucket // (2 * GROUP)
                yield _batch(t, part, spread % blocks[t, part], bucket, ids, [None] * len(ids), vectors)

    return run


def _queries(index: CrossPolytope, tables: int, blocks: np.ndarray, probes: int):
    """Queries for each (table, part, block) that holds buckets they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"), index.dims)
            for t in range(tables):
                asked = index.probes(x, t, probes)
                for part in np.flatnonzero(blocks[t]).tolist():
                    inside = asked // (2 * GROUP) == part
                    some = np.flatnonzero(inside.any(axis=1))
                    if not len(some):
                        continue
                    # The buckets within a part fit in a byte.
                    lists = [(asked[i][inside[i]] - part * 2 * GROUP).astype(np.uint8).tobytes() for i in some.tolist()]
                    vectors = [x[i].tobytes() for i in some.tolist()]
                    for block in range(int(blocks[t, part])):
                        n = len(some)
                        yield _batch(t, np.full(n, part), np.full(n, block), np.full(n, -1), ids[some], lists, vectors)

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, one component after the other in double precision."""
    out = np.zeros(len(q))
    for first in range(0, len(q), PAIRS):
        a, b = q[first : first + PAIRS].astype(np.float64), x[first : first + PAIRS].astype(np.float64)
        for j in range(q.shape[1]):
            out[first : first + PAIRS] += a[:, j] * b[:, j]
    return out


class Block:
    """Rows of one (table, part, block), by bucket."""

    def __init__(self, bucket: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, bucket))
        self.ids, self.x, self.cuts = ids[order], x[order], np.searchsorted(bucket[order] % (2 * GROUP), np.arange(2 * GROUP + 1))
        self.norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))

    def best(self, ids: np.ndarray, q: np.ndarray, probed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, vec_id, score): each query's k best rows of the buckets that it probes."""
        places, rows = [], []
        slack = _SLACK * q.shape[1] * self.norm * np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        for b in range(2 * GROUP):
            asking, first, end = np.flatnonzero(probed[:, b]), int(self.cuts[b]), int(self.cuts[b + 1])
            if not len(asking) or first == end:
                continue
            s = q[asking].astype(np.float64) @ self.x[first:end].astype(np.float64).T
            s[ids[asking][:, None] == self.ids[None, first:end]] = -np.inf
            least = np.partition(s, end - first - k, axis=1)[:, end - first - k] if end - first > k else np.full(len(asking), -np.inf)
            i, j = np.nonzero((s >= (least - slack[asking])[:, None]) & (s > -np.inf))
            places.append(asking[i])
            rows.append(j + first)
        if not sum(map(len, places)):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        place, row = np.concatenate(places), np.concatenate(rows)
        score, found = products_of(q, self.x, place, row), self.ids[row]
        order = np.lexsort((found, -score, place))
        place, found, score = place[order], found[order], score[order]
        heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        rank = np.arange(len(place)) - np.repeat(heads, np.diff(np.append(heads, len(place))))
        keep = rank < k
        return place[keep], found[keep], score[keep]


def products_of(q: np.ndarray, x: np.ndarray, place: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, PAIRS of them held at once."""
    return np.concatenate([products(q[place[k : k + PAIRS]], x[row[k : k + PAIRS]]) for k in range(0, len(place), PAIRS)])


def _searched(dims: int, kind: str, k: int):
    """query_id, vec_id, score; rows of a block come sorted before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("table_no", "part", "block")], axis=1)
            bucket, ids = batch.column("bucket").to_numpy(), batch.column("vec_id").to_numpy()
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), kind).reshape(-1, dims)
            probes = batch.column("probes")
            asks = bucket < 0
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1
            for first, end in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
                if first == end:
                    continue
                if tuple(keys[first]) != now:
                    now, held, block = tuple(keys[first]), [], None
                if not asks[first]:
                    held.append((bucket[first:end], ids[first:end], x[first:end].copy()))
                    continue
                if block is None and held:
                    block, held = Block(*(np.concatenate(c) for c in zip(*held))), []
                if block is None:
                    continue
                for a in range(first, end, QUERY_CHUNK):
                    b = min(a + QUERY_CHUNK, end)
                    probed = np.zeros((b - a, 2 * GROUP), bool)
                    for i, at in enumerate(probes.slice(a, b - a).to_pylist()):
                        probed[i, np.frombuffer(at, np.uint8)] = True
                    place, found, score = block.best(ids[a:b], x[a:b], probed, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][place]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def searched(
    vectors: DataFrame, queries: Column | str, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEAREST, tables: int = TABLES, probes: int = PROBES, row_block: int = ROW_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `queries` (over vec_id) holds, the k nearest other rows found.

    tables and probes: more of both find more and look at more rows.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("vector"))
    own = own.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    dims = own.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"), F.max(norm).alias("largest")).orderBy(F.desc("n"), F.desc("dims")).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = own.where(F.size("vector") == dims["dims"])
    index, kind = CrossPolytope(dims["dims"], dims["largest"], tables), "float64"
    if isinstance(own.schema["vector"].dataType, ArrayType) and isinstance(own.schema["vector"].dataType.elementType, FloatType):
        kind = "float32"
    best = Tables(spark).written(_merged(own, own.where(queries), index, kind, k, tables, probes, row_block), "nearest")
    full = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = own.where(queries).join(full, "vec_id", "left_anti").select("vec_id", "vector")
    if not short.limit(1).count():
        return best
    rest = _merged(own, short, index, kind, k, 1, 2 * index.size, row_block)
    return best.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(rest)


def _merged(own: DataFrame, asking: DataFrame, index: CrossPolytope, kind: str, k: int, tables: int, probes: int, row_block: int) -> DataFrame:
    """query_id, rank, vec_id, score of the queries `asking` in rows `own`, both (vec_id, vector)."""
    blocks = np.zeros((tables, -(-index.size // GROUP)), np.int64)
    for x in own.mapInArrow(_counted(index, tables, k + 1), "table_no int, part int, n long").groupBy("table_no", "part").agg(F.sum("n").alias("n")).collect():  # tables x parts rows
        blocks[x["table_no"], x["part"]] = -(-x["n"] // row_block)
    rows = own.mapInArrow(_rows(index, tables, blocks, k + 1), _ROW)
    asked = asking.mapInArrow(_queries(index, tables, blocks, probes), _ROW)
    key = ["table_no", "part", "block"]
    dealt = rows.unionByName(asked).repartition(int(blocks.sum()), *key).sortWithinPartitions(*key, F.col("bucket") < 0)
    found = dealt.mapInArrow(_searched(index.dims, kind, k), "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
