"""Sharding: minimax contiguous partition of atomic groups, in Spark expressions only.

Rows with equal texts form one atomic group; groups are ordered by a 60-bit prefix of the text's SHA-256. A binary
search finds the smallest capacity at which a greedy walk fits all groups into the shards. The walk needs prefix sums of
group sizes, which are too many to gather. So it runs on sums over key ranges, BITS bits of the key first. Ranges of several
groups are poured like a liquid, which bounds the capacity from below; where a walk at that bound cuts into such ranges, they
are split by the next BITS bits, and the bound rises, until a walk that fills ranges whole keeps to it: then it is the
smallest capacity. A level splits at most one range a cut, so what reaches the driver depends on the number of shards and
the length of keys, not on the rows.

Of the cuts that the smallest capacity allows, those nearest to even shares of what is left are taken, as a greedy walk
would leave the last shards empty where one group is larger than an even share.

Defined cases: a null text is an empty one (same group, size 1); repeated rows count each; an empty table gives an
empty result; fewer groups than shards leave shards empty.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

KEY_BITS = 60
BITS = 7
#: Cuts in favour of even shares are as fine as this part of a share.
EVEN = 1000
#: Ranges of document ids in which slots are counted on their own.
SLOT_RANGES = 1024


class Range(NamedTuple):
    """Groups with keys in [first, first + 2**(KEY_BITS - bits))."""

    first: int
    bits: int
    size: int
    groups: int


class Plan(NamedTuple):
    """Shard i takes keys below ends[i] that no earlier one takes."""

    ends: list[int]
    capacity: int


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and group key of every row."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    prefix = F.substring(F.sha2(value, 256), 1, KEY_BITS // 4)
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value.cast("binary")).cast("long").alias("text_crc32"),
        F.conv(prefix, 16, 10).cast("long").alias("key"),
    )


def _ranges(groups: DataFrame, within: list[Range] | None) -> list[Range]:
    """Sums by the next BITS bits of the key, for all keys or those in some ranges (a bounded list)."""
    bits = BITS if within is None else min(KEY_BITS, within[0].bits + BITS)
    coarse = KEY_BITS - bits
    if within is not None:
        up = KEY_BITS - within[0].bits
        groups = groups.where(F.shiftrightunsigned("key", up).isin([r.first >> up for r in within]))
    sums = groups.groupBy(F.shiftrightunsigned("key", coarse).alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    return [Range(r.b << coarse, bits, r.s, r.n) for r in sums.collect()]


def _walk(ranges: list[Range], shards: int, capacity: int, pour: bool = False) -> tuple[bool, list[int]]:
    """Greedy filling: whether all fits, and the places in the row of sizes at which shards were cut.

    pour: ranges of several groups can be cut anywhere.
    """
    cuts, at, used = [], 0, 0
    for r in ranges:
        size = r.size
        while used + size > capacity:
            if len(cuts) + 1 >= shards:
                return False, cuts
            if pour and r.groups > 1:
                at += capacity - used
                size -= capacity - used
            elif r.size > capacity:
                return False, cuts
            cuts.append(at)
            used = 0
        used += size
        at += size
    return True, cuts


def _smallest(ranges: list[Range], shards: int, pour: bool = False) -> int:
    high = sum(r.size for r in ranges)
    low = max(-(-high // shards), max((r.size for r in ranges if r.groups == 1 or not pour), default=0))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _walk(ranges, shards, middle, pour)[0] else (middle + 1, high)
    return low


def _at(ranges: list[Range], cuts: list[int]) -> list[Range]:
    """Ranges of several groups that have one of these places inside."""
    ends, at = [], 0
    for r in ranges:
        at += r.size
        ends.append(at)
    inside = {i for cut in cuts if (i := bisect.bisect_right(ends, cut)) < len(ends) and ends[i] - ranges[i].size < cut}
    return [ranges[i] for i in sorted(inside) if ranges[i].groups > 1]


def _open(ranges: list[Range], shards: int) -> list[Range]:
    """Ranges of several groups that must be split before the smallest capacity is known, at most one for each cut."""
    bound = _smallest(ranges, shards, pour=True)
    if _walk(ranges, shards, bound)[0]:
        return []
    return _at(ranges, _walk(ranges, shards, bound, pour=True)[1])


def _uneven(ranges: list[Range], shards: int, capacity: int) -> list[Range]:
    """Ranges next to the even cuts that are too large to cut beside them, at most two for each cut."""
    least = sum(r.size for r in ranges) / (shards * EVEN)
    beside = {i for cut in _even(ranges, shards, capacity) for i in (cut - 1, cut)}
    return [ranges[i] for i in sorted(beside) if 0 <= i < len(ranges) and ranges[i].groups > 1 and ranges[i].size > least]


def _share(sizes: list[int], shards: int) -> float:
    """An even share, not counting what is larger than one and fills a shard by itself."""
    rest = sum(sizes)
    for size in sorted(sizes, reverse=True):
        if shards == 1 or size * shards <= rest:
            break
        rest, shards = rest - size, shards - 1
    return rest / shards


def _even(ranges: list[Range], shards: int, capacity: int) -> list[int]:
    """Numbers of the ranges at which shards begin: of all cuts within the capacity those nearest to even shares."""
    sums = [0]
    for r in ranges:
        sums.append(sums[-1] + r.size)
    cuts, start = [], 0
    for left in range(shards, 1, -1):
        most = bisect.bisect_right(sums, sums[start] + capacity) - 1
        even = sums[start] + _share([r.size for r in ranges[start:]], left)
        low = min(most, max(start + 1, bisect.bisect_left(sums, even)))
        if low > start + 1 and even - sums[low - 1] < sums[low] - even:
            low -= 1
        high = most
        while low < high:  # the rest fits from `most` on, and from any cut right of one from which it fits
            middle = (low + high) // 2
            low, high = (low, middle) if _walk(ranges[middle:], left - 1, capacity)[0] else (middle + 1, high)
        start = low
        cuts.append(start)
    return cuts


def planned(groups: DataFrame, shards: int) -> Plan:
    """Cuts for groups (key, size), each key once."""
    ranges = sorted(_ranges(groups, None))

    def split(todo: list[Range]) -> list[Range]:
        level = min(r.bits for r in todo)
        todo = [r for r in todo if r.bits == level]
        gone = set(todo)
        return sorted([r for r in ranges if r not in gone] + _ranges(groups, todo))

    while todo := _open(ranges, shards):
        ranges = split(todo)
    capacity = _smallest(ranges, shards, pour=True)
    while todo := _uneven(ranges, shards, capacity):
        ranges = split(todo)
    ends = [ranges[i].first if i < len(ranges) else 1 << KEY_BITS for i in _even(ranges, shards, capacity)]
    return Plan([*ends, 1 << KEY_BITS], capacity)


def shard_of(key: Column, plan: Plan) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for i, end in enumerate(plan.ends):
        out = out.when(key < end, F.lit(i))
    return out.cast("int")


def sharded(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in its shard) of every row; equal texts share a shard."""
    rows = written(sized(docs, text, doc_id), "sized")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    plan = planned(groups, shards)
    rows = rows.withColumn("shard", shard_of(F.col("key"), plan))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_RANGES)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = F.broadcast(offsets)  # at most shards * SLOT_RANGES rows
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "key", "size")
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "part"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"))
