"""Read admission on a stream: counters that update with every micro-batch, and a sample's reads admitted by their hashes.

How many of a sample's reads can stay is known only at the end. While the stream runs, a read is admitted if its hash lies
below the cutoff for the reads seen so far. The cutoff only falls, so no read that stays at the end is ever turned away, and
what was admitted too much is dropped by the final counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reads import gate

#: Fixed value: the largest hash.
LARGEST = (1 << 64) - 1
#: Parts in which a sample's reads are counted, so that a large sample is no single task. A part has seen fewer reads than its
#: sample, so its cutoff is above the sample's, and it admits some more.
PARTS = 8


def live_counters(stream: DataFrame, error_rate: float, min_length: int, max_length: int) -> DataFrame:
    """Reads by sample and gate (passed: no gate), for update or complete mode."""
    why = F.coalesce(gate(error_rate, min_length, max_length), F.lit("passed"))
    return stream.groupBy("sample_idx", why.alias("gate")).agg(F.count("*").alias("n"))


def cutoff(seen: int, most: int) -> int:
    """The largest hash that stays when so many reads were seen."""
    return LARGEST if seen <= most else LARGEST * most // seen


def admitted(stream: DataFrame, most: int, parts: int = PARTS) -> DataFrame:
    """Rows of a stream (sample_idx, sampling_hash and other columns) that may stay, with the reads their part had seen, for append mode."""
    columns = stream.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", part int, seen long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for rows in frames:
            stays = []
            for value in rows["sampling_hash"]:
                seen += 1
                stays.append(int(value) <= cutoff(seen, most))
            kept = rows.loc[stays, columns]
            yield kept.assign(part=key[1], seen=seen)
        state.update((seen,))

    part = F.pmod(F.xxhash64("sampling_hash"), F.lit(parts)).cast("int")
    keyed = stream.withColumn("__part", part).groupBy("sample_idx", "__part")
    return keyed.applyInPandasWithState(run, schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def settled(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Of admitted rows those that stay by the samples' final counts (sample_idx, n)."""
    limit = F.expr(f"CAST({LARGEST} AS DECIMAL(20,0)) * CAST({most} AS DECIMAL(18,0))")
    last = counts.where(F.col("n") > most).select("sample_idx", F.floor(limit / F.col("n").cast("decimal(10,0)")).alias("last"))
    joined = rows.join(F.broadcast(last), "sample_idx", "left")  # a row for each sample
    return joined.where(F.col("last").isNull() | (F.col("sampling_hash") <= F.col("last"))).drop("last", "part", "seen")
