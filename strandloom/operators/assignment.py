"""Assignment of trimmed reads to samples: groups of primers, identifiers, and quality of the tag against what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as st
from .trimming import CODES


def primer_groups(samples: DataFrame) -> DataFrame:
    """sample, primer_group, forward: samples whose primers are parts of one maximal primer.

    samples: sample, ordinal, primer. A primer that is part of another is not maximal; each sample goes to the shortest
    maximal primer that holds its own (ties: the one that comes first), and reads are searched for the primer of the
    group's first sample. Primers are joined on their parts, which a primer has by the square of its length.
    """
    own = samples.select("sample", "ordinal", F.upper("primer").alias("primer"))
    n = F.length("primer")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: F.substring("primer", i, m))))
    unique = own.where("primer <> ''").groupBy("primer").agg(F.min("ordinal").alias("first"))
    held = unique.select(F.col("primer").alias("holder"), "first", F.explode(F.array_distinct(parts)).alias("primer"))
    inner = held.join(unique.select("primer"), "primer")
    maximal = unique.join(inner.where("primer <> holder").select("primer").distinct(), "primer", "left_anti").select(F.col("primer").alias("holder"))
    place = inner.join(maximal, "holder").groupBy("primer").agg(F.min_by("holder", F.struct(F.length("holder"), "first")).alias("primer_group"))
    rows = own.join(place, "primer")
    forward = rows.groupBy("primer_group").agg(F.min_by("primer", F.struct("ordinal", "sample")).alias("forward"))
    return rows.join(forward, "primer_group").select("sample", "primer_group", "forward")


def exact_pattern(codes: str) -> str:
    """A regular expression for texts that are compatible with IUPAC codes letter by letter."""
    fits = lambda c: "".join(sorted(x for x, bases in CODES.items() if set(bases) & set(CODES[c])))
    return "".join(f"[{fits(c)}]" for c in codes.upper())


def assigned(reads: DataFrame, identifiers: dict[str, str], window: int = 10) -> DataFrame:
    """The reads once for each sample whose identifier lies in their first bases, as sample and rest (from there on);
    once with a null sample where none does. identifiers: by sample, not empty."""
    head = F.substring("sequence", 1, window)
    hits = F.array(*[F.struct(F.lit(s).alias("sample"), F.regexp_instr(head, F.lit(exact_pattern(i))).alias("at")) for s, i in identifiers.items()])
    rows = reads.withColumn("hit", F.explode_outer(F.filter(hits, lambda h: h["at"] > 0)))
    return rows.withColumns({"sample": F.col("hit.sample"), "rest": F.expr("substr(sequence, hit.at)")}).drop("hit")


def heteroduplexes(reads: DataFrame, start: int, stop: int) -> DataFrame:
    """fam, n, p, heteroduplex: families whose tag (positions start to stop) reads far worse than the 21 bases from
    stop + 4 on, by a pooled t-test of mean qualities. reads: fam, quality (Phred+33); a family with a quality text
    below 50 letters, and a tag that leaves no room in 50, is none and has no p."""
    tag, after = range(start, stop), range(stop + 4, stop + 25)
    phred = lambda i: F.greatest(F.ascii(F.substring("quality", i + 1, 1)) - 33, F.lit(0))
    sums = reads.groupBy("fam").agg(F.count("*").alias("n"), F.min(F.coalesce(F.length("quality"), F.lit(0))).alias("least"), *[F.sum(phred(i)).alias(f"q{i}") for i in (*tag, *after)])
    means = lambda at: F.array(*[F.col(f"q{i}") / F.col("n") for i in at])
    rows = sums.select("fam", "n", "least", means(tag).alias("tag"), means(after).alias("after"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    rows = rows.withColumns({"tag_mean": mean(F.col("tag")), "after_mean": mean(F.col("after"))})
    spread = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - F.col(f"{c}_mean")) * (x - F.col(f"{c}_mean")))
    df = len(tag) + len(after) - 2
    pooled = F.sqrt((spread("tag") + spread("after")) / df)
    gap = F.abs(F.col("tag_mean") - F.col("after_mean"))
    t = F.try_divide(gap, pooled * (1 / len(tag) + 1 / len(after)) ** 0.5) if len(tag) else F.lit(None).cast("double")
    p: Column = F.when(pooled == 0, F.when(gap == 0, 1.0).otherwise(0.0)).otherwise(st.student_p(t, df))
    able = (F.col("least") >= 50) & F.lit(len(tag) > 1 and stop + 25 <= 50)
    rows = rows.withColumn("p", F.when(able, p))
    call = (F.col("tag_mean") < F.col("after_mean")) & (F.col("p") < 1 / (5.0 * F.col("n") * F.col("n"))) & (F.array_min("tag") < F.col("after_mean") / 2)
    return rows.select("fam", "n", "p", F.coalesce(call, F.lit(False)).alias("heteroduplex"))
