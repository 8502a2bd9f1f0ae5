"""Column functions of statistics and hashes. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Start and factor of the 32-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 0x811C9DC5, 0x01000193


def series(df: int) -> list[float]:
    """Coefficients of the finite series in cos^2 that the Student distribution has for whole degrees of freedom."""
    first = 3 if df % 2 else 2
    out, c = [], 1.0
    for k in range((df - first) // 2 + 1 if df >= first else 0):
        out.append(c)
        c *= (2 * k + 2) / (2 * k + 3) if df % 2 else (2 * k + 1) / (2 * k + 2)
    return out


def student_p(t: Column, df: int) -> Column:
    """Two-sided probability of |t| or more; exact to about 1e-15, so smaller ones come out as 0."""
    cos2 = df / (df + t * t)
    sine = F.abs(t) / F.sqrt(df + t * t)
    total = F.lit(0.0)
    for c in reversed(series(df)):
        total = total * cos2 + c
    inner = sine * total if df % 2 == 0 else (F.atan(F.abs(t) / df**0.5) + sine * F.sqrt(cos2) * total) * (2 / 3.141592653589793)
    return F.greatest(1 - inner, F.lit(0.0))


def fnv32(text: Column, ordinal: Column) -> Column:
    """FNV-1a hash of a text of ASCII letters with a seed; 1 instead of 0."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.lit(FNV_START).cast("long").bitwiseXOR(ordinal.cast("long"))
    value = F.aggregate(codes, start, lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_FACTOR).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.greatest(value, F.lit(1).cast("long"))


def best_segment(scores: Column) -> Column:
    """The largest sum of neighbouring scores, 1 at least."""
    zero = F.lit(0).cast("long")
    step = lambda s, x: F.struct(F.greatest(s["run"] + x, zero).alias("run"), F.greatest(s["best"], s["run"] + x).alias("best"))
    return F.aggregate(scores, F.struct(zero.alias("run"), F.lit(1).cast("long").alias("best")), step)["best"]
