"""Interval statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.patterns import Z_95


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null when the denominator is 0."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def wilson(k: Column, n: Column, z: float = Z_95) -> Column:
    """Wilson score interval clamped to [0, 1]; null unless 0 <= k <= n and n > 0."""
    total = n.cast("double")
    p = k.cast("double") / total
    z2 = z * z
    center = p + z2 / (2 * total)
    margin = z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total))
    denom = 1 + z2 / total
    return F.when(
        (n > 0) & (k >= 0) & (k <= n),
        F.struct(
            F.greatest(F.lit(0.0), (center - margin) / denom).alias("lo"),
            F.least(F.lit(1.0), (center + margin) / denom).alias("hi"),
        ),
    )


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z_95) -> Column:
    """Newcombe interval of p1 - p2 built from both Wilson intervals, with an overlap flag."""
    a, b = wilson(k1, n1, z), wilson(k2, n2, z)
    p1, p2 = k1.cast("double") / n1.cast("double"), k2.cast("double") / n2.cast("double")
    diff = p1 - p2
    lo = diff - F.sqrt(F.pow(p1 - a["lo"], 2) + F.pow(b["hi"] - p2, 2))
    hi = diff + F.sqrt(F.pow(a["hi"] - p1, 2) + F.pow(p2 - b["lo"], 2))
    return F.when(
        a.isNotNull() & b.isNotNull(),
        F.struct(
            p1.alias("p1"),
            p2.alias("p2"),
            diff.alias("diff"),
            lo.alias("lo"),
            hi.alias("hi"),
            ((a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])).alias("overlap"),
        ),
    )
