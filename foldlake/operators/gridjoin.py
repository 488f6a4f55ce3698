"""Distance joins as equi-joins on grid cells.

Cells have the cutoff's edge. One side is placed in its own cell, the other in its cell and the 26 around it, so each
pair within the cutoff meets once, and no pair farther apart than two cells is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

POINT = ("x", "y", "z")


def _cells(edge: float, around: bool) -> list[Column]:
    at = [F.floor(F.col(c) / edge).cast("long") for c in POINT]
    if not around:
        return at
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(POINT, (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    return [F.transform(steps, lambda s: F.struct(*[(a + s[c]).alias(c) for a, c in zip(at, POINT, strict=True)]))]


def within(left: DataFrame, right: DataFrame, keys: list[str], cutoff: float, payload: tuple[list[str], list[str]]) -> DataFrame:
    """keys, a (struct of left's payload and point), b (the same of right), dist for all pairs of one key within ``cutoff``."""
    a = left.select(*keys, F.struct(*payload[0], *POINT).alias("a"), *[c.alias(f"_{n}") for c, n in zip(_cells(cutoff, False), POINT, strict=True)])
    b = right.select(*keys, F.struct(*payload[1], *POINT).alias("b"), F.explode(_cells(cutoff, True)[0]).alias("_c"))
    b = b.select(*keys, "b", *[F.col(f"_c.{c}").alias(f"_{c}") for c in POINT])
    j = a.join(b, [*keys, "_x", "_y", "_z"]).withColumn("dist", G.distance(G.point("a"), G.point("b")))
    return j.filter(F.col("dist") <= cutoff).select(*keys, "a", "b", "dist")
