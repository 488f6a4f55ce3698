"""Weights and reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kmer_index
from .broadcasts import checked


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) by integer arithmetic on keys and seed: the same wherever and however often it is computed."""
    h = F.lit(seed * 40503).cast("long")
    for k in keys:
        h = (h * 31 + k.cast("long") * F.lit(2654435761)) % F.lit(4294967296)
    return h / F.lit(4294967296.0)


def normalise(df: DataFrame, keys: list[str], weight: str, out: str = "prob") -> DataFrame:
    total = F.sum(weight).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return df.withColumn(out, F.col(weight) / total)


def restrict_sizes(sizes: DataFrame, present: DataFrame) -> DataFrame:
    """(size, prob) of the sizes that have hits, normalised anew."""
    return normalise(sizes.join(present.select("size").distinct(), "size", "left_semi"), [], "weight").select("size", "prob")


def custom_pattern(groups: list[tuple[int, int, str, float]]) -> str:
    """Text form of (start, end, ss, prob) groups."""
    return "|".join(f"{a}-{b} {ss} {p}" for a, b, ss, p in groups)


def parse_pattern(df: DataFrame, pattern: str) -> DataFrame:
    """res_id, ss, prob from texts of bar-separated groups ``start-end SS prob``; of a residue and label the later group wins."""
    g = df.select(F.posexplode(F.split(pattern, r"\|")).alias("i", "g"))
    p = F.split(F.trim("g"), r"\s+")
    ends = F.split(p[0], "-")
    rows = g.select("i", F.explode(F.sequence(ends[0].cast("int"), F.try_element_at(ends, F.lit(-1)).cast("int"))).alias("res_id"), p[1].alias("ss"), p[2].cast("double").alias("prob"))
    return rows.groupBy("res_id", "ss").agg(F.max_by("prob", "i").alias("prob"))


def merge_probabilities(base: DataFrame, over: DataFrame) -> DataFrame:
    b = base.withColumnRenamed("prob", "_b")
    return b.join(over, ["res_id", "ss"], "full_outer").select("res_id", "ss", F.coalesce("prob", "_b").alias("prob"))


def draw_fragments(draws: DataFrame, seq: str, sizes: DataFrame, index: kmer_index.KmerIndex, seed: int) -> DataFrame:
    """draw, pos, k, kmer, segment_id, start for each (draw, pos): a size by weight, cut at the sequence's end; if nothing
    is found, the next shorter size that has hits; among hits one at random, by its rank in the index.

    The index is read once for the numbers of places, and once for the blocks that drawn ranks fall into.
    """
    spark = draws.sparkSession
    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))
    high = F.sum("weight").over(Window.partitionBy(F.lit(0)).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)) / total
    s = checked(sizes.select("size", (high - F.col("weight") / total).alias("lo"), high.alias("hi")))  # a few sizes
    d = draws.withColumn("_u", uniform(seed, F.col("draw"), F.col("pos"))).join(s, (F.col("_u") >= F.col("lo") - 1e-12) & (F.col("_u") < F.col("hi") - 1e-12))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.col("size"), F.lit(len(seq)) - F.col("pos")))))
    d = d.withColumn("kmer", F.substring(F.lit(seq), F.col("pos") + 1, F.col("k"))).withColumn("code", F.conv(F.hex("kmer"), 16, 10).cast("long"))
    kmers = sorted({seq[i : i + k] for k in index.ks for i in range(len(seq) - k + 1)})
    counts = index.blocks(spark, kmers).groupBy("k", "code").agg(F.sum("n").alias("n"))
    longest = F.row_number().over(Window.partitionBy("draw", "pos").orderBy(F.desc("k")))
    d = d.join(checked(counts), ["k", "code"]).withColumn("_r", longest).filter("_r = 1")
    d = d.select("draw", "pos", "k", "kmer", "code", (F.floor(uniform(seed + 1, F.col("pos"), F.col("draw")) * F.col("n")) + 1).alias("nth"))
    return kmer_index.select(index, d, kmers).select("draw", "pos", "k", "kmer", "segment_id", "start")
