"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], width: float = 0.001) -> DataFrame:
    """keys and a column for each wanted quantile (0 to 1), interpolated between neighbours. Nulls are left out.

    Values are counted in cells of ``width`` first; only the cells that hold a wanted rank are looked into, where equal
    values count together. So no task sees all values of a group, though a group may be the whole table.
    """
    on = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    d = df.select(*keys, *on, F.col(value).cast("double").alias("_v")).filter("_v is not null").withColumn("_cell", F.floor(F.col("_v") / width))
    cells = d.groupBy(*ks, "_cell").agg(F.count(F.lit(1)).alias("_c"), *[F.first(k).alias(k) for k in keys])
    cells = cells.withColumn("_end", F.sum("_c").over(Window.partitionBy(*ks).orderBy("_cell"))).withColumn("_begin", F.col("_end") - F.col("_c"))
    sizes = cells.groupBy(*ks).agg(F.sum("_c").alias("_n"), *[F.first(k).alias(k) for k in keys])
    ranks = []
    for name, q in wanted.items():
        place = F.lit(float(q)) * (F.col("_n") - 1)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            ranks.append(F.struct(F.lit(f"{name}_{side}").alias("part"), rank.alias("rank"), (place - F.floor(place)).alias("share")))
    asked = sizes.select(*ks, F.explode(F.array(*ranks)).alias("_r")).select(*ks, "_r.*")
    at = asked.join(cells.select(*ks, "_cell", "_begin", "_end"), ks).filter((F.col("rank") >= F.col("_begin")) & (F.col("rank") < F.col("_end")))
    at = at.select(*ks, "_cell", "part", "share", (F.col("rank") - F.col("_begin")).alias("at"))
    inside = d.join(at.select(*ks, "_cell").distinct(), [*ks, "_cell"], "left_semi").groupBy(*ks, "_cell", "_v").agg(F.count(F.lit(1)).alias("_m"))
    inside = inside.withColumn("_to", F.sum("_m").over(Window.partitionBy(*ks, "_cell").orderBy("_v")))
    found = at.join(inside, [*ks, "_cell"]).filter((F.col("at") < F.col("_to")) & (F.col("at") >= F.col("_to") - F.col("_m")))
    value_of = lambda part: F.max(F.when(F.col("part") == part, F.col("_v")))
    share_of = lambda part: F.max(F.when(F.col("part") == part, F.col("share")))
    between = [(value_of(f"{n}_low") + (value_of(f"{n}_high") - value_of(f"{n}_low")) * share_of(f"{n}_low")).alias(n) for n in wanted]
    return sizes.select(*ks, *keys).join(found.groupBy(*ks).agg(*between), ks).select(*keys, *wanted)


def multisets(df: DataFrame, keys: list[str], value: str, decimals: int = 4, width: int = 1024) -> DataFrame:
    """keys, chunk, n, entries: the rounded values of each group as (value, n), in chunks by ranges of ``width`` steps of the
    last decimal. A chunk holds at most ``width`` entries, however many values it stands for, and chunks of further data
    merge with it by key and chunk. Nulls are left out."""
    step = F.round(F.col(value) * 10**decimals).cast("long")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, step.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return _chunks(counts, keys, decimals, width)


def _chunks(counts: DataFrame, keys: list[str], decimals: int, width: int) -> DataFrame:
    entry = F.struct((F.col("_s") / 10**decimals).alias("value"), F.col("_n").alias("n"))
    return counts.groupBy(*keys, F.floor(F.col("_s") / width).alias("chunk")).agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(entry)).alias("entries"))


def merge_multisets(one: DataFrame, two: DataFrame, keys: list[str], decimals: int = 4, width: int = 1024) -> DataFrame:
    """The multisets of both."""
    every = one.unionByName(two).select(*keys, F.explode("entries").alias("_e"))
    counts = every.groupBy(*keys, F.round(F.col("_e.value") * 10**decimals).cast("long").alias("_s")).agg(F.sum("_e.n").alias("_n"))
    return _chunks(counts, keys, decimals, width)
