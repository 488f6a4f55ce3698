"""Quantiles, slices, two-level numbers and parameter strings: ties, nulls, negative values, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.functions import residues as R
from foldlake.functions import tolerance
from foldlake.operators import database, islands, structures
from foldlake.operators.statistics import quantiles


@pytest.mark.parametrize("width", [0.001, 0.5, 100.0])
def test_quantiles(spark, width):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.uniform(-3, 3), -1.0, 0.0, 2.5, None])) for _ in range(400)] + [("one", -7.25), ("none", None)]
    wanted = {"low": 0.0, "q": 0.3, "mid": 0.5, "high": 1.0}
    got = {r.k: [r[n] for n in wanted] for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", wanted, width).collect()}
    for k in ("a", "b", None, "one"):
        values = [v for x, v in rows if x == k and v is not None]
        assert got[k] == pytest.approx([np.quantile(values, q) for q in wanted.values()])
    assert "none" not in got
    assert quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", wanted).count() == 0


def test_slices_follow_each_other(spark):
    rng = random.Random(2)
    rows = [(i, "A" * rng.randrange(1, 9)) for i in rng.sample(range(5000), 300)]
    got = {r.segment_id: (r.start, r.stop) for r in database.slices(spark.createDataFrame(rows, "segment_id long, aa string"), per=7).collect()}
    at = 0
    for i, aa in sorted(rows):
        assert got[i] == (at, at + len(aa))
        at += len(aa) + 1
    assert database.slices(spark.createDataFrame([], "segment_id long, aa string")).count() == 0


def test_ensembles_are_numbered_through(spark):
    parts = [spark.createDataFrame([(i,) for i in ids], "id int").withColumn("part", F.lit(p)) for p, ids in enumerate([range(0, 3000, 7), [5], range(100, 2500, 3)])]
    rows = structures.merge_ensembles(parts, "c", "id").collect()
    order = sorted(rows, key=lambda r: (r.part, r.id))
    assert [r.name for r in order] == [f"c_{i}" for i in range(1, len(order) + 1)]


def test_parameter_strings(spark):
    df = spark.createDataFrame([("a=1 b=x=y  a=2 flag c=",), ("",), (None,)], "t string").select(R.parameters(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [{"a": "2", "b": "x=y", "flag": None, "c": ""}, {}, None]


def test_pattern_windows(spark):
    df = spark.createDataFrame([(1, "HLLHTS T", "k"), (2, "HH", None), (3, None, None), (4, "", "")], "id int, text string, start string")
    got = islands.pattern_windows(df.withColumnRenamed("start", "other"), "text", "H[^E]{2}H|[TS ]+", 4).collect()
    assert sorted((r.id, r.other, r.start, r.stop) for r in got) == [(1, "k", 0, 4), (1, "k", 4, 8)]


def test_pattern_windows_of_a_long_text(spark):
    """The windows' texts together exceed what 32-bit offsets reach; every column still stands beside each window."""
    n = 60_000
    df = spark.createDataFrame([(1, n), (2, 2), (3, 5)], "id int, n int").select("id", F.repeat(F.lit("S"), F.col("n")).alias("text"))
    got = islands.pattern_windows(df, "text", "[TS ]+", 4).groupBy("id").agg(F.count("*"), F.min("start"), F.max("stop"), F.min(F.length("text")))
    assert sorted(map(tuple, got.collect())) == [(1, n - 3, 0, n, n), (3, 2, 0, 5, 5)]


def test_substitutes_are_the_matrix(spark):
    assert {(a, s, o) for a, s, o in tolerance.substitutes((5, 2))} == {(a, s, o) for a, row in tolerance.EDSS50.items() for s, letters in zip(tolerance.SCORES, row, strict=True) if s in (5, 2) for o in letters}
    table = tolerance.by_score((5, 3))
    assert {(r.aa, r.other) for r in tolerance.allowed_table(spark, table, "AFW").collect()} == {("A", "A"), ("F", "F"), ("F", "Y"), ("W", "W")}
