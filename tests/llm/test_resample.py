"""Resampling: Arrow n-grams and CRCs against plain ones, ranges against a plain sort, odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldlake.llm import resample as R

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


ODD = ["", None, "...", "One", "one two", "Ünï CÖde \x00 straße　x a'b 7", "a " * 500, "ab-cd_ef", "x" * 5000 + " y" + "z" * 3000, " lead and trail ", "a b a b a"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_are_the_plain_ones(n):
    f = R.Features(pa.array(ODD, pa.string()), n, 997)
    plain = [[zlib.crc32(g.encode()) % 997 for g in features(t, n)] for t in ODD]
    assert f.words.tolist() == [len(words(t)) for t in ODD]
    assert f.counts(997).tolist() == [Counter(x for p in plain for x in p)[b] for b in range(997)]
    gains = np.arange(997) * 7 - 1000
    size, total = f.sums(gains)
    assert size.tolist() == [len(p) for p in plain]
    assert total.tolist() == [sum(int(gains[b]) for b in p) for p in plain]


def test_no_text_at_all():
    f = R.Features(pa.array([None, ""], pa.string()), 2, 10)
    assert f.counts(10).sum() == 0 and f.sums(np.ones(10, "i8"))[0].tolist() == [0, 0]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 50])
def test_resampling_in_plain_loops(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(R, "SLICE", slice_bytes)
    monkeypatch.setattr(R, "RANGE", 7)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd EF g7 hij k".split()) for _ in range(rng.randrange(0, 50))) for _ in range(60)]
    rows = [*enumerate([*texts, *ODD]), (None, texts[1]), (None, None), *[(500, texts[5] + " and more of it" * 6)] * 9]
    target = ["ab ab cd", None, "", "Ef g7 " * 20]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("score", F.lit("own")).withColumn("rank", F.lit(0)).repartition(4)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(docs, items, keep={"doc_id": F.col("doc_id"), "own": F.col("score")}, buckets=100, percent=50).collect()
    s, t = Counter(zlib.crc32(g.encode()) % 100 for _, x in rows for g in features(x, 2)), Counter(zlib.crc32(g.encode()) % 100 for x in target for g in features(x, 2))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 100) / ((s[b] + 1) * (t.total() + 100)))) for b in range(100)]
    want = []
    for i, x in rows:
        g = [gain[zlib.crc32(f.encode()) % 100] for f in features(x, 2)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20])
    able = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    ranks = Counter((*map(str, w[:4]), r if r <= len(able) * 50 // 100 else None) for r, w in enumerate(able, 1))
    ranks += Counter((*map(str, w[:4]), None) for w in want if not w[4])
    assert Counter((*map(str, r[0:1] + r[2:5]), r["rank"]) for r in got) == ranks
    assert {r["own"] for r in got} == {"own"}


def test_nothing_to_draw(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    keep = {"doc_id": F.col("doc_id")}
    assert {r["rank"] for r in R.resample(docs, docs.limit(0), keep=keep).collect()} == {None}
    assert R.resample(docs.limit(0), docs, keep=keep).count() == 0


def test_ranks_of_rows_that_are_all_alike(spark):
    rows = R.cut(spark.range(1000).select(F.lit(5).alias("score"), F.lit(1).alias("id")))
    got = R.ranked(rows, [F.desc("score"), F.col("id")], "place", per_range=50)
    assert sorted(r["place"] for r in got.collect()) == list(range(1, 1001))
