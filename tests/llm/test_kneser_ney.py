"""The language model against the textbook's formulas in plain dictionaries; that it sums to one; odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.llm import kneser_ney as K


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Plain:
    def __init__(self, texts, order):
        self.order = order
        raw = {k: Counter() for k in range(1, order + 1)}
        for t in texts:
            seq = ["<s>"] * (order - 1) + words(t) + ["</s>"]
            for i in range(order - 1, len(seq)):
                for k in raw:
                    raw[k][tuple(seq[i - k + 1 : i + 1])] += 1
        self.raw, self.count = raw[1], {order: raw[order]}
        for k in range(order - 1, 0, -1):
            before = defaultdict(set)
            for g in raw[k + 1]:
                before[g[1:]].add(g[0])
            self.count[k] = Counter({g: raw[k][g] if k > 1 and g[0] == "<s>" else len(b) for g, b in before.items()})
        self.d = {}
        for k, c in self.count.items():
            n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
            self.d[k] = (0.5, 1.0, 1.5)
            if all(n):
                y = n[0] / (n[0] + 2 * n[1])
                d = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
                if all(0 <= x <= i for i, x in enumerate(d, 1)):
                    self.d[k] = d
        self.by = {k: defaultdict(list) for k in self.count}
        for k, c in self.count.items():
            for g, n in c.items():
                self.by[k][g[:-1]].append(n)

    def p(self, g):
        k = len(g)
        lower = self.p(g[1:]) if k > 1 else 1 / (len(self.count[1]) + 1)
        counts = self.by[k].get(g[:-1])
        if not counts:
            return lower
        d = (0, *self.d[k])
        n = self.count[k].get(g, 0)
        return (n - d[min(n, 3)] + sum(d[min(c, 3)] for c in counts) * lower) / sum(counts)

    def score(self, text):
        seq = ["<s>"] * (self.order - 1) + words(text) + ["</s>"]
        return sum(math.log10(self.p(tuple(seq[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(seq)))


def corpus(n, seed, vocabulary=60):
    rng = random.Random(seed)
    return [" ".join(f"w{min(int(rng.expovariate(0.1)), vocabulary)}" for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("order", "counted", "shard"), [(1, 1 << 20, 1 << 20), (2, 1 << 20, 1 << 20), (2, 50, 100), (3, 50, 300)])
def test_model_is_the_textbooks(spark, monkeypatch, order, counted, shard):
    monkeypatch.setattr(K, "COUNTED", counted)
    monkeypatch.setattr(K, "SHARD_BYTES", shard)
    texts = [*corpus(120, 1), "A a A b \x0b\x1c x", None, "", *["same again and again"] * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    model, plain = K.fit(df, order=order), Plain(texts, order)
    assert model.tokens == sum(plain.raw.values()) and model.known == len(plain.raw)
    asked = [*texts[:30], *corpus(30, 2, 90), "never seen", None, "", "same again and"]
    odd = spark.createDataFrame(list(enumerate(asked)), "score int, text string").withColumn("kept", F.lit(1))
    rows = sorted(K.score(odd, model, keep={"i": F.col("score"), "kept": F.col("kept")}).collect())
    assert len(rows) == len(asked)
    v, n = len(plain.raw), sum(plain.raw.values())
    for r, text in zip(rows, asked, strict=True):
        w = [*words(text), "</s>"]
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum((x,) in plain.raw for x in w))
        assert r["base_score"] == pytest.approx(sum(math.log10((plain.raw[(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r["score"] == pytest.approx(plain.score(text), rel=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_probabilities_sum_to_one(spark):
    texts = corpus(80, 5)
    model = K.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    every = sorted({w for t in texts for w in words(t)})
    for before in (["w1", "w2"], ["w3", "nowhere"], []):
        total = 0.0
        for w in [*every, "unknown"]:
            seq, at = K.sequence([K.Words(" ".join([*before, w]), K.TABLE).hashes], 3)
            total += K.probabilities(seq, at[len(before) : len(before) + 1], model)[0][0]
        seq, at = K.sequence([K.Words(" ".join(before), K.TABLE).hashes], 3)
        total += K.probabilities(seq, at[len(before) :], model)[0][0]
        assert total == pytest.approx(1)


def test_read_into_memory_and_nothing_to_learn(spark):
    df = spark.createDataFrame([(t,) for t in corpus(40, 7)], "text string")
    model = K.fit(df)
    keys = np.sort(K.mixed(K.grams(*K.sequence([K.Words("w1 w2 w3", K.TABLE).hashes], 2), 1)))
    mapped = model.find("g1", keys, 2)
    assert mapped[1].min() > 0
    assert (K._loaded(f"{model.folder}/g1/0", 2).find(keys) == mapped).all()
    none = K.score(df.limit(3), K.fit(df.limit(0)), keep={}).collect()
    assert [(r["n_known"], r["base_score"], r["score"]) for r in none] == [(0, 0.0, 0.0)] * 3
    assert K.score(df.limit(0), model, keep={}).count() == 0


def test_held_out_documents_are_likelier_than_under_single_words(spark):
    from foldlake.llm import queries

    rows = queries.QUERIES["op12_lm_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
