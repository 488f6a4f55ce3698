"""Classifiers: held-out accuracy on invented data, odd input, and that labels of held-out rows are never read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.llm import language_id, quality, toxicity
from foldlake.llm.common import remainder

SYLLABLES = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schu", "berg", "lich", "ung"], "cc": ["eau", "oi", "ette", "qué"]}


def _text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        t, good, toxic = _text(rng, lang), 1, 0
        if rng.random() < 0.25:
            t, good = " | ".join(w.upper() + "!!" for w in t.split()), 0
        elif rng.random() < 0.3:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgish", "zorger", "blegtum", "blegtar"]))
            t, toxic = " ".join(w), 1
        rows.append((i, t, lang, "s", len(t), 9))
        labels.append((i, good, toxic))
    odd = [(1000, None, "aa", None, None, None), (1001, "", "aa", None, None, None), (1002, "123 !!", None, None, None, None), (None, _text(rng, "aa"), "aa", "s", 5, 1), (3, rows[3][1], "aa", "s", 5, 1), (1003, "ka " * 100_000, "aa", "s", 5, 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long, score int")
    return docs.cache(), spark.createDataFrame([*labels, (None, 1, 1), (1000, None, None), (3, labels[3][1], labels[3][2])], "doc_id long, quality int, toxic int").cache(), {i: (g, t) for i, g, t in labels}, {r[0]: r[2] for r in rows}


def test_language(corpus):
    docs, _, _, langs = corpus
    s = language_id.Settings(per_lang=150, epochs=6)
    rest = remainder(F.col("doc_id"), 5)
    model = language_id.fit(docs.filter(rest != 0), settings=s)
    got = language_id.predict(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": rest == 0}, settings=s).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in langs]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    assert language_id.predict(docs.filter("doc_id = 3"), language_id.fit(docs.filter("doc_id < 0"))).first().lang_pred == "und"


def test_subwords_stay_in_words():
    s = language_id.Settings()
    one = {b for w in ("ab", "cde") for b in language_id.subwords(w, s)[0].tolist()}
    assert set(language_id.subwords("AB  cde", s)[0].tolist()) == one


def test_quality(corpus):
    docs, labels, truth, _ = corpus
    s = quality.Settings(sample=400)
    rest = remainder(F.col("doc_id"), 4)
    model = quality.fit(docs, labels.filter(rest != 2), settings=s)
    got = quality.score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": rest == 2}).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in held]) > 0.95
    none = quality.fit(docs, labels.filter("doc_id < 0"))
    assert quality.score(docs.limit(3), none).first().score == 0.5
    assert quality.score(docs.filter("doc_id < 0"), model).collect() == []


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    s = quality.Settings(buckets=16, rank=3)
    m = quality.Model(np.zeros(len(quality.FORM)), np.ones(len(quality.FORM)), 0.3, rng.normal(size=30), rng.normal(size=(30, 3)), settings=s)
    i, x = np.array([1, 4, 7, 20]), np.array([0.5, -1.0, 2.0, 0.25])
    pairs = sum(m.factors[a] @ m.factors[b] * x[j] * x[k] for j, a in enumerate(i) for k, b in enumerate(i) if j < k)
    assert abs(m.margin(i, x) - (0.3 + x @ m.weights[i] + pairs)) < 1e-9


def test_toxicity(corpus):
    docs, labels, truth, _ = corpus
    rest = remainder(F.col("doc_id"), 5)
    model = toxicity.fit(docs, labels.filter(rest != 0), F.coalesce(rest != 0, F.lit(False)))
    got = toxicity.score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": rest == 0}).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[1000].predicted == by[1001].predicted == 0
    blank = toxicity.fit(docs, labels.filter("doc_id < 0"), F.lit(True))
    assert {r.predicted for r in toxicity.score(docs, blank).collect()} == {0}


def test_label_model_recovers_rates():
    rng = np.random.default_rng(1)
    s = toxicity.Settings(voters=6)
    y = rng.random(40_000) < 0.15
    f1, f0 = np.array([0.5, 0.4, 0.45, 0.3, 0.5, 0.35]), np.full(6, 0.002)
    v = rng.random((len(y), 6)) < np.where(y[:, None], f1, f0)
    masks, counts = np.unique(v @ (1 << np.arange(6)), return_counts=True)
    m = toxicity.fit_label_model(masks, counts, s, np.full(6, 0.02))
    p = dict(zip(masks, m.posterior(masks), strict=True))
    fired = v.any(1)
    assert np.mean((np.array([p[x] for x in (v @ (1 << np.arange(6)))[fired]]) > 0.5) == y[fired]) > 0.92
    assert (m.fires[1] > 10 * m.fires[0]).all()


def test_held_out_labels_are_not_read(corpus):
    docs, labels, _, _ = corpus
    rest = remainder(F.col("doc_id"), 4)
    flipped = labels.withColumn("quality", F.when(rest == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x.filter(rest != 2), settings=quality.Settings(sample=200, epochs=1)) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights)


def test_empty_tables(spark, corpus):
    docs, labels, _, _ = corpus
    none = docs.filter("doc_id < 0")
    assert toxicity.score(none, toxicity.fit(none, labels.filter("doc_id < 0"), F.lit(True))).collect() == []
    assert language_id.predict(none, language_id.fit(none)).collect() == []


def test_kept_names_may_clash(corpus):
    docs, labels, _, _ = corpus
    names = ("text", "length", "kept", "_text", "__text", "__length", "c0")
    keep, some = {n: F.lit(i) for i, n in enumerate(names)}, docs.limit(2)
    for got in (quality.score(some, quality.fit(none := docs.filter("doc_id < 0"), labels.limit(0)), keep=keep), toxicity.score(some, toxicity.fit(none, labels.limit(0), F.lit(True)), keep=keep), language_id.predict(some, language_id.fit(none), keep=keep)):
        assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(range(len(names)))}


def test_predictions_are_the_plain_ones(corpus):
    """Scores in tasks are those of the model row by row; equal probabilities go to the first language."""
    docs, _, _, _ = corpus
    s = language_id.Settings(per_lang=50, epochs=2)
    model = language_id.fit(docs, settings=s)
    got = sorted(((r.t, r.lang_pred, round(r.score, 9)) for r in language_id.predict(docs, model, keep={"t": F.col("text")}, settings=s).collect()), key=str)
    assert got == sorted(((r.text, c[0], round(c[1], 9)) for r in docs.collect() if (c := language_id.classify(r.text, model, s))), key=str)
    flat = language_id.Model(["aa", "bb"], np.zeros((s.buckets, s.dim), "f4"), np.zeros((2, s.dim)), np.zeros(2), 1.0, 0.0)
    assert language_id.classify("some text", flat, s)[0] == "aa"


def test_toxicity_scores_in_plain_loops(spark):
    """Every document of a whole table: the classifier's sum over a text's words and beginnings, one by one."""
    import math
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rest = remainder(F.col("doc_id"), 5)
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter(rest != 0), rest != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, keep={"doc_id": F.col("doc_id")}).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and model.classifier.weights
    for r in rows:
        held = set()
        for word in (r.text or "").lower().split():
            word = word.strip(".,;:!?\"'()[]<>|*&%$#-")
            if word:
                for item in [word, *[word[:n] + "*" for n in (4, 5, 6, 7, 8) if len(word) >= n]]:
                    held.add(zlib.crc32(item.encode()) - 2**31)
        margin = model.classifier.bias + sum(model.classifier.weights.get(h, 0.0) for h in held)
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-min(max(margin, -30), 30)))) < 1e-9


def test_label_model_posterior_in_plain_loops():
    import math

    rng = np.random.default_rng(2)
    m, s = 5, toxicity.Settings(voters=5, clean=2)
    y = rng.random(30_000) < 0.2
    one, zero = np.array([0.4, 0.5, 0.3, 0.02, 0.05]), np.array([0.01, 0.005, 0.02, 0.4, 0.3])
    v = rng.random((len(y), m)) < np.where(y[:, None], one, zero)
    masks, counts = np.unique(v @ (1 << np.arange(m)), return_counts=True)
    model = toxicity.fit_label_model(masks, counts, s, np.array([0.05, 0.05, 0.1, 0.05, 0.1]))
    assert np.abs(model.fires[1] - one).max() < 0.06 and np.abs(model.fires[0] - zero).max() < 0.06 and abs(model.prior - 0.2) < 0.03
    for mask, p in zip(masks.tolist(), model.posterior(masks).tolist(), strict=True):
        votes = [mask >> j & 1 for j in range(m)]
        z = math.log(model.prior / (1 - model.prior))
        for j in range(m):
            f1, f0 = model.fires[1][j], model.fires[0][j]
            said = math.log(f1 / f0) if votes[j] else math.log((1 - f1) / (1 - f0))
            z += said / (1 + sum(max(model.excess[j][k], 0) for k in range(m) if votes[k] == votes[j]))
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_beats_the_common_answer(spark):
    from foldlake.llm import queries

    rows = queries.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("toxic is not null").collect()
    right, common = sum(r.predicted == r.toxic for r in rows), sum(r.toxic == 0 for r in rows)
    assert right > common and sum(r.predicted and not r.toxic for r in rows) <= len(rows) / 50
