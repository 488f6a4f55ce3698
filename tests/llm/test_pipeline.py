"""The pipeline's stages against plain versions, and odd rows."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from foldlake.llm import pii, quality
from foldlake.llm.common import remainder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, _t int, _row int, predicted int"


@pytest.fixture(scope="module")
def odd(spark):
    t = "This is a plain sentence of many words that goes on for quite a while and then it ends."
    rows = [(1, t, "en", "s", 9, "x", 1, 2, 3), (2, t, "en", "s", 9, "x", 1, 2, 3), (2, t, "en", "s", 9, "x", 1, 2, 3), (3, t + " Really.", "en", "s", 9, "x", 1, 2, 3), (None, t, "en", "s", 9, "x", 1, 2, 3), (4, None, "en", "s", None, None, None, None, None), (5, "", "en", "s", 0, "x", 1, 2, 3),
            (6, "Write to me@here.org about all the other things we never talked about in the long years.", "en", "s", 9, "x", 1, 2, 3), (None, "A row without an id that nothing else resembles at all here.", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF)
    if k < 4:
        assert out.columns == odd.columns
    out.collect()
    empty = stage(spark, odd.filter("doc_id > 100"), SF)
    assert empty.collect() == []


def test_one_of_each_group_stays(spark, odd):
    got = corpus_pipeline.near_duplicates(spark, odd, SF).collect()
    assert sorted((r.doc_id or 0, bool(r.text)) for r in got) == [(0, True), (1, True), (4, False), (5, False), (6, True)]


def test_personal_data_goes(spark, odd):
    got = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, odd, SF).collect()}
    assert "me@here.org" not in got[6].text and got[6].n_chars == len(got[6].text) and got[4].text is None


def test_near_duplicates_are_the_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.filter("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("text", F.concat("text", F.lit(" One more.")))
    docs = docs.unionByName(copies)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {}
    for i, t in rows:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted(i for i in sets if find(i) == i)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()) == want
    assert len(want) < len(sets)


def test_contaminated_documents_are_the_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)} if len(w) >= 13 else {tuple(w)} - {()}
    sizes, want = {len(x) for x in windows}, set()
    for r in docs.collect():
        w, hit = words(r.text), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit.update(range(a, a + k))
        if not hit or 20 * len(hit) < len(w):
            want.add(r.doc_id)
    assert {r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, SF).collect()} == want


def test_stages_keep_their_operators_judgement(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(remainder(F.col("doc_id"), 4) != 2)
    model = quality.fit(docs, labels)
    want = {r.doc_id for r in docs.collect() if model.score(*quality.inputs(r.text, float(r.n_chars), model.settings.buckets)) >= 0.7}
    assert {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, SF).collect()} == want
    clean = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs, SF).collect()}
    left = spark.createDataFrame(list(clean.items()), "doc_id long, text string")
    assert pii.find_pii(left).filter("n_email + n_ip + n_card + n_phone > 0").collect() == []


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids < {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 100
    low = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("quality = 0")
    assert len(ids & {r.doc_id for r in low.collect()}) <= 0.1 * low.count()
    assert out.filter(F.col("length") > 2048).count() == 0
