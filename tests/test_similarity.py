"""Similarity by matching blocks against the standard library's, and how few candidates are verified."""

import difflib
import random

import numpy as np
import pyarrow as pa
import pytest

from foldlake.operators import similarity as S


@pytest.mark.parametrize("letters", ["AB", "ACDEFGHIKLMNPQRSTVWY"])
def test_matching_letters(letters):
    rng = random.Random(1)
    for _ in range(150):
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(2))
        want = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert S.matching_letters(S._bytes(a), S._bytes(b)) == want


def test_best_of_many_is_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ACDEFG") for _ in range(n))
    queries = [word(rng.randrange(1, 40)) for _ in range(60)]
    chains = [(i, rng.choice(queries)[: rng.randrange(40)] + word(3)) for i in range(80)] + [(100, None), (101, ""), (102, queries[7]), (102, queries[7]), (None, "ACé")]
    df = spark.createDataFrame(chains, "chain int, fasta string").repartition(3)
    got = S.most_similar(df, spark.createDataFrame(list(enumerate(queries)), "q_idx int, query string")).collect()
    want = []
    for i, c in chains:
        c = (c or "").replace("é", "?")
        r = [difflib.SequenceMatcher(None, c, q, autojunk=False).ratio() for q in queries]
        want.append((i, int(np.argmax(r)), max(r)))
    assert sorted(((r["chain"], r["q_idx"], r["ratio"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["bound"] >= r["ratio"] for r in got)
    assert sum(r["verified"] for r in got if r["chain"] not in (100, 101)) < len(chains) * len(queries) / 4
    assert S.best_match(df, spark.createDataFrame([(0, queries[7])], "q_idx int, query string")).filter("chain = 102").count() == 0


def test_no_queries_and_too_many(spark, monkeypatch):
    df = spark.createDataFrame([(1, "AC")], "chain int, fasta string")
    none = spark.createDataFrame([], "q_idx int, query string")
    assert S.most_similar(df, none).count() == 0
    monkeypatch.setattr(S, "QUERIES", 1)
    with pytest.raises(ValueError, match="more than"):
        S.most_similar(df, spark.createDataFrame([(0, "A"), (1, "C")], "q_idx int, query string"))


def test_segments_by_the_standard_library(spark):
    from foldlake.plans import database_queries as Q
    from foldlake.plans import views as V

    rows = V.segments(spark, "/root/testdata/sf0.001").filter("length(fasta) < 3000").collect()
    got = {r["chain"]: (r["q_idx"], r["ratio"]) for r in Q.chain_match(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        every = [difflib.SequenceMatcher(None, r["fasta"], q).ratio() for q in Q.MATCHES]
        assert got[r["segment_id"]] == (int(np.argmax(every)), max(every))


def test_equal_texts_are_compared_once(spark, monkeypatch, tmp_path):
    log, plain = str(tmp_path / "log"), S.matching_letters

    def counted(a, b):
        with open(log, "a") as f:
            f.write("x")
        return plain(a, b)

    df = spark.createDataFrame([(i, "ACDE"[i % 4]) for i in range(30_000)] + [(-1, None)], "chain int, fasta string").coalesce(1)
    queries = spark.createDataFrame([(0, "AC"), (1, "DW")], "q_idx int, query string")
    want = S.most_similar(df, queries)
    assert {(r["chain"] % 4, r["q_idx"]) for r in want.collect() if r["chain"] >= 0} == {(0, 0), (1, 0), (2, 1), (3, 0)}
    calls = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: calls.append(f) or self)
    monkeypatch.setattr(S, "matching_letters", counted)
    S.most_similar(df, queries)
    batch = pa.RecordBatch.from_pydict({"chain": list(range(5000)), "fasta": ["ACDE"[i % 4] for i in range(5000)]})
    assert sum(b.num_rows for b in calls[0](iter([batch, batch]))) == 10_000
    assert len(open(log).read()) <= 8  # four texts, two queries
