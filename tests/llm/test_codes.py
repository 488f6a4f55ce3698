"""Vector codes: the walk over two trees against plain integer distances, odd vectors, and the whole job in plain loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.llm import codes


@pytest.mark.parametrize(("n", "w", "k", "most"), [(1, 1, 1, 3), (5, 2, 3, 2), (17, 1, 5, 1), (1000, 4, 64, 6), (4000, 4, 61, 256), (300, 3, 7, 2)])
def test_walk_is_the_plain_minimum(n, w, k, most):
    rng = np.random.default_rng(n)
    x, book = rng.integers(-most, most + 1, (n, w)), rng.integers(-most, most + 1, (k, w))  # few values: many ties
    t = codes._unpack(codes._pack(x, 1)[0], n, w)
    code, count, sums, exact = codes.nearest(t, book)
    want = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (code == want[t.order]).all()
    assert (count == np.bincount(want, minlength=k)).all()
    plain = np.zeros_like(book)
    np.add.at(plain, want, x)
    assert (sums == plain).all()
    if n >= 1000:
        assert exact < n * k / 2


def plain(rows, scale, parts, entries, rounds):
    """rows: (id, vector)."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v in kept), default=0) // parts)) * parts
    kept = [(i, v, v + [0] * (width - len(v))) for i, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min(range(len(b)), key=lambda e: (sum((x - y) ** 2 for x, y in zip(part, b[e], strict=True)), e)) for part, b in zip(c, books, strict=True)] for c in cut]

    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, code, strict=True) if k[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    code = assign()
    error = [sum(sum((x - y) ** 2 for x, y in zip(c[p], books[p][k[p]], strict=True)) for p in range(parts)) for c, k in zip(cut, code, strict=True)]
    flat = [x for b in books for e in b for x in e]
    return sorted((i, tuple(k), x) for (i, _, _), k, x in zip(kept, code, error, strict=True) if i is not None), hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


@pytest.mark.parametrize("block", [16_384, 7])
def test_odd_vectors_in_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=rng.integers(5, 12)).round(1).tolist()) for i in range(60)]
    rows += [(3, rows[3][1]), (5, [0.1]), (70, None), (71, [1.0, None]), (72, [float("nan")] * 8), (73, [float("inf")] * 8), (74, []), (None, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>").withColumn("error", F.lit("x")).withColumn("kept", F.lit(1)).repartition(3)
    got = codes.compress(df, keep={"vec_id": F.col("vec_id"), "kept": F.col("kept")}, scale=8, parts=4, entries=5)
    want, digest = plain(rows, 8, 4, 5, 2)
    out = got.rows.collect()
    assert sorted((r["vec_id"], tuple(r["code"]), r["error"]) for r in out if r["vec_id"] is not None) == want
    assert got.digest() == digest
    assert len(out) == len(want) + 1  # the row without an id


def test_fewer_vectors_than_entries_and_none(spark):
    df = spark.createDataFrame([(2, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id int, embedding array<float>")
    got = codes.compress(df, keep={"vec_id": F.col("vec_id")}, parts=2)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got.rows.collect()) == [(1, [0, 0], 0), (2, [0, 0], 0)]
    none = codes.compress(df.filter("vec_id > 9"), keep={"vec_id": F.col("vec_id")})
    assert none.rows.columns == ["vec_id", "code", "error"] and none.rows.count() == 0


def test_label_sums_take_nulls_together(spark):
    df = spark.createDataFrame([(1, None, 3), (2, None, 4), (3, 7, 5)], "vec_id int, label int, error long")
    assert sorted((r["vec_id"], r["total"]) for r in codes.with_group_sum(df, "label", "error", "total").collect()) == [(1, 7), (2, 7), (3, 5)]
