"""Near duplicates, decontamination, packing and search against brute force, with odd input."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldlake.llm import decontaminate, jaccard, packing, topk
from foldlake.llm.op7_query import op7_decontamination

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n long, cid string"


def _texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 3)))
    base = [[word() for _ in range(rng.randint(20, 90))] for _ in range(12)]
    out = []
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w).replace(" ", "\n", 1))
    out += [base_text.upper() for base_text in out[:5]] + ["one", "ONE", "one two", "one  two", "Éa b c", "éa b c", "", " \n\t", None, "a\xa0b c", "z " * 400]
    return out


def _groups(texts, n, num):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_jaccard_is_brute_force(spark, n, num):
    texts = _texts()
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, n=n, num=num, den=100).collect()}
    assert got == {i: e for i, e in enumerate(_groups(texts, n, num))}


@pytest.mark.parametrize("marks", [0, 20])
def test_few_tokens_of_one_class_are_moved(spark, monkeypatch, marks):
    """Where shared tokens are too many for a broadcast, most others don't reach the join; a bitmap too small loses no link."""
    texts, moved, inner = _texts(), [], jaccard._marked
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], DOCS)

    def marked(tokens, often):
        out = inner(tokens, often)
        moved.append((tokens.count(), out.count(), tokens.join(often, "h", "left_semi").count(), out.join(often, "h", "left_semi").count()))
        return out

    monkeypatch.setattr(jaccard, "_marked", marked)
    monkeypatch.setattr(jaccard, "ROWS", 0)
    monkeypatch.setattr(jaccard, "MARKS", marks)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, n=5, num=80, den=100).collect()}
    assert got == {i: e for i, e in enumerate(_groups(texts, 5, 80))}
    [(every, out, shared, kept)] = moved
    assert shared == kept and (not marks or out - shared < 0.3 * (every - shared))


def test_workers_drop_what_other_operators_remember(monkeypatch):
    from foldlake.llm import common, quality

    packing.WordEncoder.of(public_tokenizers.path("word_bpe_49k.json")).encode(["some words"])
    with common.worker_of("packing"):
        assert packing._loaded
    quality.bucket("word", 8)
    assert list(common.work_of("quality")(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3]
    assert not packing._loaded and quality._known


def test_a_large_group_makes_few_candidates(spark, monkeypatch):
    """500 near copies of one text, among them pairs that no pivot links: far fewer candidates than pairs, whole components."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(80)) for _ in range(100)] + [" ".join(base * 260)]
    made, inner = [], jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda *a: made.append(out := inner(*a)) or out)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(_groups(texts, 5, 80)))
    assert sum(df.count() for df in made) < 500 * 499 / 2 / 4


def _copies(m):
    """Near copies of one text, of which about three pairs in four are linked; those of the least ids are the farthest off."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, out = [word() for _ in range(200)], []
    for i in range(m):
        w = list(base)
        for _ in range(3 if i < m // 10 else rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out


def test_candidates_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    made, sums, inner = [], [], jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda *a: made.append(out := inner(*a)) or out)
    for m in (100, 400):
        made.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(list(enumerate(_copies(m))), "doc_id long, text string")).collect()}
        assert got == dict(enumerate(_groups(_copies(m), 5, 80)))
        sums.append(sum(df.count() for df in made))
    assert sums[1] < 8 * sums[0] and sums[1] < 16 * 400


@pytest.mark.parametrize("block", [1024, 4])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COLUMNS", 16 * block)
    texts = _texts() + _texts()[:9]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.n_links for r in jaccard.similar_groups(df, n=3, num=60, den=100, count_links=True).collect()}
    sets = [set(jaccard.shingles(t, 3).tolist()) for t in texts]
    linked = lambda a, b: a and b and 100 * len(a & b) >= 60 * len(a | b)
    assert got == {i: sum(bool(linked(a, b)) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    assert max(got.values()) > 4


def test_jaccard_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "A b c d e f"), (None, "a b c d e f"), (None, "only this text here now"), (7, None), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, 5), (None, 1, None), (7, 0, 7), (None, 0, None)], key=str)
    assert jaccard.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 99), (99, 98), (205, 200), (205, 201)]
    got = {r.row: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 98: 98, 99: 98, 100: 98, 200: 200, 201: 200, 205: 200}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return WORD.findall((t or "").translate(LOW))


def test_winnowing_is_brute_force(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "b", "gamma", "delta", "é", "zeta9", "x" * 300])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 13, 14, 12, 5, 1, 0, 30])] + [(99, None), (None, "unnamed item of fewer words"), (3, "second text under a used id")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        s = _words(rng.choice(items)[1])
        a = rng.randint(0, max(0, len(s) - 1))
        docs.append((i, "; ".join(w[:20] + s[a : a + rng.randint(1, 40)] + w[20:]), i, "x"))
    docs += [(200, None, 0, "x"), (201, "", 0, "x"), (None, items[0][1].upper(), 0, "x"), (5, docs[5][1], 0, "x"), (202, "Unnamed, item of fewer words!", 0, "x"), (203, "b " * 12_000 + items[0][1] + " é" * 9_000, 0, "x")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in op7_decontamination(spark, str(tmp_path)).collect()}
    want = set()
    for doc, text, *_ in docs:
        w, hit, found = _words(text), set(), set()
        for item, it in items:
            v = _words(it)
            k = min(13, len(v))
            for a in range(len(v) - k + 1 if k else 0):
                for b in range(len(w) - k + 1):
                    if w[b] == v[a] and w[b : b + k] == v[a : a + k]:
                        hit.update(range(b, b + k))
                        found |= {item} - {None}
        want.add((doc, len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert got == want


def test_empty_benchmark(spark):
    d = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    got = decontaminate.contamination(d, spark.createDataFrame([], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 2, 0, False), (2, 0, 0, False)]
    b = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert decontaminate.contamination(d.filter("doc_id > 9"), b).collect() == []


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_encoder(tokenizer):
    texts = ["Don't stop, it's 12ab3 élan. Straße! İstanbul ΣΑΣ ǅ", "<|endoftext|> x<|startoftext|>y", "a\tb c d\x1ce\r\nf", "漢字。 ﬁ ª é ́", "", " \n ", "ÀÉÎ: ñandú; ok?? .,;", "\x00\x7f a"]
    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        for t, ids in zip(texts, e.encode(texts), strict=True):
            assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing(spark, tokenizer):
    rng = random.Random(2)
    texts = [None, "", "one"] + [" ".join(rng.choice(["red", "Blue!", "grün", "x1"]) for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["word " * 500]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1, "", "x"), (None, "two words", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack(packing.tokenise(d, public_tokenizers.path("word_bpe_49k.json"), size=64), size=64, part=150).toPandas()
    want = []
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple(-1 if v != v or v is None else int(v) for v in r)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    assert got["sequence_id"].nunique() <= 1.03 * packing.lower_bound(got["length"].to_numpy("i8"), 64) + 1
    assert packing.pack(packing.tokenise(d.filter("doc_id > 9999"), public_tokenizers.path("word_bpe_49k.json"))).collect() == []


def test_lower_bound_holds():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        sequences = packing.best_fit_decreasing(lengths, 100)[0].max() + 1
        assert packing.lower_bound(lengths, 100) <= sequences <= packing.lower_bound(lengths, 100) * 11 / 9 + 2
    assert packing.lower_bound(np.full(7, 51), 100) == 7 and packing.lower_bound(np.full(9, 34), 100) == 5


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.2, (300, 16)).round(3)
    v[100:160] = v[0]
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v)]
    rows += [(400, None, "x"), (420, [1.0, None] + [0.0] * 14, "x"), (440, [float("nan")] * 16, "x"), (460, [float("inf")] * 16, "x"), (None, [1.0] * 16, "x"), (480, [3.0] * 4, "x"), (0, [9.0] * 16, "x"), (20, rows[20][1], "x")]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string"))
    got = topk.top_k(df, F.col("id") % 20 == 0, k=7, block=64, query_block=5).collect()
    q = {i: np.floor(64 * r).astype(int) for i, r in enumerate(v)}
    q[480] = np.array([192] * 4 + [0] * 12)
    want = set()
    for i in q:
        if i % 20 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:7]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def _plain_best(q_ids, q, ids, v, k):
    out = set()
    for a in range(len(q)):
        scores = v @ q[a]
        out |= {(a, int(b), int(scores[b])) for b in [b for b in np.lexsort((ids, -scores)) if ids[b] != q_ids[a]][:k]}
    return out


@pytest.mark.parametrize("scale", [64, 10**5, 10**8])
def test_score_at_a_time_stops_on_proof(monkeypatch, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.1, (3000, 24))
    x[5:1500:7] = x[5]  # ties
    v, ids = np.floor(x * scale).astype("i8"), np.arange(3000) * 2
    q_ids = np.concatenate([ids[:150:2], [1, 3]])
    q = np.concatenate([v[:150:2], v[10:12] * 3])
    proven = []
    whole = topk._exact_best
    monkeypatch.setattr(topk, "_exact_best", lambda *a: proven.append(1) or whole(*a))
    a, b, score = topk.best_of_block(q_ids, q, ids, topk.Postings.of(v), 20)
    assert set(zip(a.tolist(), b.tolist(), score.tolist(), strict=True)) == _plain_best(q_ids, q, ids, v, 20) and len(a) == 20 * len(q)
    assert len(proven) < len(q)  # the others stopped before the last segment


def test_postings_hold_the_block():
    v = np.random.default_rng(1).integers(-40, 40, (50, 6))
    p = topk.Postings.of(v)
    assert (p.dense() == v).all() and (np.diff(p.runs[:, 0]) <= 0).all()
    held = [sum((x.astype("f8") ** 2).sum() for _, _, x in lists) for lists, _ in p.segments()]
    rests = [rest.sum() for _, rest in p.segments()]
    assert np.allclose(np.cumsum(held[::-1])[::-1][1:], rests[:-1]) and rests[-1] == 0
    assert topk.best_of_block(np.array([1]), np.zeros((1, 3), "i8"), np.array([1, 2]), topk.Postings.of(np.zeros((2, 3), "i8")), 5)[1].tolist() == [1]


def test_equal_vectors_stay_bounded():
    v, ids = np.full((20_000, 16), 3), np.arange(20_000)
    tracemalloc.start()
    a, b, _ = topk.best_of_block(ids[::80], v[::80], ids, topk.Postings.of(v), 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 250 * 20 and b.max() == 20 and peak < 200 << 20


def test_top_k_without_rows(spark):
    df = topk.quantised(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>"))
    assert topk.top_k(df, F.col("id") % 20 == 0).collect() == []
    assert topk.top_k(df.filter("id > 5"), F.col("id") % 20 == 0).collect() == []
    assert [tuple(r) for r in topk.top_k(df, F.col("id") == 1, k=20).collect()] == [(1, 1, 2, 64 * 128)]
