"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors become integers floor(scale * x). The index keeps them in blocks, each written once as posting lists: a posting
(dimension, row, value) stands in the segment of its quantised impact, the bit length of its value; segments are stored in
descending impact, and in a segment the postings of one dimension together. A block of queries meets each block of the
index once, a few queries at a time: segment by segment, each list adds its part to the scores. After a segment, what the
later ones can still add to a pair's score is at most the product of the query's norm and the norm of the candidate's
remaining components. A query stops only when these bounds prove that few candidates can be among its k best; all that can,
ties included, are then scored exactly. Scores of a query that meets no such proof are exact once every segment is added;
ties at its k-th score go by id before any is kept. The best k of each block are merged for each query.

The blocks of both sides are of like size, so each is copied once for each block of the other side.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null id, take no part.
Shorter vectors count as if padded with zeros. Of rows with one id the least vector is kept. A query's own id is never
its candidate. Ids are whole numbers; ties go to the smaller one. Fewer candidates than k are all returned; no query, no rows. Sums must fit
64 bits, which floor(64 x) does for components up to ten million.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, cut

INDEX = "block int, ids binary, runs binary, rows binary, vals binary, kind string, dims int"
ASKED = "block int, ids binary, vectors binary, kind string, dims int"
#: Queries that are scored at once; candidates that a query may have left when it stops, as a multiple of k.
AT_ONCE, LEFT = 64, 8


def quantised(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): integer vectors of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(finite)
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("id"), ints.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _dense(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, str]:
    """Ids in ascending order, their vectors, and the least integer type for these."""
    part = part.sort_values("id")
    m = np.zeros((len(part), max(map(len, part["v"]))), "i8")
    for i, v in enumerate(part["v"]):
        m[i, : len(v)] = v
    top = int(np.abs(m).max(initial=0))
    return part["id"].to_numpy("<i8"), m, next(k for k, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 64)) if top < most)


@dataclass
class Postings:
    """Lists of a block of vectors. ``runs`` has (level, dimension, postings) of each list, levels descending."""

    runs: np.ndarray
    rows: np.ndarray
    vals: np.ndarray
    size: tuple[int, int]

    @staticmethod
    def of(m: np.ndarray) -> Postings:
        rows, dims = np.nonzero(m)
        vals = m[rows, dims]
        level = np.frexp(np.abs(vals).astype("f8"))[1]
        order = np.lexsort((rows, dims, -level))
        level, dims = level[order], dims[order]
        starts = np.flatnonzero(np.diff(level, prepend=-1) | np.diff(dims, prepend=-1))
        runs = np.column_stack([level[starts], dims[starts], np.diff(starts, append=len(order))])
        return Postings(runs, rows[order], vals[order], m.shape)

    def segments(self) -> Iterator[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]]:
        """For each segment: its lists (dimension, rows, values), and of each row the sum of squares of all later segments."""
        ends = np.cumsum(self.runs[:, 2])
        heads = np.flatnonzero(np.diff(self.runs[:, 0], prepend=-1))
        bounds = list(zip(heads, [*heads[1:], len(self.runs)][: len(heads)], strict=True))
        rest = [np.zeros(self.size[0])]
        for a, b in reversed(bounds):
            at = slice(ends[a] - self.runs[a, 2], ends[b - 1])
            rest.append(rest[-1] + np.bincount(self.rows[at], self.vals[at].astype("f8") ** 2, minlength=self.size[0]))
        for later, (a, b) in enumerate(bounds, 1):
            lists = [(int(self.runs[i, 1]), self.rows[ends[i] - self.runs[i, 2] : ends[i]], self.vals[ends[i] - self.runs[i, 2] : ends[i]]) for i in range(a, b)]
            yield lists, rest[len(bounds) - later]

    def dense(self) -> np.ndarray:
        m = np.zeros(self.size, "i8")
        m[self.rows, np.repeat(self.runs[:, 1], self.runs[:, 2])] = self.vals
        return m


def _pack_index(part: pd.DataFrame) -> pd.DataFrame:
    ids, m, kind = _dense(part)
    p = Postings.of(m)
    row = (part["block"].iloc[0], ids.tobytes(), p.runs.astype("<i4").tobytes(), p.rows.astype("<i4").tobytes(), p.vals.astype(kind).tobytes(), kind, m.shape[1])
    return pd.DataFrame([row], columns=["block", "ids", "runs", "rows", "vals", "kind", "dims"])


def _pack_asked(part: pd.DataFrame) -> pd.DataFrame:
    ids, m, kind = _dense(part)
    return pd.DataFrame([(part["block"].iloc[0], ids.tobytes(), m.astype(kind).tobytes(), kind, m.shape[1])], columns=["block", "ids", "vectors", "kind", "dims"])


def _matrix(raw: bytes, kind: str, dims: int, width: int, rows: int) -> np.ndarray:
    return np.pad(np.frombuffer(raw, kind).reshape(rows, dims), ((0, 0), (0, width - dims))).astype("i8")


def blocks(vectors: DataFrame, rows: int, pack, schema: str) -> DataFrame:
    """Written table of packed blocks, of about ``rows`` vectors each, dealt by a hash of the id."""
    n = max(1, -(-vectors.count() // rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return cut(dealt.groupBy("block").applyInPandas(pack, schema), "blocks")


def _exact_best(scores: np.ndarray, k: int, own: int) -> np.ndarray:
    """Rows of the k best of one query's exact scores, its own row left out; of equal ones the first."""
    rows = np.delete(np.arange(len(scores)), own) if own >= 0 else np.arange(len(scores))
    s = scores[rows]
    k = min(k, len(s))
    if not k:
        return rows[:0]
    kth = np.partition(s, len(s) - k)[len(s) - k]
    above = np.flatnonzero(s > kth)
    return rows[np.concatenate([above, np.flatnonzero(s == kth)[: k - len(above)]])]


def best_of_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, p: Postings, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best candidates, score at a time; ids ascend."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p.vals).max(initial=0)) * max(1, p.size[1])
    kind = "f4" if most < 2**24 else "f8" if most < 2**53 else "i8"  # exact for these sums
    segments, v = list(p.segments()), p.dense()
    whole = float(segments[0][1].sum()) + sum(float((x.astype("f8") ** 2).sum()) for _, _, x in segments[0][0]) if segments else 0.0
    at = np.searchsorted(ids, q_ids).clip(max=len(ids) - 1)
    own = np.where(ids[at] == q_ids, at, -1)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for first in range(0, len(q), AT_ONCE):
        active = np.arange(first, min(first + AT_ONCE, len(q)))
        acc = np.zeros((p.size[0], len(active)), kind)
        for lists, rest in segments:
            now = q[active].T.astype(kind)
            for dim, rows, vals in lists:
                acc[rows] += vals.astype(kind)[:, None] * now[dim]
            if p.size[0] <= LEFT * k or not rest.any() or rest.sum() * 8 > whole:
                continue
            norm = np.sqrt((q[active].astype("f8") ** 2).sum(1))
            bound = np.outer(np.sqrt(rest), norm) * (1 + 1e-6) + 1e-6
            lower, upper = acc - bound, acc + bound
            mine = np.flatnonzero(own[active] >= 0)
            lower[own[active[mine]], mine], upper[own[active[mine]], mine] = -np.inf, -np.inf
            possible = upper >= np.partition(lower, len(lower) - k, axis=0)[len(lower) - k]
            proven = possible.sum(0) <= LEFT * k
            for j in np.flatnonzero(proven):
                b = np.flatnonzero(possible[:, j])
                score = v[b] @ q[active[j]]
                order = np.lexsort((b, -score))[:k]
                found.append((int(active[j]), b[order], score[order]))
            active, acc = active[~proven], np.ascontiguousarray(acc[:, ~proven])
            if not len(active):
                break
        for j, a in enumerate(active):
            b = _exact_best(np.ascontiguousarray(acc[:, j]), k, own[a])
            found.append((int(a), b, acc[b, j].astype("i8")))
    a = np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype("i8")
    return a, np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, block: int = 8192, query_block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score for the queries among ``vectors`` (id, v), against all of them."""
    spark = vectors.sparkSession
    vectors = cut(vectors, "vectors")
    index, asked = blocks(vectors, block, _pack_index, INDEX), blocks(vectors.filter(is_query), query_block, _pack_asked, ASKED)
    n_index, n_asked = index.agg(F.max("block")).first()[0], asked.agg(F.max("block")).first()[0]
    out = "query_id bigint, vec_id bigint, score bigint"
    if n_index is None or n_asked is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    c = index.withColumnRenamed("block", "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked))))
    q = asked.select(F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_index))).alias("cb"), *[F.col(x).alias(f"q_{x}") for x in ("ids", "vectors", "kind", "dims")])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                width = max(r.dims, r.q_dims)
                ids, q_ids = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.q_ids, "<i8")
                rows, vals = np.frombuffer(r.rows, "<i4"), np.frombuffer(r.vals, r.kind).astype("i8")
                p = Postings(np.frombuffer(r.runs, "<i4").reshape(-1, 3), rows, vals, (len(ids), width))
                a, b, s = best_of_block(q_ids, _matrix(r.q_vectors, r.q_kind, r.q_dims, width, len(q_ids)), ids, p, k)
                yield pd.DataFrame({"query_id": q_ids[a], "vec_id": ids[b], "score": s})

    with batches_of(spark, 1):  # a row holds two whole blocks
        found = cut(q.join(c.hint("shuffle_merge"), ["qb", "cb"]).mapInPandas(search, out), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
