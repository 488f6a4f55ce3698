"""Importance resampling of documents towards a target's distribution of hashed n-grams.

Words and n-grams are made by Arrow's kernels, a slice of texts at a time: ascii_lower, split_pattern_regex, list_flatten
and dictionary_encode give the index of every word in the slice's dictionary; shifted indices give the n-grams, each as
one integer of dictionary indices; only their distinct values get a CRC, which is put together from the words' own CRCs,
as a CRC is linear; a take brings the buckets (or their gains) back to the n-grams, which are added up by document.

The counts of both tables are arrays of as many numbers as there are buckets, added up in each task before they leave it.
Each document's score is its weight plus Gumbel noise of its id, so the highest scores are a draw without replacement by
weight. Scores are integers within known bounds, so a table of their counts tells the driver the lowest score drawn. What
is at or above it is dealt into ranges of (score, id), counted by range, and numbered within each; no range holds more
than its share, however many rows are alike.

Defined results: a null or empty text has no features and weight 0. The noise of a null id is that of an empty one, and it
stands last among equal scores. Repeated rows get equal scores and ranks of their own. An empty target or table gives gains of
counts of zero. With too few documents of ``min_words`` words for a whole one to be drawn, none is.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, text_batches, unpacked

#: What is no part of a word, in lower-cased text: ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text taken at once; rows of a range that is numbered in one task, in expectation.
SLICE, RANGE = 8 << 20, 200_000


@functools.lru_cache(4096)
def _behind(n: int) -> np.ndarray:
    """Tables (4 x 256) that carry a CRC over n further bytes: crc(a + b) = carried(crc(a), n) ^ crc(b), for b of n bytes."""
    zeros = bytes(n)
    none = zlib.crc32(zeros, 0)
    bit = [zlib.crc32(zeros, 1 << i) ^ none for i in range(32)]
    out = np.zeros((4, 256), "u4")
    for i in range(32):
        out[i // 8, np.arange(256) >> i % 8 & 1 == 1] ^= np.uint32(bit[i])
    return out


def carried(crc: np.ndarray, n: int) -> np.ndarray:
    t = _behind(n)
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


def joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of left + space + right from those of both and the lengths of right."""
    out = np.zeros(len(left), "u4")
    left = carried(left, 1) ^ np.uint32(zlib.crc32(b" "))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out[at] = carried(left[at], n) ^ right[at]
    return out


class Features:
    """The n-grams of some texts, by length: the bucket of each distinct one, which of them each n-gram is, and its text."""

    def __init__(self, texts: pa.Array, n: int, buckets: int):
        parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
        words, doc = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
        real = pc.not_equal(pc.binary_length(words), 0)
        doc = doc[real.to_numpy(zero_copy_only=False)].astype("i8")
        coded = pc.filter(words, real).dictionary_encode()
        at, known = coded.indices.to_numpy(zero_copy_only=False).astype("i8"), [w.as_py() for w in coded.dictionary.cast(pa.binary())]
        crc, size = np.array([zlib.crc32(w) for w in known], "u4"), np.array([len(w) for w in known], "i8")
        self.texts, self.words = len(texts), np.bincount(doc, minlength=len(texts))
        self.grams = [(crc % np.uint32(buckets), at, doc)]
        gram, crcs = at, crc  # those of one word less: which each place begins, and their CRCs
        for k in range(2, n + 1):
            m = max(0, len(doc) - k + 1)
            inside = doc[:m] == doc[len(doc) - m :]
            pairs = gram[:m][inside] * max(1, len(known)) + at[len(doc) - m :][inside]
            distinct, which = np.unique(pairs, return_inverse=True)
            head, tail = np.divmod(distinct, max(1, len(known)))
            crcs = joined(crcs[head], crc[tail], size[tail])
            gram = np.full(m, -1, "i8")
            gram[inside] = which
            self.grams.append((crcs % np.uint32(buckets), which, doc[:m][inside]))

    def counts(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(bucket, np.bincount(which, minlength=len(bucket)), buckets).astype("i8") for bucket, which, _ in self.grams)

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, sum of their gains) of each text."""
        n, total = np.zeros(self.texts, "i8"), np.zeros(self.texts, "i8")
        for bucket, which, doc in self.grams:
            size = np.bincount(doc, minlength=self.texts)
            n += size
            if len(doc):
                total[size > 0] += np.add.reduceat(gains[bucket].take(which), (np.cumsum(size) - size)[size > 0])
        return n, total


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about ``size`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8"))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def bucket_counts(docs: DataFrame, *, text_col: str = "text", n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many n-grams of up to ``n`` words of all texts fall into each bucket."""
    text_batches(docs.sparkSession)
    piece = SLICE

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in batches:
            for _, texts in slices(batch["text"], piece):
                total += Features(texts, n, buckets).counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], ["bucket", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, "i8")
    for r in got.collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln) of the target's smoothed share over the source's, for each bucket."""
    t_all, s_all, k = float(target.sum()), float(source.sum()), len(source)
    return np.array([math.floor(scale * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], "i8")


def weighted(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None, n: int = 2, seed: int = 7, scale: int = 1000) -> DataFrame:
    """Written table: kept (the columns kept), id, n_words, n_features, weight, score of each document."""
    text_batches(docs.sparkSession)
    rows = docs.select(packed(keep).alias("kept"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent, piece = docs.sparkSession.sparkContext.broadcast(gain), SLICE

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch["text"], piece):
                f = Features(texts, n, len(sent.value))
                size, total = f.sums(sent.value)
                rest = batch.slice(first, len(texts))
                weight = np.where(size > 0, total // np.maximum(size, 1), 0)
                yield pa.RecordBatch.from_arrays([rest["kept"], rest["id"], *map(pa.array, (f.words, size, weight))], ["kept", "id", "n_words", "n_features", "weight"])

    kept, id_ = (rows.schema[c].dataType.simpleString() for c in ("kept", "id"))
    out = rows.mapInArrow(weigh, f"kept {kept}, id {id_}, n_words bigint, n_features bigint, weight bigint")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-F.lit(float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return cut(out.withColumn("score", F.col("weight") + noise), "weights")


def lowest_drawn(scores: DataFrame, n: int) -> int | None:
    """The score of the n-th highest of ``scores``; they lie within bounds that the gains' scale sets, some 10^5 values."""
    for r in sorted(scores.groupBy("score").count().collect(), reverse=True):
        n -= r["count"]
        if n <= 0:
            return r["score"]
    return None


def ranked(rows: DataFrame, order: list[Column], into: str, per_range: int | None = None) -> DataFrame:
    """``rows`` (a written table) with the place of each, from 1, in ``order``. Equal rows are in any order."""
    n = max(1, -(-rows.count() // (per_range or RANGE)))
    dealt = cut(rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "salted")
    dealt = cut(dealt.repartitionByRange(n, *order, "_salt").withColumn("_range", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("_range").count().withColumn("_before", F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("_range", F.coalesce("_before", F.lit(0)).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_salt"))
    return dealt.withColumn(into, place).join(F.broadcast(before), "_range").withColumn(into, (F.col(into) + F.col("_before")).cast("long")).drop("_range", "_before", "_salt")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", keep: dict[str, Column] | None = None,
             n: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """The columns ``keep`` of each row, and n_features, weight, score, and the rank of the ``percent`` per cent of the documents with
    ``min_words`` words or more that are drawn; null for others."""
    gain = gains(bucket_counts(target, text_col=target_col, n=n, buckets=buckets), bucket_counts(docs, text_col=text_col, n=n, buckets=buckets))
    rows = weighted(docs, gain, id_col=id_col, text_col=text_col, keep=keep, n=n, seed=seed)
    long_enough = F.col("n_words") >= min_words
    drawn = rows.filter(long_enough).count() * percent // 100
    least = lowest_drawn(rows.filter(long_enough), drawn) if drawn else None
    if least is None:
        out = rows.withColumn("rank", F.lit(None).cast("long"))
    else:
        high = long_enough & (F.col("score") >= least)
        order = [F.desc("score"), F.asc_nulls_last("id")]
        top = ranked(cut(rows.filter(high), "high"), order, "rank")
        top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
        out = rows.filter(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(top)
    return out.select(*unpacked(keep), "n_features", "weight", "score", "rank")
