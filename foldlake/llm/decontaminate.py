"""Benchmark decontamination by winnowing.

Of every ``width`` words in a row that a document shares with a benchmark item, both keep the same k-gram: the least
hash of each sliding window of k-grams (the rightmost of equal ones), for windows of width - k + 1. Kept k-grams are
joined by hash, and each hit is extended word by word on both sides, as far as the width needs, comparing the words
themselves; so every shared span of ``width`` words or more is found, and no other. An item with fewer words is one
window of all its words; items of such a length are winnowed with windows of their own.

Documents' k-grams whose bit is not set in a bit map of the benchmark's k-grams (of fixed size) never leave their task.
The join is a broadcast one only if the benchmark's k-grams are few enough, in rows and in bytes.

Defined results: a null or empty text has no words and is clean. Repeated rows get the same result each. A null doc_id
stays null. An item without words occurs nowhere; one without an id marks words but is not counted or named. An empty
benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, small, text_batches, work_of

# Bytes of words: digits, letters, and all of other characters; A-Z become a-z, the rest spaces.
_KEPT = {*b"0123456789", *LOWER.encode(), *range(128, 256)}
TABLE = bytes(b if b in _KEPT else (b + 32 if chr(b) in UPPER else 32) for b in range(256))
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], "u8")
BITS = 22


def powers(n: int) -> np.ndarray:
    """MIX[0] ** i modulo 2 ** 64 for i below n."""
    out = np.full(n, MIX[0], "u8")
    out[:1] = 1
    return np.cumprod(out, dtype="u8")


POWERS = powers(256)

GRAM = "struct<k:int,w:int,fp:bigint,at:int,left:array<string>,core:string,right:array<string>>"


class Words:
    """The words of a text: their bytes' places and hashes."""

    def __init__(self, text: str | None, table: bytes = TABLE):
        self.bytes = (text or "").encode("utf-8", "replace").translate(table)
        inside = np.frombuffer(self.bytes, "u1") != 32
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view("i1")))
        self.starts, self.ends = edges[::2], edges[1::2]
        n = self.ends - self.starts
        if not len(n):
            self.hashes = np.zeros(0, "u8")
            return
        at = np.flatnonzero(inside)
        place = at - np.repeat(self.starts, n)
        power = POWERS if n.max() <= len(POWERS) else powers(int(n.max()))
        values = (np.frombuffer(self.bytes, "u1")[at].astype("u8") + MIX[2]) * power[place]
        h = np.add.reduceat(values, np.cumsum(n) - n)
        self.hashes = (h ^ (h >> np.uint64(29))) * MIX[1]

    def __len__(self) -> int:
        return len(self.hashes)

    def words(self, a: int, b: int) -> list[str]:
        return [self.bytes[s:e].decode("utf-8", "replace") for s, e in zip(self.starts[max(a, 0) : b], self.ends[max(a, 0) : b], strict=True)]


def winnow(hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints) of the kept k-grams of a sequence of word hashes."""
    m = len(hashes) - k + 1
    if m < window:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    h = np.zeros(m, "u8")
    for j in range(k):
        h = h * MIX[2] + hashes[j : j + m]
    h = (h ^ (h >> np.uint64(31))) * MIX[0]
    if window == 1:
        return np.arange(m), h
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))
    return at, h[at]


def gram_length(words: int, width: int, k: int) -> tuple[int, int]:
    """(k, width) for an item of so many words."""
    return min(words, k), min(words, width)


def _grams(words: Words, kinds: list[tuple[int, int]], bits: np.ndarray | None) -> list[dict]:
    out = []
    for k, width in kinds:
        at, fp = winnow(words.hashes, k, width - k + 1)
        if bits is not None:
            here = (fp >> np.uint64(64 - BITS)).astype("i8")
            hit = (bits[here >> 6] >> (here & 63).astype("u8")) & np.uint64(1) == 1
            at, fp = at[hit], fp[hit]
        more = width - k
        for i, f in zip(at.tolist(), fp.view("i8").tolist(), strict=True):
            out.append({"k": k, "w": width, "fp": f, "at": i, "left": words.words(i - more, i)[::-1], "core": " ".join(words.words(i, i + k)), "right": words.words(i + k, i + k + more)})
    return out


def benchmark_grams(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", width: int = 13, k: int = 7) -> DataFrame:
    """Written table (item_id, k, w, fp, at, left, core, right) of all items' kept k-grams."""
    text_batches(benchmark.sparkSession)

    @work_of("decontaminate")
    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = [Words(t) for t in batch["text"]]
            yield pd.DataFrame({"item": batch["item"], "g": [_grams(w, [gram_length(len(w), width, k)] if len(w) else [], None) for w in every]})

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return cut(items.mapInPandas(grams, f"item string, g array<{GRAM}>").select("item", F.explode("g").alias("g")).select("item", "g.*").distinct(), "bench")


def document_grams(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table, a row for each document: doc_id, _t (hash of the text), n_words, g (kept k-grams that may be the benchmark's)."""
    spark = docs.sparkSession
    text_batches(spark)
    place = F.shiftrightunsigned("fp", 64 - BITS)
    parts = bench.groupBy((F.shiftright(place, 6)).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - BITS}) & 63 as int))")).alias("b")).collect()
    bits = np.zeros(1 << (BITS - 6), "u8")  # at most so many parts
    for r in parts:
        bits[r["i"]] = np.uint64(r["b"] & (2**64 - 1))
    kinds = sorted((r["k"], r["w"]) for r in bench.select("k", "w").distinct().collect())  # at most one for each length up to the width
    sent = spark.sparkContext.broadcast(bits)

    @work_of("decontaminate")
    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = [Words(t) for t in batch["text"]]
            yield batch[["doc_id", "_t"]].assign(n_words=[len(w) for w in every], g=[_grams(w, kinds, sent.value) for w in every])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInPandas(grams, f"doc_id {id_type}, _t bigint, n_words bigint, g array<{GRAM}>"), "docgrams")


def _alike(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, False).cast("int")
    return F.when(first == 0, F.size(equal)).otherwise(first - 1)


def find_hits(grams: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows (doc_id, _t, item, start, stop): runs of document words inside an occurrence of a window."""
    d = grams.filter(F.size("g") > 0).select("doc_id", "_t", F.explode("g").alias("d")).select("doc_id", "_t", F.col("d.k").alias("k"), F.col("d.w").alias("w"), F.col("d.fp").alias("fp"), F.struct("d.at", "d.left", "d.core", "d.right").alias("d"))
    b = bench.select("item", "k", "w", "fp", F.struct("left", "core", "right").alias("b"))
    words = F.concat("b.left", F.array("b.core"), "b.right")
    wide = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 16)
    hit = d.join(small(b, width=wide), ["fp", "k", "w"]).filter(F.col("d.core") == F.col("b.core"))
    hit = hit.withColumn("l", _alike(F.col("d.left"), F.col("b.left"))).withColumn("r", _alike(F.col("d.right"), F.col("b.right")))
    hit = hit.filter(F.col("l") + F.col("k") + F.col("r") >= F.col("w"))
    return hit.select("doc_id", "_t", "item", (F.col("d.at") - F.col("l")).alias("start"), (F.col("d.at") + F.col("k") + F.col("r")).alias("stop"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = 13, k: int = 7, share: int = 20) -> DataFrame:
    """A row for each document: doc_id, _t, n_words, n_hit, items (sorted array of strings), contaminated: some word is hit,
    and one in ``share`` or more."""
    bench = benchmark_grams(benchmark, id_col=item_col, text_col=item_text_col, width=width, k=k)
    grams = document_grams(docs, bench, id_col=id_col, text_col=text_col)
    runs = find_hits(grams, bench).distinct().groupBy("doc_id", "_t").agg(F.collect_set(F.struct("start", "stop")).alias("runs"), F.sort_array(F.collect_set("item")).alias("items"))
    inside = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["stop"] - 1))))
    hits = cut(runs.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_u"), F.size(inside).cast("long").alias("n"), "items"), "hits")
    out = grams.drop("g").join(small(hits), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")), "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return out.select("doc_id", "_t", "n_words", n.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n > 0) & (n * share >= F.col("n_words"))).alias("contaminated"))
