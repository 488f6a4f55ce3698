"""An interpolated modified Kneser-Ney n-gram model of words, counted in Spark.

Tasks count the n-grams of the texts they read, some million tokens at a time, as arrays of word hashes; Spark brings
together what falls into one shard, a range of the n-grams' 64-bit hashes. A shard's task adds the counts up, writes them
as arrays sorted by hash into the shared folder, and hands on what the next order needs: for every n-gram its suffix, which
thereby counts the words that precede it (suffixes that begin a text keep their own count), and for its context the total
and the numbers of followers seen once, twice and more often. So each order is one shuffle, of sums, and there are as many
shards as the texts' bytes ask for; no word or context is ever together in one task, however frequent. The driver gets a
few sums of each shard, from which the three discounts of each order follow.

Scoring maps the shards' files into memory (where the shared folder is no file system of the worker's own, a shard is read
into memory while it is asked) and looks a batch's distinct n-grams up, shard by shard in order of hash. A word's
probability is its discounted count over the context's total, plus the weight that the discounts free times the
probability at the next lower order; below the single words there is the uniform distribution over the known words and one
unknown word.

Files bear the names of their shards and are moved into place whole, and a shard has the same content whichever attempt
wrote it, so a repeated task does no harm.

Defined results: a null or empty text has only its end. Rows with a null id are not learnt from where the caller's filter
drops them, and are scored like others; repeated rows count as often as they stand. Without any text to learn from, every
probability is 1. Discounts that cannot be had from the counts of counts (some are zero in a small corpus) are 0.5, 1 and
1.5. Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, batches_of, packed, shared_dir, text_batches, unpacked
from .decontaminate import MIX, Words

#: Bytes of words: all but white space; A-Z become a-z.
TABLE = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if chr(b) in UPPER else b for b in range(256))
START, END = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
#: Tokens counted at once and scored at once; bytes of text for which there is one shard.
COUNTED, SCORED, SHARD_BYTES = 3 << 20, 1 << 20, 16 << 20
#: Maps of shards' files that a worker keeps; where files cannot be mapped, shards in memory.
MAPS, READ = 4096, 2
ROW = "kind string, shard int, data binary"


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of rows of word hashes; their high bits are as good as any."""
    h = np.full(len(columns[0]), len(columns), "u8")
    for c in columns:
        h = (h ^ c) * MIX[0]
        h ^= h >> np.uint64(32)
    return h * MIX[1]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype("i8")


def summed(keys: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows of one key together, in order of keys, their values summed."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1))) if len(keys) else order
    return keys[first], [c[order[first]] for c in columns], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def sequence(hashes: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each after ``order - 1`` starts and before an end; the places of what is predicted."""
    pad = np.full(order - 1, START, "u8")
    seq = np.concatenate([x for h in hashes for x in (pad, h, END[None])])
    size = np.array([len(h) + order for h in hashes])
    begin = np.repeat(np.cumsum(size) - size, size)
    return seq, np.flatnonzero(np.arange(len(seq)) - begin >= order - 1)


def grams(seq: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Word hashes of the n words that end at each place."""
    return [seq[at - n + 1 + j] for j in range(n)]


def _blob(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Rows of a shard; sorted by their first column, which then takes little space."""
    order = np.argsort(columns[0], kind="stable")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x[order].tobytes() for x in [*columns, *values]))


def _rows(kind: str, shards: int, keys: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]) -> list[tuple[str, int, bytes]]:
    """(kind, shard, data) of summed rows."""
    shard = shard_of(keys, shards)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(keys)][: len(cuts)], strict=True):
        out.append((kind, int(shard[a]), _blob([c[a:b] for c in columns], [v[a:b].astype("<i8") for v in values])))
    return out


def _read(data: pd.Series, columns: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u8").reshape(columns + values, -1) for x in data]
    every = np.concatenate(parts, axis=1)
    return list(every[:columns]), list(every[columns:].view("<i8"))


def file_of(keys: np.ndarray, values: list[np.ndarray]) -> bytes:
    """Sorted keys and their values. Values under 255 take a byte; 255 stands for one listed apart, by place."""
    big = [np.flatnonzero(v >= 255) for v in values]
    out = io.BytesIO()
    out.write(np.array([len(keys), *map(len, big)], "<i8").tobytes())
    out.write(keys.astype("<u8").tobytes())
    for v, b in zip(values, big, strict=True):
        out.write(b.astype("<i8").tobytes() + v[b].astype("<i8").tobytes())
    for v in values:
        out.write(np.minimum(v, 255).astype("u1").tobytes())
    return out.getvalue()


@dataclass
class Sorted:
    """A shard's file, as arrays over its bytes."""

    keys: np.ndarray
    small: list[np.ndarray]
    big: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def over(raw, values: int) -> Sorted:
        n, *sizes = np.frombuffer(raw, "<i8", 1 + values).tolist()
        at = 8 * (1 + values)
        keys = np.frombuffer(raw, "<u8", n, at)
        at += 8 * n
        big = []
        for b in sizes:
            big.append((np.frombuffer(raw, "<i8", b, at), np.frombuffer(raw, "<i8", b, at + 8 * b)))
            at += 16 * b
        return Sorted(keys, [np.frombuffer(raw, "u1", n, at + i * n) for i in range(values)], big)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A row of values for each key; zeros where it is not stored."""
        out = np.zeros((len(self.small), len(keys)), "i8")
        if not len(self.keys):
            return out
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == keys)
        at = at[hit]
        for i, (s, (place, value)) in enumerate(zip(self.small, self.big, strict=True)):
            v = s[at].astype("i8")
            listed = np.flatnonzero(v == 255)
            v[listed] = value[np.searchsorted(place, at[listed])]
            out[i, hit] = v
        return out


def _write(folder: str, kind: str, shard: int, data: bytes) -> None:
    store, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/{kind}")
    store.create_dir(path)
    own = f"{path}/.{shard}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    try:
        store.move(own, f"{path}/{shard}")
    except OSError:  # some stores don't replace a file: another attempt has written the same
        if store.get_file_info(f"{path}/{shard}").type != pyarrow.fs.FileType.File:
            raise
        store.delete_file(own)


@functools.lru_cache(MAPS)
def _mapped(path: str, values: int) -> Sorted:
    return Sorted.over(np.memmap(path, "u1", "r"), values)


@functools.lru_cache(READ)
def _loaded(uri: str, values: int) -> Sorted:
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return Sorted.over(f.read(), values)


@dataclass(frozen=True)
class Model:
    """``discounts``, ``total`` and ``known`` (n-grams) by order, from 1; ``seen`` (n-grams once, twice, more) of order 1;
    ``tokens`` learnt from; ``stored``: the shards that have a file, by kind."""

    folder: str
    order: int
    shards: int
    discounts: tuple[tuple[float, float, float], ...]
    total: int
    known: int
    seen: tuple[int, int, int]
    tokens: int
    stored: dict[str, frozenset[int]]

    def find(self, kind: str, keys: np.ndarray, values: int) -> np.ndarray:
        """Values of ``keys`` (distinct, ascending)."""
        out = np.zeros((values, len(keys)), "i8")
        shard = shard_of(keys, self.shards)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)][: len(cuts)], strict=True):
            if int(shard[a]) in self.stored[kind]:
                uri = f"{self.folder}/{kind}/{shard[a]}"
                part = _mapped(urlparse(uri).path, values) if uri.startswith("file:") else _loaded(uri, values)
                out[:, a:b] = part.find(keys[a:b])
        return out

    def look_up(self, kind: str, keys: np.ndarray, values: int) -> np.ndarray:
        distinct, where = np.unique(keys, return_inverse=True)
        return self.find(kind, distinct, values)[:, where]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """From the numbers of n-grams counted once, twice, three and four times."""
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = tuple(i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3))
        if all(0 <= x <= i for i, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def _text_pieces(batch: pa.RecordBatch, tokens: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, word hashes of the texts from there on), of about so many tokens each."""
    held, first, n = [], 0, 0
    for i, text in enumerate(batch["text"]):
        held.append(Words(text.as_py(), TABLE).hashes)
        n += len(held[-1])
        if n >= tokens:
            yield first, held
            held, first, n = [], i + 1, 0
    if held:
        yield first, held


def fit(docs: DataFrame, *, text_col: str = "text", order: int = 2) -> Model:
    """The model of the texts of ``docs``."""
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    folder = f"{shared_dir(spark)}/kneser_ney-{uuid.uuid4().hex}"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            columns = grams(*sequence(held, order), order)
            keys, columns, (count,) = summed(mixed(columns), columns, [np.ones(len(columns[0]), "i8")])
            rows = _rows(f"g{order}", shards, keys, columns, [count, count])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "shard", "data"])

        for batch in batches:
            for _, hashes in _text_pieces(batch, COUNTED // 8):
                held += hashes
                n += sum(map(len, hashes)) + len(hashes)
                if n >= COUNTED:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        kind, shard = part["kind"].iloc[0], int(part["shard"].iloc[0])
        if kind[0] == "s":
            return part
        k = int(kind[1:])
        if kind[0] == "c":
            (key,), values = _read(part["data"], 1, 4)
            key, _, values = summed(key, [], values)
            _write(folder, kind, shard, file_of(key, values))
            return pd.DataFrame([(f"s{kind}", shard, b"")], columns=["kind", "shard", "data"])
        columns, values = _read(part["data"], k, 2)
        keys, columns, (count, raw) = summed(mixed(columns), columns, values)
        _write(folder, kind, shard, file_of(keys, [count, raw] if k == 1 else [count]))
        numbers = [len(keys), int(count.sum()), int(raw.sum()), *[int((count == i).sum()) for i in (1, 2, 3, 4)]]
        rows = [(f"s{kind}", shard, np.array(numbers, "<i8").tobytes())]
        if k > 1:
            suffix = columns[1:]
            own = np.where(suffix[0] == START, raw, 1) if k > 2 else np.ones(len(raw), "i8")
            rows += _rows(f"g{k - 1}", shards, *summed(mixed(suffix), suffix, [own, raw]))
            context = mixed(columns[:-1])
            followers = [count, *[(count == i).astype("i8") for i in (1, 2)], (count > 2).astype("i8")]
            key, _, followers = summed(context, [], followers)
            rows += _rows(f"c{k}", shards, key, [key], followers)
        return pd.DataFrame(rows, columns=["kind", "shard", "data"])

    rows = texts.mapInArrow(counted, ROW)
    with batches_of(spark, 64):
        for _ in range(order):
            rows = rows.groupBy("kind", "shard").applyInPandas(merged, ROW)
        got = rows.filter(F.col("kind").startswith("s")).collect()  # a few numbers for each shard of each order
    sums, stored = {k: [0] * 7 for k in range(1, order + 1)}, {f"{x}{k}": set() for x in "gc" for k in range(1, order + 1)}
    for r in got:
        stored[r["kind"][1:]].add(r["shard"])
        if r["data"]:
            k = int(r["kind"][2:])
            sums[k] = [a + b for a, b in zip(sums[k], np.frombuffer(r["data"], "<i8").tolist(), strict=True)]
    known, total, tokens, once, twice, *_ = sums[1]
    return Model(folder, order, shards, tuple(discounts(sums[k][3:]) for k in range(1, order + 1)), total, known,
                 (once, twice, known - once - twice), tokens, {k: frozenset(v) for k, v in stored.items()})


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def probabilities(seq: np.ndarray, at: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(probability, count in the texts learnt from) of the token at each place."""
    count, raw = m.look_up("g1", mixed(grams(seq, at, 1)), 2)
    if not m.total:
        return np.ones(len(at)), raw
    freed = sum(d * n for d, n in zip(m.discounts[0], m.seen, strict=True)) / m.total
    p = (count - _discount(count, m.discounts[0])) / m.total + freed / (m.known + 1)
    for k in range(2, m.order + 1):
        d = m.discounts[k - 1]
        words = grams(seq, at, k)
        (count,) = m.look_up(f"g{k}", mixed(words), 1)
        total, *seen = m.look_up(f"c{k}", mixed(words[:-1]), 4)
        met = total > 0
        weight = sum(x * n for x, n in zip(d, seen, strict=True))
        p = np.where(met, (count - _discount(count, d) + weight * p) / np.where(met, total, 1), p)
    return p, raw


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: dict[str, Column] | None = None, add: float = 0.1) -> DataFrame:
    """The columns ``keep`` of each row, and n_tokens, n_known (tokens learnt), base_score (log10 probability under single
    words, each count raised by ``add``), score (the model's) and perplexity."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(packed(keep).alias("kept"), F.col(text_col).alias("text"))
    sent = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for first, hashes in _text_pieces(batch, SCORED):
                p, raw = probabilities(*sequence(hashes, m.order), m)
                size = np.array([len(h) + 1 for h in hashes])
                each = np.cumsum(size) - size
                base = np.log10((raw + add) / (m.tokens + add * (m.known + 1)))
                log = np.add.reduceat(np.log10(p), each)
                found = [size, np.add.reduceat((raw > 0).astype("i8"), each), np.add.reduceat(base, each), log, 10 ** (-log / size)]
                yield pa.RecordBatch.from_arrays([batch["kept"].slice(first, len(hashes)), *map(pa.array, found)], ["kept", *names])

    names = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    out = rows.mapInArrow(scored, f"kept {rows.schema['kept'].dataType.simpleString()}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")
    return out.select(*unpacked(keep), *names)
