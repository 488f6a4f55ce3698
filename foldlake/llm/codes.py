"""Product codes of vectors by Lloyd rounds over two trees.

Components become integers floor(scale * x); vectors are cut into equal consecutive parts, each part position with a
codebook of its own. Vectors lie in blocks of bounded size, written once: for each part position the block's parts in the
order of a balanced tree (halved at the median of the widest component), with the box and the component sums of every
node. Each round makes a like tree over a codebook's entries and walks both trees at once, a level at a time. A pair of
nodes is dropped when even the least distance of its boxes exceeds the largest that another entry node of the same part
node allows, and an entry when another is nearer, or as near and of lower index, for every point of the part node's box.
A part node that has one entry left is assigned whole, its cached sums with it; the parts of a leaf that still has several
entries are compared with these by integer distances. All bounds are integers, so none is rounded and ties are kept.
Only the sums for each (part, entry) leave the tasks; a codebook is as large as its parameters say.

Defined results: vectors that are null or hold a null or non-finite component are dropped. Shorter vectors, empty ones
too, count as if padded with zeros to the longest one's length, and that to a multiple of ``parts``. The codebooks start
from the least ids, null ids last, those of one id by their components; fewer vectors than ``entries`` give fewer
entries. Repeated rows are coded each. Ties go to the lower index. An empty table gives none. Sums must fit 64 bits,
which floor(256 x) does for components up to some ten thousand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, packed, small, unpacked

#: Parts of a leaf, at most; bytes of a block's components as 64-bit integers, and its vectors, at most.
LEAF, BLOCK_BYTES, BLOCK_ROWS = 16, 16 << 20, 16_384


@dataclass
class Tree:
    """A balanced tree over ``points`` (in tree order). Node i of level l holds the points [n i / 2^l, n (i + 1) / 2^l)."""

    points: np.ndarray
    order: np.ndarray
    levels: int
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)

    def ends(self, level: int) -> np.ndarray:
        return len(self.points) * np.arange((1 << level) + 1) >> level

    @staticmethod
    def of(points: np.ndarray, leaf: int) -> Tree:
        n, order, levels = len(points), np.arange(len(points)), 0
        while -(-n >> levels) > leaf:
            levels += 1
        t = Tree(points, order, levels)
        for level in range(levels + 1):
            starts = t.ends(level)[:-1]
            p = points[order]
            low, high = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
            t.low.append(low)
            t.high.append(high)
            t.sums.append(np.add.reduceat(p, starts))
            if level < levels:
                node = np.repeat(np.arange(len(starts)), np.diff(t.ends(level)))
                widest = (high - low).argmax(1)
                order = order[np.lexsort((p[np.arange(n), widest[node]], node))]
        t.points, t.order = points[order], order
        return t


def nearest(parts: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of each part in tree order, count and component sums of each entry's parts, distances between a part and an
    entry that were worked out)."""
    entries = Tree.of(book, 1)
    code, count, sums, exact = np.zeros(len(parts.points), "i8"), np.zeros(len(book), "i8"), np.zeros(book.shape, "i8"), 0
    own = entries.order[np.minimum(entries.ends(entries.levels)[:-1], len(book) - 1)]  # the entry of each leaf
    p, e, lp, le = np.zeros(1, "i8"), np.zeros(1, "i8"), 0, 0
    while len(p):
        heads = np.flatnonzero(np.diff(p, prepend=-1))
        plow, phigh, elow, ehigh = parts.low[lp][p], parts.high[lp][p], entries.low[le][e], entries.high[le][e]
        gap = np.maximum(np.maximum(plow - ehigh, elow - phigh), 0)
        least, most = (gap * gap).sum(1), (np.maximum(phigh - elow, ehigh - plow) ** 2).sum(1)
        group = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(p)))
        keep = least <= np.minimum.reduceat(most, heads)[group]
        if le == entries.levels:  # single entries: what each is nearer by than the likeliest one, at most, over the box
            likely = np.lexsort((e, most, group))[heads]
            a, b = book[own[e[likely]]][group], book[own[e]]
            slope = 2 * (b - a)
            worst = (np.maximum(slope * plow, slope * phigh) + a * a - b * b).sum(1)
            lower = own[e[likely]][group] < own[e]
            keep &= ~((worst < 0) | (worst == 0) & lower) | (e == e[likely][group])
        p, e, group = p[keep], e[keep], group[keep]
        ends = parts.ends(lp)
        if le == entries.levels:
            alone = np.bincount(group, minlength=len(heads))[group] == 1
            whole, to = p[alone], own[e[alone]]
            size = ends[whole + 1] - ends[whole]
            np.add.at(count, to, size)
            np.add.at(sums, to, parts.sums[lp][whole])
            at = np.repeat(ends[whole] - np.cumsum(size) + size, size) + np.arange(size.sum())
            code[at] = np.repeat(to, size)
            p, e = p[~alone], e[~alone]
            if lp == parts.levels:
                size = ends[p + 1] - ends[p]
                at = np.repeat(ends[p] - np.cumsum(size) + size, size) + np.arange(size.sum())
                to = np.repeat(own[e], size)
                apart = ((parts.points[at] - book[to]) ** 2).sum(1)
                exact += len(at)
                first = np.lexsort((to, apart, at))
                first = first[np.flatnonzero(np.diff(at[first], prepend=-1))]
                code[at[first]] = to[first]
                np.add.at(count, to[first], 1)
                np.add.at(sums, to[first], parts.points[at[first]])
                break
        # children: those of a part node stay together
        if lp < parts.levels:
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            n = np.diff(starts, append=len(p))
            at = np.repeat(np.repeat(starts, 2) - np.cumsum(np.repeat(n, 2)) + np.repeat(n, 2), np.repeat(n, 2)) + np.arange(2 * len(p))
            p, e, lp = 2 * p[at] + np.repeat(np.tile([0, 1], len(n)), np.repeat(n, 2)), e[at], lp + 1
        if le < entries.levels:
            p, e, le = np.repeat(p, 2), np.repeat(2 * e, 2) + np.tile([0, 1], len(e)), le + 1
            e_ends = entries.ends(le)
            full = e_ends[e] < e_ends[e + 1]
            p, e = p[full], e[full]
    return code, count, sums, exact


def kind_of(m: np.ndarray) -> str:
    top = int(np.abs(m).max(initial=0))
    return next(k for k, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 64)) if top < most)


def _pack(m: np.ndarray, parts: int) -> list[bytes]:
    """A block's trees: (levels, order, component type, points, boxes and sums of all nodes) of each part position."""
    out = []
    for x in np.split(m, parts, axis=1):
        t = Tree.of(np.ascontiguousarray(x), LEAF)
        kind = kind_of(t.points)
        boxes = np.concatenate([*t.low, *t.high]).astype(kind).tobytes()
        head = np.array([t.levels, ("<i2", "<i4", "<i8").index(kind)], "<i8").tobytes()
        out.append(head + t.order.astype("<i4").tobytes() + t.points.astype(kind).tobytes() + boxes + np.concatenate(t.sums).astype("<i8").tobytes())
    return out


def _unpack(raw: bytes, n: int, width: int) -> Tree:
    levels, kind = np.frombuffer(raw, "<i8", 2)
    kind, at, nodes = np.dtype(("<i2", "<i4", "<i8")[kind]), 16, (2 << int(levels)) - 1

    def take(dtype, *shape) -> np.ndarray:
        nonlocal at
        size = int(np.prod(shape))
        out = np.frombuffer(raw, dtype, size, at).reshape(shape).astype("i8")
        at += size * np.dtype(dtype).itemsize
        return out

    order, points = take("<i4", n), take(kind, n, width)
    cuts = np.cumsum([1 << i for i in range(int(levels))])
    low, high, sums = (np.split(take(k, nodes, width), cuts) for k in (kind, kind, "<i8"))
    return Tree(points, order, int(levels), low, high, sums)


def blocks(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """Written table of blocks of ``vectors`` (kept, v): the rows' kept columns, and their trees. Rows stay in the tasks that
    read them."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    field_ = vectors.schema["kept"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            v = t["v"].combine_chunks()
            lengths, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
            m = np.zeros((len(v), width), "i8")
            m[np.arange(width) < lengths[:, None]] = flat
            kept = t["kept"].combine_chunks()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.array([_pack(m, parts)], pa.list_(pa.binary()))], ["kept", "trees"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                if held and sum(b.num_rows for b in held) + piece.num_rows > rows:
                    yield block()
                    held = []
                if piece.num_rows:
                    held.append(piece)
        if held:
            yield block()

    with batches_of(vectors.sparkSession, rows):
        return cut(vectors.mapInArrow(pack, f"kept array<{field_}>, trees array<binary>"), "blocks")


@dataclass
class Codes:
    """``rows``: the columns kept, code (array of entry indexes) and error of each vector. ``books``: parts x entries x width."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: dict[str, Column] | None = None,
             scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codes:
    """Codes of the vectors that take part, after ``rounds`` rounds."""
    spark = df.sparkSession
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    vectors = df.filter(v.isNotNull()).filter(finite).select(packed(keep).alias("kept"), F.col(id_col).alias("id"), ints.alias("v"))
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    first = vectors.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    start = np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in first], "i8").reshape(len(first), width)
    books = np.stack(np.split(start, parts, axis=1))
    table = blocks(vectors.select("kept", "v"), width, parts)
    part = width // parts

    def trees(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[Tree]]]:
        for i in range(batch.num_rows):
            kept = batch["kept"].slice(i, 1).flatten()
            yield kept, [_unpack(raw.as_buffer(), len(kept), part) for raw in batch["trees"].slice(i, 1).flatten()]

    for _ in range(rounds if len(first) else 0):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(sent.value.shape[:2], "i8"), np.zeros(sent.value.shape, "i8")
            for batch in batches:
                for _, every in trees(batch):
                    for i, t in enumerate(every):
                        _, n, s, _ = nearest(t, sent.value[i])
                        count[i] += n
                        total[i] += s
            if count.any():
                flat = np.concatenate([count[..., None], total], axis=2).reshape(-1, part + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype="i4")), pa.array(list(flat), pa.list_(pa.int64()))], ["entry", "sums"])

        with batches_of(spark, 1):
            got = table.mapInArrow(sums, "entry int, sums array<bigint>").select("entry", F.posexplode("sums").alias("i", "x"))
            got = got.groupBy("entry", "i").agg(F.sum("x").alias("x")).collect()  # (part, entry, component): bounded by parameters
        flat = np.zeros((books.shape[0] * books.shape[1], part + 1), "i8")
        for r in got:
            flat[r["entry"], r["i"]] = r["x"]
        used = flat[:, 0] > 0
        fresh = books.reshape(-1, part).copy()
        fresh[used] = flat[used, 1:] // flat[used, :1]
        books = fresh.reshape(books.shape)
    sent = spark.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept, every in trees(batch):
                code, error = np.zeros((len(kept), parts), "i4"), np.zeros(len(kept), "i8")
                for i, t in enumerate(every):
                    got = nearest(t, sent.value[i])[0]
                    code[t.order, i] = got
                    error[t.order] += ((t.points - sent.value[i][got]) ** 2).sum(1)
                ends = pa.array(np.arange(0, code.size + 1, parts, dtype="i4"))
                yield pa.RecordBatch.from_arrays([kept, pa.ListArray.from_arrays(ends, pa.array(code.ravel())), pa.array(error)], ["kept", "code", "error"])

    with batches_of(spark, 1):  # a row is a whole block
        rows = cut(table.mapInArrow(codes, f"kept {vectors.schema['kept'].dataType.simpleString()}, code array<int>, error bigint"), "codes")
    return Codes(rows.select(*unpacked(keep), "code", "error"), books)


def with_group_sum(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """``rows`` (a written table) with the sum of ``value`` over all rows of equal ``by``, nulls together."""
    sums = cut(rows.groupBy(F.col(by).alias("_by")).agg(F.sum(value).alias(out)), "sums")
    return rows.join(small(sums), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
