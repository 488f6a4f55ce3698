"""Similarity join of documents by the Jaccard similarity of their word n-grams, with multiple-global-order filtering.

Documents with equal n-gram sets form a class; the join works on classes, each named by the row of one of its members.
Two classes whose similarity reaches the threshold share a token among the first ``p = n - ceil(threshold * n) + 1`` of
each, under any order of all tokens. Three orders are used, each rare-first over all tokens of the corpus: under order k
tokens stand by the count of their cell in table k, then by hash. The tables have 2 ** CELL_BITS cells each, whatever the
input, so they may be broadcast; they count every token of every document, in cells that differ from table to table.
Tokens that share a cell only blur an order, which stays one and the same for all classes.

A token that is alone in its cell is in one document only and needs no look-up. Candidates share a prefix token under the
first order, where their places and sizes must still allow the threshold; their prefixes must meet under the second and
the third order too, and the parity bit maps of the sets must not differ in more bits than sets so alike do in tokens.
What passes all filters is verified on the full sets.

A large group of alike documents is not expanded into pairs. In each bucket (the classes with one prefix token) all are
compared with one pivot first, and the links give components. While that lowers the comparisons left by a quarter, the
classes outside the largest component of a bucket are dealt, by size and by a hash that differs from round to round, into
some of about SHARE classes; each is compared with two pivots of its own: one of the largest component, one of the others.
Pivots are those in which the token stands earliest: with few rare tokens before it, they are nearest to what all have in
common. Then the classes outside the largest component of
a bucket are compared with all classes of other components, in blocks of bounded size. Pairs of one component need no
comparison: they cannot change it. Components come by large-star and small-star rounds. Where links are to be counted,
all pairs of classes of a component are verified: its classes are dealt into blocks, and a task counts the links of two
blocks, whose pairs are never rows. Links of different components cannot be.

Defined results: a null or empty text, or one of white space, has no n-grams, is in no class and linked with nothing. A
text with fewer words than n has one n-gram, all its words. Repeated rows are in one class. A null id is a member like
others but names no component; a component of null ids only is null. Texts are read whole. Tokens are 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, cut, small, text_batches, work_of
from .decontaminate import MIX, Words

#: Bytes of words: all but white space; A-Z become a-z.
TABLE = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if chr(b) in UPPER else b for b in range(256))
MAP_BITS = 256
#: Tables of counts, one for each order; cells of a table; parts that a table is summed in.
ORDERS, CELL_BITS, PARTS = 3, 21, 32
#: Rows up to which the classes' representatives, and a table of (token, pivot), are broadcast.
ROWS = 1_000_000
#: Words of 64 bits, as a power of two, of the largest bitmap of shared tokens.
MARKS = 20
#: Comparisons left, as a multiple of the rows in buckets, up to which buckets take no further pivots.
LEFT = 16
#: Classes of a bucket, in expectation, that share their pivots.
SHARE = 32
#: Classes of a bucket that one block of comparisons takes.
BUCKET = 512
#: Classes and tokens of a block in which links are counted, in expectation; tokens multiplied at once.
BLOCK, TOKENS, COLUMNS = 256, 1 << 18, 4096


@dataclass(frozen=True)
class Threshold:
    """num / den."""

    num: int
    den: int

    def prefix(self, n: int) -> int:
        return n + (-n * self.num) // self.den + 1

    def linked(self, inter: Column, a: Column, b: Column) -> Column:
        return inter * self.den >= (a + b - inter) * self.num

    def sizes(self, a: Column, b: Column) -> Column:
        return (a * self.den >= b * self.num) & (b * self.den >= a * self.num)

    def cell(self, n: Column, shift: float) -> Column:
        """Sizes of one cell can reach it; those at a cell's end lie within another one if that is shifted by a half."""
        return n if self.num == self.den else F.floor(F.log(n) / math.log(self.den / self.num) + shift)

    def differ(self, a: Column, b: Column, differ: Column) -> Column:
        """Whether sets of a and b tokens that differ in ``differ`` at least can reach it."""
        return differ * (self.den + self.num) <= (a + b) * (self.den - self.num)

    def places(self, a: Column, i: Column, b: Column, j: Column) -> Column:
        """Whether sets whose first common token is at places i and j (from 0) can reach it."""
        return F.least(a - i, b - j) * (self.den + self.num) >= (a + b) * self.num


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    w = Words(text, TABLE).hashes
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, "u8")
    for j in range(k):
        h = (h ^ (h >> np.uint64(32))) * MIX[2] + w[j : j + len(h)]
    h = (h ^ (h >> np.uint64(31))) * MIX[0]
    return np.unique((h ^ (h >> np.uint64(29))) * MIX[1])


def class_of(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def parity_map(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(MAP_BITS - 1)).astype("i8"), minlength=MAP_BITS) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def _cells(tokens: np.ndarray, order: int) -> np.ndarray:
    return ((tokens >> np.uint64(21 * order)) & np.uint64((1 << CELL_BITS) - 1)).astype("i8")


def _counts(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """ORDERS tables of 1 << CELL_BITS cells, two bytes each: 1024 * log2(1 + documents' tokens in the cell), rounded."""
    width = (1 << CELL_BITS) // PARTS

    @work_of("jaccard")
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((ORDERS, 1 << CELL_BITS), "u4")
        for batch in batches:
            tokens = np.concatenate([shingles(text, n) for text in batch["text"]] or [np.zeros(0, "u8")])
            for k in range(ORDERS):
                np.add.at(table[k], _cells(tokens, k), np.uint32(1))
        for k in range(ORDERS):
            out = []
            for part in range(PARTS):
                piece = table[k, part * width : (part + 1) * width]
                at = np.flatnonzero(piece)
                if len(at):
                    gaps, times = np.diff(at, prepend=0).astype("<u2"), piece[at].astype("<u1" if piece.max() < 256 else "<u4")
                    out.append((k, part, zlib.compress(gaps, 1), zlib.compress(times, 1)))
            yield pd.DataFrame(out, columns=["k", "part", "cells", "times"])

    @work_of("jaccard")
    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                into = sums.setdefault((r.k, r.part), np.zeros(width, "u8"))
                at, times = np.cumsum(np.frombuffer(zlib.decompress(r.cells), "<u2"), dtype="i8"), zlib.decompress(r.times)
                into[at] += np.frombuffer(times, "<u1" if len(times) == len(at) else "<u4")
        logs = [np.rint(1024 * np.log2(1.0 + x)).astype("<u2").tobytes() for x in sums.values()]
        yield pd.DataFrame({"k": [k for k, _ in sums], "part": [p for _, p in sums], "logs": logs})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "k int, part int, cells binary, times binary")
    parts = counted.repartition("k", "part").mapInPandas(add_up, "k int, part int, logs binary")
    out = np.zeros((ORDERS, 1 << CELL_BITS), "u2")
    for r in parts.collect():  # at most ORDERS * PARTS rows, 2 bytes a cell
        out[r["k"], r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["logs"], "<u2")
    return out


def _sets(docs: DataFrame, counts: np.ndarray, n: int, t: Threshold, id_col: str, text_col: str) -> DataFrame:
    """Written table (doc_id, _t, n, cid, map, h, at, o2, o3, row): h are the prefix tokens under the first order and at
    their places, o2 and o3 those (32 bits of each) under the others, all without tokens that are alone in their cell;
    row numbers the rows."""
    alone = 1024  # of a count of 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ("n", "cid", "map", "h", "at", "o2", "o3")

    def of(text: str | None) -> tuple:
        s = shingles(text, n)
        p = t.prefix(len(s)) if len(s) else 0
        prefixes = []
        for k in range(ORDERS):
            rare = counts[k][_cells(s, k)]
            order = np.lexsort((s, rare))[:p]
            kept = np.flatnonzero(rare[order] > alone)
            prefixes.append((s[order[kept]], kept))
        (h, at), *more = prefixes
        return (len(s), class_of(s), parity_map(s), h.view("i8"), at.astype("i4"), *[x.astype("u4").view("i4") for x, _ in more])

    @work_of("jaccard")
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [of(text) for text in batch["text"]]
            yield batch[["doc_id", "_t"]].assign(**{c: [x[i] for x in out] for i, c in enumerate(names)})

    schema = f"doc_id {id_type}, _t bigint, n bigint, cid binary, map array<bigint>, h array<bigint>, at array<int>, o2 array<int>, o3 array<int>"
    return cut(rows.mapInPandas(sets, schema).withColumn("row", F.monotonically_increasing_id()), "sets")


def _differ(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(MAP_BITS // 64)), F.lit(0))


def _candidates(pairs: DataFrame, info: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """Written table of the pairs (a, b) that sizes, bit maps, and the second and third order leave. Prefixes are wide, so
    they are fetched only for what the narrow filters leave."""
    for side in ("a", "b"):
        pairs = pairs.join(info.select(F.col("row").alias(side), F.struct("n", "map").alias(f"_{side}")), side)
    x, y = (lambda c: F.col(f"_a.{c}")), (lambda c: F.col(f"_b.{c}"))
    may = t.sizes(x("n"), y("n")) & t.differ(x("n"), y("n"), _differ(x("map"), y("map")))
    pairs = cut(pairs.filter(may).select("a", "b"), "alike")
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ends")
    wide = sets.select("row", F.struct("o2", "o3").alias("o")).join(small(ends, ROWS), "row", "left_semi")
    for side in ("a", "b"):
        pairs = pairs.join(wide.withColumnsRenamed({"row": side, "o": f"_{side}"}), side)
    meet = F.arrays_overlap("_a.o2", "_b.o2") & F.arrays_overlap("_a.o3", "_b.o3")
    return cut(pairs.filter(meet).select("a", "b"), "candidates")


@dataclass
class _Whole:
    """The full sets of classes, read from their texts when first wanted."""

    docs: DataFrame
    sets: DataFrame
    n: int
    id_col: str
    text_col: str
    held: DataFrame | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        """(row, s) for the classes in ``rows`` (row) at least; written."""
        n, rows = self.n, rows.distinct()
        if self.held is not None:
            rows = rows.join(self.held.select("row"), "row", "left_anti")
        keys = self.sets.select(F.col("doc_id").alias("_i"), F.col("_t").alias("_u"), "row")
        chosen = cut(keys.join(rows, "row", "left_semi"), "chosen")
        if self.held is not None and chosen.isEmpty():
            return self.held
        d = self.docs.select(F.col(self.id_col).alias("_d"), F.xxhash64(self.text_col).alias("_t"), F.col(self.text_col).alias("text"))
        d = d.join(small(chosen, ROWS), F.col("_d").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_u")))

        @work_of("jaccard")
        def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[["row"]].assign(s=[shingles(x, n).view("i8") for x in batch["text"]])

        more = cut(d.select("row", "text").mapInPandas(full, "row bigint, s array<bigint>").dropDuplicates(["row"]), "whole")
        self.held = more if self.held is None else self.held.unionByName(more)
        return self.held


def _verified(pairs: DataFrame, whole: _Whole, t: Threshold) -> DataFrame:
    """Written table of the pairs (a, b) that reach the threshold."""
    if pairs.isEmpty():
        return pairs
    sets = whole.of(pairs.select(F.explode(F.array("a", "b")).alias("row")))
    x = pairs.join(sets.select(F.col("row").alias("a"), F.col("s").alias("x")), "a")
    both = x.join(sets.select(F.col("row").alias("b"), F.col("s").alias("y")), "b")
    inter = F.size(F.array_intersect("x", "y"))
    return cut(both.filter(t.linked(inter, F.size("x"), F.size("y"))).select("a", "b"), "links")


def _starred(edges: DataFrame) -> bool:
    """Whether every end v has one m, which is no v itself."""
    chained = edges.join(edges.select(F.col("m").alias("v")).distinct(), "v", "left_semi").select("v")
    return chained.unionByName(edges.groupBy("v").count().filter("count > 1").select("v")).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(row, root) for every end of the links (a, b): root is the least end of its component. Large-star and small-star
    rounds, each written, until the edges are stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct(), "edges")
    while not _starred(edges):
        both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("l")).select("v", F.least("v", "l").alias("l"))
        large = both.join(least, "v").filter(F.col("m") > F.col("v")).select(F.col("m").alias("v"), F.col("l").alias("m"))
        edges = cut(large.filter("v <> m").distinct(), "edges")
        least = edges.groupBy("v").agg(F.min("m").alias("l"))
        low = edges.join(least, "v").select(F.col("m").alias("v"), F.col("l").alias("m"))
        edges = cut(low.unionByName(least.select("v", F.col("l").alias("m"))).filter("v <> m").distinct(), "edges")
    roots = edges.select(F.col("m").alias("row"), F.col("m").alias("root")).distinct()
    return edges.select(F.col("v").alias("row"), F.col("m").alias("root")).unionByName(roots)


def _grouped(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Written table: the rows of ``shared`` in buckets of more than one group, with g, the group, and main, the bucket's
    largest group."""
    g = shared.join(roots, "row", "left").withColumn("g", F.coalesce("root", "row")).drop("root")
    parts = g.groupBy("h", "g").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("h").agg(F.max(F.struct("m", "g")).alias("x"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    return cut(g.join(main.select("h", F.col("x.g").alias("main")), "h"), "grouped")


def _star(grouped: DataFrame, t: Threshold, turn: int) -> DataFrame:
    """Pairs (a, b) of each class outside its bucket's largest group with its two pivots, as far as these are of other groups."""
    share = F.pmod(F.xxhash64("h", "row", F.lit(turn)), F.ceil(F.col("k") / SHARE))
    dealt = grouped.withColumns({"cell": t.cell(F.col("n"), turn % 2 / 2), "share": share})
    pivot, in_main = F.struct((F.col("at") / F.col("n")).alias("early"), "row", "n", "at", "g"), F.col("g") == F.col("main")
    pivots = dealt.groupBy("h", "cell", "share").agg(F.min(F.when(in_main, pivot)).alias("p"), F.min(F.when(~in_main, pivot)).alias("q"))
    may = lambda p: (F.col("g") != p["g"]) & t.sizes(F.col("n"), p["n"]) & t.places(F.col("n"), F.col("at"), p["n"], p["at"])
    both = dealt.filter(~in_main).join(pivots, ["h", "cell", "share"]).select("row", F.explode(F.filter(F.array("p", "q"), may)).alias("p"))
    return both.select(*_pairs(F.col("row"), F.col("p.row"))).distinct()


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _marked(tokens: DataFrame, often: DataFrame) -> DataFrame:
    """``tokens`` without most of those that are not in ``often``, a written table too large to be broadcast for the join
    that follows: that moves the others no more. A bitmap of about 8 bits for each token of ``often`` is broadcast, as rows of 64 bits;
    beyond 2 ** MARKS rows it fills up and passes more. Smaller tables are broadcast themselves."""
    n = often.count()
    if n <= ROWS:
        return tokens
    words = 1 << min(MARKS, (n // 8).bit_length())
    word = F.shiftrightunsigned("h", 38).bitwiseAND(F.lit(words - 1))
    bit = F.expr("shiftleft(1L, int(shiftrightunsigned(h, 58)))")
    marks = cut(often.groupBy(word.alias("_w")).agg(F.bit_or(bit).alias("_bits")), "marks")
    return tokens.withColumn("_w", word).join(F.broadcast(marks), "_w").filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_w", "_bits")


def _links(sets: DataFrame, whole: _Whole, t: Threshold) -> DataFrame:
    """Pairs (a, b) of classes that connect all components."""
    first = cut(sets.filter(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("row").alias("row")).select("row"), "first")
    classes = sets.join(small(first, ROWS), "row", "left_semi")
    tokens = classes.select("row", "n", F.explode(F.arrays_zip("h", "at")).alias("x")).select("row", "n", "x.h", "x.at")
    often = cut(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("row").alias("pivot")).filter("k > 1"), "often")
    shared = cut(_marked(tokens, often).join(small(often, ROWS), "h"), "shared")
    info = cut(classes.select("row", "n", "map").join(shared.select("row").distinct(), "row", "left_semi"), "info")

    near = t.sizes(F.col("n"), F.col("p.n")) & t.places(F.col("n"), F.col("at"), F.col("p.n"), F.col("p.at"))
    pivots = shared.filter("row = pivot").select("h", F.struct("row", "n", "at").alias("p"))
    tried = cut(shared.filter("row <> pivot").join(pivots, "h").filter(near).select(*_pairs(F.col("row"), F.col("p.row"))).distinct(), "tried")
    links = _verified(_candidates(tried, info, sets, t), whole, t)
    shared, before, turn = shared.drop("pivot"), None, 0
    while True:
        grouped = _grouped(shared, components(links))
        outside = F.count(F.when(F.col("g") != F.col("main"), 1))
        sizes = grouped.groupBy("h", "k").agg(outside.alias("u"))
        left, rows = sizes.agg(F.coalesce(F.sum(F.col("u") * F.col("k")), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
        if left <= LEFT * rows or (before is not None and 4 * left > 3 * before):  # more pivots would not help much
            break
        before, turn = left, turn + 1
        star = cut(_star(grouped, t, turn).join(tried, ["a", "b"], "left_anti"), "star")
        tried = tried.unionByName(star)
        links = links.unionByName(_verified(_candidates(star, info, sets, t), whole, t))
    if not left:
        return links

    g = grouped.join(info.select("row", "map"), "row").withColumn("blocks", F.ceil(F.col("k") / BUCKET).cast("int"))
    one = F.struct("row", "n", "at", "map", "g").alias("r")
    a = g.filter("g <> main").select("h", one, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    b = g.select("h", one, (F.col("g") == F.col("main")).alias("in_main"), F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"))
    a, b = a.withColumnRenamed("r", "x"), b.withColumnRenamed("r", "y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    may = t.sizes(x("n"), y("n")) & t.places(x("n"), x("at"), y("n"), y("at")) & t.differ(x("n"), y("n"), _differ(x("map"), y("map")))
    rest = a.join(b, ["h", "block"]).filter((x("g") != y("g")) & (F.col("in_main") | (x("row") < y("row"))) & may)
    rest = cut(rest.select(*_pairs(x("row"), y("row"))).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    return links.unionByName(_verified(_candidates(rest, info, sets, t), whole, t))


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Tokens in common of each set of x with each of y."""
    size = [sum(map(len, z)) for z in (x, y)]
    _, token = np.unique(np.concatenate(x + y), return_inverse=True)
    out = np.zeros((len(x), len(y)), "i8")
    owner = [np.repeat(np.arange(len(z)), [len(s) for s in z]) for z in (x, y)]
    token = [token[: size[0]], token[size[0] :]]
    both = np.intersect1d(*token)
    for k in range(0, len(both), COLUMNS):
        some, dense = both[k : k + COLUMNS], []
        for z in (0, 1):
            at = np.searchsorted(some, token[z]).clip(max=len(some) - 1)
            here = some[at] == token[z]
            m = np.zeros((len(out) if z == 0 else len(out[0]), len(some)), "f4")
            m[owner[z][here], at[here]] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype("i8")
    return out


def _degrees(rooted: DataFrame, whole: _Whole, t: Threshold) -> DataFrame:
    """Written table (row, d): documents of other classes linked with the class. ``rooted``: (row, root, w, n), a row for
    each class of w documents and n tokens."""
    groups = cut(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("of"), F.sum("n").alias("k")).filter("m > 1"), "link_groups")
    member = rooted.join(small(groups), "root")
    two = member.filter("m = 2").select("row", (F.col("of") - F.col("w")).alias("d"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("k") / TOKENS)).cast("int")
    many = member.filter("m > 2").select("row", "root", "w", blocks.alias("blocks"), F.pmod(F.xxhash64("row"), blocks).cast("int").alias("block"))
    many = many.join(whole.of(many.select("row")), "row")
    many = many.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("root", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "row", "w", "s")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        x, y = rows[rows["block"] == i], rows[rows["block"] == j]
        if not len(x) or not len(y):
            return pd.DataFrame({"row": [], "d": []})
        a, b = np.array([len(s) for s in x["s"]])[:, None], np.array([len(s) for s in y["s"]])[None, :]
        inter = _common(list(x["s"]), list(y["s"]))
        linked = inter * t.den >= (a + b - inter) * t.num
        if i == j:
            np.fill_diagonal(linked, False)
        out = pd.DataFrame({"row": x["row"], "d": linked @ y["w"].to_numpy()})
        return out if i == j else pd.concat([out, pd.DataFrame({"row": y["row"], "d": linked.T @ x["w"].to_numpy()})])

    counted = many.groupBy("root", "i", "j").applyInPandas(count, "row bigint, d bigint")
    return cut(two.unionByName(counted).groupBy("row").agg(F.sum("d").alias("d")), "degrees")


def similar_groups(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """A row for each document: doc_id, _t (hash of the text), n_shingles, component_id (the least id reachable by links);
    with ``count_links`` also n_links, the number of other documents linked with it, copies included."""
    t = Threshold(num, den)
    text_batches(docs.sparkSession)
    sets = _sets(docs, _counts(docs, n, text_col), n, t, id_col, text_col)
    whole = _Whole(docs, sets, n, id_col, text_col)
    roots = components(_links(sets, whole, t))
    members = sets.filter(F.col("cid").isNotNull()).groupBy("cid")
    classes = members.agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("w"), F.max("n").alias("n"))
    rooted = cut(classes.join(roots, "row", "left").filter("w > 1 or root is not null").withColumn("root", F.coalesce("root", "row")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(named, "root").select("row", "cid", "component_id", "w")
    links = F.lit(0).cast("long")
    if count_links:
        names = names.join(_degrees(rooted, whole, t), "row", "left").withColumn("n_links", F.col("w") - 1 + F.coalesce("d", F.lit(0)))
        links = F.coalesce("n_links", links)
    names = small(cut(names.drop("w", "d", "row").withColumnRenamed("cid", "_c"), "names"), ROWS)
    out = sets.select("doc_id", "_t", "n", "cid").join(names, F.col("cid") == F.col("_c"), "left")
    own = F.when(F.col("_c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "_t", F.col("n").alias("n_shingles"), own.alias("component_id"), *([links.alias("n_links")] if count_links else []))
