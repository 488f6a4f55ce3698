"""Operators on ids, records and searches of the fragment database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import best_match as best_match

#: Keywords of one search.
KEYWORDS = 10_000


def merge_records(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, only left, only right): rows of both sides by key, and the keys that one side lacks."""
    return left.join(right, key), left.join(right, key, "left_anti").select(key), right.join(left, key, "left_anti").select(key)


def merge_tagged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides in one pass: key, side (both, left, right) and the columns of both, null where a side lacks the key. The rows of
    ``both`` are the merged database, the others the reports of what is dropped. Each side has a key once at most."""
    a = left.withColumnRenamed(key, "_a").withColumn("_in_a", F.lit(True))
    b = right.withColumnRenamed(key, "_b").withColumn("_in_b", F.lit(True))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    side = F.when(F.col("_in_a") & F.col("_in_b"), "both").when(F.col("_in_a"), "left").otherwise("right")
    return j.select(F.coalesce("_a", "_b").alias(key), side.alias("side"), *[c for c in (*a.columns, *b.columns) if c not in ("_a", "_b", "_in_a", "_in_b")])


def new_ids(requested: DataFrame, present: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(present.select(key), key, "left_anti").join(blocked.select(key), key, "left_anti")


def update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones whose key has no new row."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def align(records: DataFrame, exact: list[str] | None = None) -> DataFrame:
    """segment_id, aa, ss, phi, psi, omega (strings and arrays of one length) from whole records: first and last residues
    are trimmed, phi and omega drop their last value, psi its first; records whose lengths then differ fall out. ``exact``
    names further lists (bend angles, bond lengths) that hold a value for each residue kept, and must do so."""
    inner = lambda c: F.expr(f"substring({c}, 2, greatest(length({c}) - 2, 0))").alias({"fasta": "aa", "dssp": "ss"}[c])
    short = lambda c, first: F.slice(c, first, F.greatest(F.size(c) - 1, F.lit(0))).alias(c)
    t = records.select("segment_id", inner("fasta"), inner("dssp"), short("phi", 1), short("psi", 2), short("omega", 1), *(exact or []))
    k = F.length("aa")
    fits = (F.length("ss") == k) & (k > 0)
    for c in ("phi", "psi", "omega", *(exact or [])):
        fits = fits & (F.size(c) == k)
    return t.filter(fits)


def slices(aligned: DataFrame, per: int = 1000) -> DataFrame:
    """segment_id, start, stop of each record in the joined database, where records follow each other by id with one spacer
    between. Lengths are summed in two levels, of buckets of ``per`` ids and of those, so no task sees all records."""
    d = aligned.select("segment_id", F.length("aa").cast("long").alias("_n")).withColumn("_b", F.floor(F.col("segment_id") / per))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = d.groupBy("_b").agg(F.sum(F.col("_n") + 1).alias("_s")).withColumn("_r", F.floor(F.col("_b") / per))
    ranges = buckets.groupBy("_r").agg(F.sum("_s").alias("_s"))  # a row for a million ids
    ranges = ranges.select("_r", before("_s", Window.partitionBy(F.lit(0)).orderBy("_r")).alias("_first"))
    buckets = buckets.select("_b", "_r", before("_s", Window.partitionBy("_r").orderBy("_b")).alias("_before")).join(ranges, "_r")
    inside = before(F.col("_n") + 1, Window.partitionBy("_b").orderBy("segment_id"))
    start = F.col("_first") + F.col("_before") + F.col("_inside")
    return d.withColumn("_inside", inside).join(buckets, "_b").select("segment_id", start.alias("start"), (start + F.col("_n")).alias("stop"))


def header_matches(lines: DataFrame, keywords: DataFrame) -> DataFrame:
    """source, keyword: of each source the first keyword (by kw_idx) on the first line that has one, before a line with
    ``expdta`` (itself included). Both sides are lower-cased; the first line must hold ``header``."""
    low = F.lower("line")
    end = lines.withColumn("_low", low).groupBy("source").agg(F.min(F.when(F.col("_low").contains("expdta"), F.col("line_no"))).alias("end"), F.min_by("_low", "line_no").alias("first"))
    head = lines.join(end.filter(F.col("first").contains("header")), "source").filter(F.col("line_no") <= F.coalesce("end", F.lit(2**31 - 1)))
    if keywords.count() > KEYWORDS:  # each meets every line
        raise ValueError(f"more than {KEYWORDS} keywords")
    hit = head.join(F.broadcast(keywords), F.contains(low, F.lower("keyword")))
    return hit.groupBy("source").agg(F.min_by("keyword", F.struct("line_no", "kw_idx")).alias("keyword"))


def mask(seq: Column, known: Column) -> Column:
    return F.replace(seq, known, F.repeat(F.lit("*"), F.length(known).cast("int")))


def parse_id(text: Column) -> Column:
    """struct(name, chain, seg) of an entry's first word: XXXX, XXXXC..., XXXX_C, XXXX_C_segN, else any word's stem. The
    four-letter name is upper-cased, the chain not."""
    w = F.regexp_extract(F.trim(text), r"^(\S+)", 1)
    word = F.regexp_replace(w, r"\.[A-Za-z0-9]+$", "")
    part = lambda p, i: F.regexp_extract(word, p, i)
    four = r"^([0-9][A-Za-z0-9]{3})"
    null = F.lit(None).cast("string")
    make = lambda n, c, s: F.struct(n.alias("name"), c.alias("chain"), s.alias("seg"))
    return (F.when(word.rlike(four + "$"), make(F.upper(word), null, null))
            .when(word.rlike(four + "_([A-Za-z0-9]+)_(seg[0-9]+)$"), make(F.upper(part(four, 1)), part(four + "_([A-Za-z0-9]+)_(seg[0-9]+)$", 2), part(four + "_([A-Za-z0-9]+)_(seg[0-9]+)$", 3)))
            .when(word.rlike(four + "_([A-Za-z0-9]+)$"), make(F.upper(part(four, 1)), part(four + "_([A-Za-z0-9]+)$", 2), null))
            .when(word.rlike(four + "([A-Za-z0-9]+)$"), make(F.upper(part(four, 1)), part(four + "([A-Za-z0-9]+)$", 2), null))
            .otherwise(make(word, null, null)))


def id_text(parsed: Column) -> Column:
    return F.concat_ws("_", parsed["name"], parsed["chain"], parsed["seg"])
