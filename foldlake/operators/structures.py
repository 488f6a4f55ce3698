"""Operators on atom tables: filters, cleaning, numbering, sequences and splicing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.residues import ALT_LOCS, ELEMENTS, lookup, one_letter
from .broadcasts import checked

KEY = "structure_id"


class FilterStack:
    """An ordered stack of predicates on atom rows."""

    def __init__(self) -> None:
        self.predicates: list[Column] = []

    def push(self, predicate: Column) -> FilterStack:
        self.predicates.append(predicate)
        return self

    def pop(self) -> FilterStack:
        self.predicates.pop()
        return self

    def clear(self) -> FilterStack:
        self.predicates.clear()
        return self

    def apply(self, atoms: DataFrame) -> DataFrame:
        return atoms.filter(reduce(lambda a, b: a & b, self.predicates)) if self.predicates else atoms


def is_backbone(minimal: bool = False) -> Column:
    """By name and element: minimal keeps no oxygen, and calcium named CA is never kept."""
    return F.col("name").isin("N", "CA", "C", "O") & F.col("element").isin(*(["N", "C"] if minimal else ["N", "C", "O"]))


def backbone_check(atoms: DataFrame, minimum: int = 2) -> DataFrame:
    """structure_id, chain_id, reason: null if the chain's backbone labels are usable."""
    c = atoms.groupBy(KEY, "chain_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("res_seq").alias("r"), F.min_by("name", "row_idx").alias("first"), F.array_sort(F.collect_set("name")).alias("names"))
    reason = F.when(F.col("r") < minimum, "short").when(F.col("n") % 3 != 0, "count").when(F.col("first") != "N", "first").when(F.col("names") != F.array(F.lit("C"), F.lit("CA"), F.lit("N")), "labels")
    return c.select(KEY, "chain_id", reason.alias("reason"))


def clean_chains(atoms: DataFrame, requested: DataFrame, ligands: DataFrame, blocked: DataFrame) -> DataFrame:
    """Atoms of the requested (structure_id, chain) chains without ligands, odd elements and other locations. A chain whose
    spelling is not found is taken in another case, exact matches first; blocked pairs and chains of HETATM rows only
    fall out; new serials."""
    a = atoms.filter(F.col("record").isin("ATOM", "HETATM") & F.col("element").isin(*ELEMENTS) & F.coalesce(F.col("alt_loc"), F.lit("")).isin(*ALT_LOCS))
    a = a.join(checked(ligands), "res_name", "left_anti")
    have = a.select(KEY, "chain_id").distinct()
    want = requested.join(blocked, [KEY, "chain"], "left_anti")
    match = want.join(have, [KEY]).filter(F.lower("chain") == F.lower("chain_id"))
    best = F.row_number().over(Window.partitionBy(KEY, "chain").orderBy(F.desc(F.col("chain") == F.col("chain_id")), "chain_id"))
    match = match.withColumn("_b", best).filter("_b = 1").select(KEY, "chain_id").distinct()
    a = a.join(match, [KEY, "chain_id"])
    w = Window.partitionBy(KEY, "chain_id")
    a = a.withColumn("_atom", F.max((F.col("record") == "ATOM").cast("int")).over(w)).filter("_atom = 1").drop("_atom")
    return a.withColumn("serial", F.row_number().over(w.orderBy("row_idx")))


def delete_insertions(atoms: DataFrame) -> DataFrame:
    """Adds res_seq_new, without insertion codes: each residue whose (chain, number) occurred before in its structure adds
    one to the numbers of itself and of all that follow."""
    o = Window.partitionBy(KEY).orderBy("row_idx")
    same = (F.col("chain_id").eqNullSafe(F.lag("chain_id").over(o)) & (F.col("res_seq") == F.lag("res_seq").over(o)) & F.col("icode").eqNullSafe(F.lag("icode").over(o)))
    a = atoms.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    seen = F.sum("_new").over(Window.partitionBy(KEY, "chain_id", "res_seq").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0))
    a = a.withColumn("_again", F.when((F.col("_new") == 1) & (seen > 1), 1).otherwise(0))
    shift = F.sum("_again").over(o.rowsBetween(Window.unboundedPreceding, 0))
    return a.withColumn("res_seq_new", (F.col("res_seq") + shift).cast("int")).drop("_new", "_again")


def renumber(atoms: DataFrame) -> DataFrame:
    return atoms.withColumn("serial", F.row_number().over(Window.partitionBy(KEY).orderBy("row_idx")))


def rename_residues(atoms: DataFrame, names: dict[str, str]) -> DataFrame:
    """New residue names by number, for the first block of rows with that number only."""
    o = Window.partitionBy(KEY).orderBy("row_idx")
    a = atoms.withColumn("_new", F.when(F.coalesce(F.col("res_seq") == F.lag("res_seq").over(o), F.lit(False)), 0).otherwise(1))
    block = F.sum("_new").over(Window.partitionBy(KEY, "res_seq").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0))
    renamed = F.when(block == 1, lookup(F.col("res_seq").cast("string"), names))
    return a.withColumn("res_name", F.coalesce(renamed, F.col("res_name"))).drop("_new")


def chain_sequence(atoms: DataFrame) -> DataFrame:
    """structure_id, chain_id, fasta: of each residue number the first name, in order of appearance."""
    r = atoms.groupBy(KEY, "chain_id", "res_seq").agg(F.min("row_idx").alias("i"), F.min_by("res_name", "row_idx").alias("name"))
    return _joined(r, [KEY, "chain_id"])


def file_sequence(atoms: DataFrame) -> DataFrame:
    """structure_id, fasta by residue number alone: the last name, at the first place. Coordinate rows only."""
    a = atoms.filter(F.col("record").isin("ATOM", "HETATM"))
    r = a.groupBy(KEY, "res_seq").agg(F.min("row_idx").alias("i"), F.max_by("res_name", "row_idx").alias("name"))
    return _joined(r, [KEY])


def _joined(r: DataFrame, keys: list[str]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("i", one_letter(F.col("name")).alias("aa"))))
    return r.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["aa"]), "").alias("fasta"))


def element_or_name(element: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(element), F.lit("")), F.substring(name, 1, 1))


def runs_to_atoms(runs: DataFrame, atoms: DataFrame, minimum: int, names: list[str] | None = None) -> DataFrame:
    """Atoms of each structure run (id, ss, start, stop as residue numbers) of the least length, named id_ss_n, where n
    counts the runs of that structure and label."""
    n = F.row_number().over(Window.partitionBy("id", "ss").orderBy("start")) - 1
    r = runs.filter(F.col("stop") - F.col("start") >= minimum).withColumn("part", F.concat_ws("_", F.col("id").cast("string"), "ss", n.cast("string")))
    r = r.withColumn("res_seq", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    a = atoms if names is None else atoms.filter(F.col("name").isin(*names))
    return r.select(F.col("id").alias(KEY), "part", F.col("res_seq").cast("int").alias("res_seq")).join(a, [KEY, "res_seq"])


def segment_atoms(atoms: DataFrame, segments: DataFrame, minimum: int = 2) -> DataFrame:
    """Atoms split by segments (structure_id, first, last): those of at least ``minimum`` residues that are not all HETATM
    are numbered from 0 as seg_no."""
    s = segments.withColumn("res_seq", F.explode(F.sequence("first", "last"))).select(KEY, "first", F.col("res_seq").cast("int").alias("res_seq"))
    j = atoms.join(s, [KEY, "res_seq"])
    kept = j.groupBy(KEY, "first").agg(F.countDistinct("res_seq").alias("r"), F.max((F.col("record") == "ATOM").cast("int")).alias("atom")).filter((F.col("r") >= minimum) & (F.col("atom") == 1))
    kept = kept.withColumn("seg_no", F.row_number().over(Window.partitionBy(KEY).orderBy("first")) - 1).select(KEY, "first", "seg_no")
    return j.join(kept, [KEY, "first"])


def splice(template: DataFrame, segment: DataFrame, start: int, stop: int, chain: str = "A") -> DataFrame:
    """The template with residues [start, stop) replaced by the segment's: new residue numbers, serials and chain."""
    parts = [template.filter(F.col("res_seq") < start).withColumn("_part", F.lit(0)), segment.filter((F.col("res_seq") >= start) & (F.col("res_seq") < stop)).withColumn("_part", F.lit(1)), template.filter(F.col("res_seq") >= stop).withColumn("_part", F.lit(2))]
    every = reduce(DataFrame.unionByName, parts)
    o = Window.partitionBy(KEY)
    every = every.withColumn("res_new", F.dense_rank().over(o.orderBy("_part", "res_seq"))).withColumn("serial_new", F.row_number().over(o.orderBy("_part", "row_idx")))
    return every.withColumn("chain_id", F.lit(chain)).drop("_part")


def merge_ensembles(parts: list[DataFrame], prefix: str, key: str) -> DataFrame:
    """All parts in one, with running names: stable by part and key. Numbers are counted in two levels: of buckets of 1,000
    keys within ranges of a thousand buckets, and of those ranges, so that no single task sees all rows or all buckets."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    ids = every.select("_part", key).distinct().withColumn("_bucket", F.floor(F.col(key) / 1000)).withColumn("_range", F.floor(F.col("_bucket") / 1000))
    before = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ids.groupBy("_part", "_range").count()  # a row for a million keys
    ranges = ranges.withColumn("_first", before(Window.partitionBy(F.lit(0)).orderBy("_part", "_range"))).drop("count")
    sizes = ids.groupBy("_part", "_range", "_bucket").count()
    sizes = sizes.withColumn("_before", before(Window.partitionBy("_part", "_range").orderBy("_bucket"))).drop("count")
    n = F.col("_first") + F.col("_before") + F.row_number().over(Window.partitionBy("_part", "_range", "_bucket").orderBy(key))
    named = ids.join(sizes, ["_part", "_range", "_bucket"]).join(ranges, ["_part", "_range"])
    named = named.withColumn("name", F.concat(F.lit(prefix + "_"), n.cast("string"))).select("_part", key, "name")
    return every.join(named, ["_part", key]).drop("_part")
