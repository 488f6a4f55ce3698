"""Scans with a quarantine: every line is parsed once, tagged with what is wrong with it, and routed to one of two tables.

A format says, for a line, which of its lines count at all, the parsed row, and a reason if the row cannot be used; and how
rows become the scan's result. ``scan`` writes tagged lines once, with the tag as partition column: the good part holds the
parsed rows, the bad part the lines themselves with their reasons, and either is read alone. What needs neighbours (shares,
next angles, sequences of several lines) is worked out on the good part.

Defined results: blank lines and comments are neither good nor bad where a format has such; a null line is bad (``empty``).
An empty table gives two empty ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import reports
from .sinks import new_folder


@dataclass(frozen=True)
class Format:
    """``row`` and ``reason`` are columns over (source, line_no, line); ``rows`` takes (source, line_no, row)."""

    row: Column
    reason: Column
    rows: Callable[[DataFrame], DataFrame]
    counts: Column | None = None


def scan(lines: DataFrame, form: Format) -> tuple[DataFrame, DataFrame]:
    """(the format's rows, quarantine): quarantine has source, line_no, line, reason."""
    spark = lines.sparkSession
    reason = F.when(F.col("line").isNull(), "empty").otherwise(form.reason)
    held = lines if form.counts is None else lines.filter(form.counts | F.col("line").isNull())
    tagged = held.select("source", "line_no", "line", form.row.alias("row"), reason.alias("reason"))
    good = F.col("reason").isNull()
    table = tagged.select("source", "line_no", F.when(~good, F.col("line")).alias("line"), F.when(good, F.col("row")).alias("row"), "reason", good.alias("good"))
    path = new_folder(spark, "checked")
    table.write.partitionBy("good").parquet(path)
    read = spark.read.schema(table.schema).parquet(path)
    return form.rows(read.filter("good").select("source", "line_no", "row")), read.filter("not good").select("source", "line_no", "line", "reason")


def _words() -> Column:
    return F.split(F.trim("line"), r"\s+")


def _number(i: int, kind: str = "double") -> Column:
    return F.try_element_at(_words(), F.lit(i + 1)).try_cast(kind)


def _first(*tests: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for test, reason in reversed(tests):
        out = F.when(test, reason).otherwise(out)
    return out


def sequences() -> Format:
    """source, header, sequence. Sequence lines hold letters, blanks, ``*`` and ``-``."""
    line = F.trim("line")
    head = line.startswith(">")
    bad = _first((head & (F.length(line) == 1), "empty header"), (~head & ~line.rlike(r"^[A-Za-z*\- ]+$"), "letters"))
    return Format(F.struct(line.alias("line")), bad, lambda good: reports.scan_fasta(good.select("source", "line_no", "row.line")), line != "")


def eight_classes(grouped: bool = False) -> Format:
    """source, res_id, ss, prob from lines of a residue and eight probabilities."""
    p = F.array(*[_number(i) for i in range(2, 10)])
    bad = _first((F.size(_words()) != 10, "fields"), (_number(1, "int").isNull(), "residue number"), (F.exists(p, lambda x: x.isNull()), "probability"))

    def rows(good: DataFrame) -> DataFrame:
        v = {k: F.col("row.p")[i] for i, k in enumerate(reports.EIGHT)}
        pairs = list(v.items())
        if grouped:
            pairs = [("L", F.round(v["I"] + v[" "] + v["T"] + v["S"] + v["B"], 4)), ("H", F.round(v["H"] + v["G"], 4)), ("E", v["E"])]
        return reports._long(good.withColumn("res_id", F.col("row.res_id")), ["source", "res_id"], pairs)

    return Format(F.struct(_number(1, "int").alias("res_id"), p.alias("p")), bad, rows, F.trim("line") != "")


def four_classes() -> Format:
    """source, res_id, ss, prob from lines of a residue and four probabilities; ``#`` and a number has none, and equal shares."""
    none = F.trim("line").rlike("^#+[0-9]")
    res = F.regexp_extract(_words()[0], "([0-9]+)", 1).try_cast("int")
    p = F.when(none, F.array(*[F.lit(0.25)] * 4)).otherwise(F.array(*[_number(i) for i in (2, 3, 4, 5)]))
    bad = _first((~none & (F.size(_words()) < 7), "fields"), (res.isNull(), "residue number"), (F.exists(p, lambda x: x.isNull()), "probability"))

    def rows(good: DataFrame) -> DataFrame:
        return reports._long(good.withColumn("res_id", F.col("row.res_id")), ["source", "res_id"], [(k, F.col("row.p")[i]) for i, k in enumerate(("H", "E", " ", "P"))])

    return Format(F.struct(res.alias("res_id"), p.alias("p")), bad, rows, (F.trim("line") != "") & (none | ~F.contains(F.col("line"), F.lit("#"))))


def size_weights() -> Format:
    """source, size, prob from lines of a size and a weight; shares are of the good lines."""
    size, weight = _number(0, "int"), _number(1)
    bad = _first((F.size(_words()) != 2, "fields"), (size.isNull(), "size"), (weight.isNull() | (weight < 0), "weight"))

    def rows(good: DataFrame) -> DataFrame:
        share = F.col("row.weight") / F.sum("row.weight").over(Window.partitionBy("source"))
        return good.select("source", "row.size", share.alias("prob"))

    return Format(F.struct(size.alias("size"), weight.alias("weight")), bad, rows, (F.trim("line") != "") & ~F.trim("line").startswith("#"))


def loops() -> Format:
    """chain, res_no, aa, ss, psi, omega and the next line's phi (radians); the last good line of a chain falls out."""
    angles = F.array(*[_number(i) for i in (4, 5, 6)])
    bad = _first((F.size(_words()) != 7, "fields"), (_number(3, "int").isNull(), "residue number"), (F.exists(angles, lambda x: x.isNull()), "angle"))
    return Format(F.struct(F.trim("line").alias("line")), bad, lambda good: reports.scan_loops(good.select("source", "line_no", "row.line")), F.trim("line") != "")


def table(schema: str) -> Format:
    """Rows of a CSV schema; lines with another number of cells, or with cells of another type, are bad."""
    row = F.from_csv("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return Format(row, F.when(row["_bad"].isNotNull(), "columns"), lambda good: good.select("source", "row.*").drop("_bad"), F.trim("line") != "")


def database() -> Format:
    """segment_id and the record's fields from JSON texts of {id: record}, a text a line."""
    row = F.from_json("line", f"map<string,{reports.RECORD}>")
    return Format(F.struct(row.alias("m")), F.when(row.isNull(), "no object"), lambda good: good.select("source", F.explode("row.m").alias("segment_id", "r")).select("source", "segment_id", "r.*"))
