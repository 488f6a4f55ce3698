"""Structure reports, sequences, probability tables and databases as lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.residues import reduce_ss

# Labels of the eight probability columns.
EIGHT = ["H", "G", "I", "E", " ", "T", "S", "B"]
RECORD = "struct<fasta:string,dssp:string,resids:string,phi:array<double>,psi:array<double>,omega:array<double>>"


def _runs(*new: np.ndarray) -> np.ndarray:
    """Where each run of rows begins, and the end of the last."""
    return np.append(np.flatnonzero(np.logical_or.reduce(new)), len(new[0])).astype("i4")


def _joined(strings: pa.Array, ends: np.ndarray, sep: str = "") -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), sep)


def _packed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for runs of following lines of one source, which end after each ``#`` line: their first line_no, that of the ``#``
    line, and of the lines long enough the residues, the labels, and the numbers with a newline after each."""
    for batch in batches:
        for again in (False, True):
            source, at, line = batch["source"], batch["line_no"].cast(pa.int64()).to_numpy(zero_copy_only=False), batch["line"]
            mark = pc.starts_with(pc.utf8_ltrim(line, " "), "#").to_numpy(zero_copy_only=False)
            other = np.append(True, pc.not_equal(source[1:], source[:-1]).to_numpy(zero_copy_only=False)) if len(at) else np.zeros(0, bool)
            ends = _runs(other, np.append(True, np.diff(at) != 1)[: len(at)], np.append(True, mark[:-1])[: len(at)])
            if again or len(ends) < len(at) // 4:
                break
            batch = batch.sort_by([("source", "ascending"), ("line_no", "ascending")])
        kept = pc.greater(pc.utf8_length(line), 16)
        until = np.append(0, np.cumsum(kept.to_numpy(zero_copy_only=False)))[ends]
        line = line.filter(kept)
        cut = lambda a, n: pc.utf8_slice_codeunits(line, a, a + n)  # noqa: B023, E731
        head = np.where(mark[ends[1:] - 1], at[ends[1:] - 1], -1) if len(at) else at
        number = pc.binary_join_element_wise(pc.utf8_trim(cut(6, 4), " "), "\n", "")
        yield pa.RecordBatch.from_arrays([
            source.take(pa.array(ends[:-1])), pa.array(at[ends[:-1]]), pa.array(head, mask=head < 0), _joined(cut(13, 1), until), _joined(cut(16, 1), until), _joined(number, until)],
            ["source", "first", "head", "aa", "ss", "resid"])


def _segments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of each row's whole report."""
    for batch in batches:
        row, seg, out = [], [], ([], [], [])
        for i, (aa, ss, resid) in enumerate(zip(*(batch[c].to_pylist() for c in ("aa", "ss", "resid")), strict=True)):
            numbers, at, n = resid.split("\n"), 0, 0
            for part in aa.split("!"):
                if part:
                    row.append(i)
                    seg.append(n)
                    for column, value in zip(out, (part, ss[at : at + len(part)], ",".join(numbers[at : at + len(part)])), strict=True):
                        column.append(value)
                    n += 1
                at += len(part) + 1
        yield pa.RecordBatch.from_arrays([batch["source"].take(pa.array(row, pa.int32())), pa.array(seg, pa.int32()), *[pa.array(x, pa.string()) for x in out]], ["source", "seg_no", "fasta", "dssp", "resids"])


def scan_dssp(lines: DataFrame, reduced: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, quarantine): source, seg_no, fasta, dssp, resids from report rows after the ``#`` line; a ``!`` residue
    closes a segment. Lines are packed where they lie; runs of them are shuffled, and a source's report is one row of three texts."""
    starts = lines.filter(F.trim("line").startswith("#")).groupBy("source").agg(F.min("line_no").alias("head"))
    quarantine = lines.select("source").distinct().join(starts, "source", "left_anti").withColumn("reason", F.lit("no header"))
    whole = lines.dropna(subset=["source", "line_no", "line"]).select(F.col("source").cast("string").alias("source"), "line_no", "line")
    packed = whole.mapInArrow(_packed_lines, "source string, first bigint, head bigint, aa string, ss string, resid string")
    runs = F.array_sort(F.collect_list(F.struct("first", "aa", "ss", "resid")))
    s = packed.groupBy("source").agg(F.min("head").alias("head"), runs.alias("r")).filter("head is not null")
    s = s.withColumn("r", F.filter("r", lambda x: x["first"] > F.col("head")))
    text = lambda c: F.array_join(F.transform("r", lambda x: x[c]), "").alias(c)
    found = s.select("source", text("aa"), text("ss"), text("resid")).mapInArrow(_segments_of, "source string, seg_no int, fasta string, dssp string, resids string")
    return (found.withColumn("dssp", reduce_ss(F.col("dssp"))) if reduced else found), quarantine


def scan_fasta(lines: DataFrame) -> DataFrame:
    """source, header, sequence; without a header line the header is 1; spaces fall out."""
    w = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line = F.trim("line")
    is_head = line.startswith(">")
    r = lines.withColumn("_n", F.sum(is_head.cast("int")).over(w)).withColumn("_h", F.last(F.when(is_head, line), ignorenulls=True).over(w)).filter(~is_head & (line != ""))
    s = r.groupBy("source", "_n").agg(F.first("_h").alias("_h"), F.array_sort(F.collect_list(F.struct("line_no", F.replace(line, F.lit(" "), F.lit("")).alias("t")))).alias("t"))
    return s.select("source", F.coalesce("_h", F.lit("1")).alias("header"), F.array_join(F.transform("t", lambda x: x["t"]), "").alias("sequence"))


def _long(df: DataFrame, keep: list[str], pairs: list[tuple[str, Column]]) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(k).alias("ss"), v.alias("prob")) for k, v in pairs])).alias("p")).select(*keep, "p.ss", "p.prob")


def scan_eight(lines: DataFrame, grouped: bool = False) -> DataFrame:
    """source, res_id, ss, prob from lines ``aa resid p1 ... p8``."""
    t = F.split(F.trim("line"), r"\s+")
    rows = lines.withColumn("t", t).filter(F.size("t") == 10).withColumn("res_id", F.col("t")[1].try_cast("int")).filter("res_id is not null")
    p = {k: F.col("t")[i + 2].try_cast("double") for i, k in enumerate(EIGHT)}
    pairs = list(p.items())
    if grouped:
        pairs = [("L", F.round(p["I"] + p[" "] + p["T"] + p["S"] + p["B"], 4)), ("H", F.round(p["H"] + p["G"], 4)), ("E", p["E"])]
    return _long(rows, ["source", "res_id"], pairs)


def scan_four(lines: DataFrame, grouped: bool = False) -> DataFrame:
    """source, res_id, ss, prob from lines ``resid aa H E coil PPII ss``. ``#`` and a number is a residue without
    prediction, whose labels get equal shares; other lines with ``#`` are comments."""
    t = F.split(F.trim("line"), r"\s+")
    rows = lines.filter(F.trim("line") != "").withColumn("none", F.trim("line").rlike("^#+[0-9]")).filter(F.col("none") | ~F.contains(F.col("line"), F.lit("#"))).withColumn("t", t)
    rows = rows.withColumn("res_id", F.regexp_extract(F.col("t")[0], "([0-9]+)", 1).try_cast("int")).filter("res_id is not null and (none or size(t) >= 7)")
    h, e, coil, ppii = (F.try_element_at("t", F.lit(i)).try_cast("double") for i in (3, 4, 5, 6))
    share = lambda v, equal: F.when(F.col("none"), F.lit(equal)).otherwise(v)
    if grouped:
        return _long(rows, ["source", "res_id"], [("L", share(F.round(coil + ppii, 3), 0.333)), ("H", share(h, 0.333)), ("E", share(e, 0.333))])
    return _long(rows, ["source", "res_id"], [("H", share(h, 0.25)), ("E", share(e, 0.25)), (" ", share(coil, 0.25)), ("P", share(ppii, 0.25))])


def scan_sizes(lines: DataFrame) -> DataFrame:
    """source, size, prob from lines ``size weight``, normalised."""
    t = F.split(F.trim("line"), r"\s+")
    rows = lines.filter(~F.trim("line").startswith("#")).select("source", t[0].try_cast("int").alias("size"), F.try_element_at(t, F.lit(2)).try_cast("double").alias("w")).filter("size is not null and w is not null")
    return rows.select("source", "size", (F.col("w") / F.sum("w").over(Window.partitionBy("source"))).alias("prob"))


def scan_loops(lines: DataFrame) -> DataFrame:
    """chain, res_no, aa, ss, psi, omega of each line ``chain aa ss resno phi psi omega`` with phi of the next (radians);
    the last line of a chain has no next and falls out."""
    t = F.split(F.trim("line"), r"\s+")
    r = lines.withColumn("t", t).filter(F.size("t") == 7).select(F.col("t")[0].alias("chain"), F.col("t")[1].alias("aa"), F.col("t")[2].alias("ss"), F.col("t")[3].try_cast("int").alias("res_no"), *[F.radians(F.col("t")[i].try_cast("double")).alias(c) for i, c in ((4, "phi"), (5, "psi"), (6, "omega"))])
    o = Window.partitionBy("chain").orderBy("res_no")
    return r.withColumn("next_phi", F.lead("phi").over(o)).withColumn("_last", F.lead("res_no").over(o).isNull()).filter(~F.col("_last")).select("chain", "res_no", "aa", "ss", "psi", "omega", F.col("next_phi").alias("phi"))


def scan_csv(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of a CSV schema from lines; those that do not parse are null in every column but source."""
    return lines.select("source", F.from_csv("line", schema, {"mode": "PERMISSIVE"}).alias("r")).select("source", "r.*")


def scan_database(texts: DataFrame, column: str = "json") -> DataFrame:
    """segment_id and the record's fields from JSON texts of {id: record}."""
    rows = texts.select(F.explode(F.from_json(column, f"map<string,{RECORD}>")).alias("segment_id", "r"))
    return rows.select("segment_id", "r.*")


def to_database(records: DataFrame, per_text: int = 1000) -> DataFrame:
    """JSON texts of at most about ``per_text`` records each."""
    fields = [c for c in records.columns if c != "segment_id"]
    part = F.pmod(F.xxhash64("segment_id"), F.lit(max(1, -(-records.count() // per_text))))
    entry = F.struct(F.col("segment_id").cast("string").alias("k"), F.struct(*fields).alias("v"))
    return records.groupBy(part.alias("_p")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json")).drop("_p")


def nested_probabilities(probs: DataFrame) -> DataFrame:
    """res_id and a JSON object of its labels' probabilities."""
    return probs.groupBy("res_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ss", "prob"))))).alias("json"))


def _packed_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for runs of following segments of one source."""
    for batch in batches:
        source, at = batch["source"], batch["seg_no"].to_numpy(zero_copy_only=False)
        other = np.append(True, pc.not_equal(source[1:], source[:-1]).to_numpy(zero_copy_only=False)) if len(at) else np.zeros(0, bool)
        ends = _runs(other, np.append(True, np.diff(at) != 1)[: len(at)])
        yield pa.RecordBatch.from_arrays([source.take(pa.array(ends[:-1])), pa.array(at[ends[:-1]]), _joined(batch["fasta"], ends), _joined(batch["dssp"], ends)], ["source", "seg_no", "fasta", "dssp"])


def flat_report(segments: DataFrame) -> DataFrame:
    """source, fasta, ss of all segments in a row: blanks as dashes. Segments are put together where they lie, then by source."""
    s = segments.select("source", "seg_no", "fasta", "dssp").mapInArrow(_packed_segments, "source string, seg_no int, fasta string, dssp string")
    s = s.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("seg_no", "fasta", "dssp"))).alias("s"))
    return s.select("source", F.array_join(F.transform("s", lambda x: x["fasta"]), "").alias("fasta"), F.translate(F.array_join(F.transform("s", lambda x: x["dssp"]), ""), " ", "-").alias("ss"))
