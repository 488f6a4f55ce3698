"""Quarantines: odd lines, one pass over the lines, functions that fail."""

import pandas as pd
from pyspark.sql import functions as F

from foldlake.operators.per_structure import per_structure
from foldlake.sources import checked
from foldlake.sources import lines as L


def _lines(spark, *lines):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)], L.LINES).repartition(2)


def test_reasons_line_by_line(spark):
    good, bad = checked.scan(_lines(spark, ">x", "AC D", "", None, "A1", ">", "ef*"), checked.sequences())
    assert [(r.header, r.sequence) for r in good.collect()] == [(">x", "ACDef*")]
    assert sorted((r.line_no, r.line, r.reason) for r in bad.collect()) == [(3, None, "empty"), (4, "A1", "letters"), (5, ">", "empty header")]
    good, bad = checked.scan(_lines(spark, "1 3", "# note", "2 x", "3", "x 4", "4 -1", "5 1", " "), checked.size_weights())
    assert {r["size"]: r.prob for r in good.collect()} == {1: 0.75, 5: 0.25}
    assert {r.line_no: r.reason for r in bad.collect()} == {2: "weight", 3: "fields", 4: "size", 5: "weight"}
    good, bad = checked.scan(_lines(spark, "a,1.5", "a,b", "a", "a,1,2", ""), checked.table("n string, v double"))
    assert [r.v for r in good.collect()] == [1.5] and bad.count() >= 3
    good, bad = checked.scan(_lines(spark, '{"a": {"fasta": "AC"}}', "{", None, '["x"]', "{}"), checked.database())
    assert [(r.segment_id, r.fasta) for r in good.collect()] == [("a", "AC")]
    assert {r.line_no: r.reason for r in bad.collect()} == {1: "no object", 2: "empty", 3: "no object"}


def test_lines_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    lines = _lines(spark, *["1 3"] * 50, "x").mapInPandas(count, L.LINES)
    good, bad = checked.scan(lines, checked.size_weights())
    assert (good.count(), bad.count(), seen.value) == (50, 1, 51)


def test_empty_tables(spark):
    none = _lines(spark, "x").filter("line_no > 5")
    for form in (checked.sequences(), checked.eight_classes(), checked.eight_classes(True), checked.four_classes(), checked.size_weights(), checked.loops(), checked.table("a int"), checked.database()):
        good, bad = checked.scan(none, form)
        assert good.count() == 0 and bad.count() == 0


def test_per_structure_sets_failures_aside(spark):
    rows = [(k, i, "t" * 50) for k in (1, 2, 3, 5, None) for i in range(5)] + [(4, i, "t" * 1000) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, i int, reason string").repartition(4)

    def fn(part: pd.DataFrame) -> pd.DataFrame:
        k = part["k"].iloc[0]
        if k == 2:
            raise KeyError("two")
        if k == 3:
            return pd.DataFrame({"other": [1]})
        return pd.DataFrame({"good": [k] * 2, "order": [",".join(map(str, part["i"]))] * 2}) if k != 5 else pd.DataFrame({"good": [], "order": []})

    good, bad = per_structure(df, fn, "good double, order string", key="k", order=["i"], most_bytes=100_000)
    assert sorted(((r.good, r.order) for r in good.collect()), key=str) == sorted([(1.0, "0,1,2,3,4")] * 2 + [(None, "0,1,2,3,4")] * 2, key=str)
    reasons = {r.k: r.reason for r in bad.collect()}
    assert set(reasons) == {2, 3, 4} and reasons[2] == "KeyError: 'two'" and reasons[3].startswith("KeyError") and reasons[4] == "too large"
    good, bad = per_structure(df.filter(F.lit(False)), fn, "good double, order string", key="k")
    assert good.count() == 0 and bad.count() == 0


def test_totals_are_rounded_as_in_sql(spark):
    """0.5095 and 0.0635 as doubles: a thousand times them is below and at a half."""
    import duckdb

    from foldlake.plans.quarantine_queries import _report

    given = {"a": [0.0632, 0.0887, 0.0509, 0.09, 0.0716, 0.1305, 0.0054, 0.0092], "b": [0.0635], "c": [-0.5095], "d": [0.25, 0.25]}
    good = spark.createDataFrame([(k, x) for k, v in given.items() for x in v], "source string, x double").coalesce(1)
    none = spark.createDataFrame([], "source string, reason string")
    sql = {k: duckdb.execute("select round(list_sum($1), 3) + 0.0", [v]).fetchone()[0] for k, v in given.items()}
    assert {r.source: r.total for r in _report(good, F.col("x"), none).collect()} == sql
    assert sql["a"] == 0.509
