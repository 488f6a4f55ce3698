"""Structure reports against a plain reading: any order of lines, odd lines, and few rows for many lines."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from foldlake.sources import reports


def plain(lines, reduced=False):
    """{source: [(fasta, dssp, resids)]} of lines (source, line_no, line)."""
    out = {}
    for name in {s for s, _, _ in lines}:
        mine = sorted((n, x) for s, n, x in lines if s == name and x is not None)
        heads = [n for n, x in mine if x.strip(" ").startswith("#")]
        parts = [[]]
        for n, x in mine if heads else []:
            if n > heads[0] and len(x) > 16:
                if x[13] == "!":
                    parts.append([])
                else:
                    parts[-1].append((x[13], x[16], x[6:10].strip(" ")))
        out[name] = [("".join(p[0] for p in part), "".join(p[1] for p in part), ",".join(p[2] for p in part)) for part in parts if part]
    return out


def sample(seed=3, sources=12):
    rng, rows = random.Random(seed), []
    for s in range(sources):
        n = rng.randrange(0, 60)
        lines = [f"{i % 99999:5d} {i % 9999:4d} A {rng.choice('AKLM!é')}  {rng.choice('HEL ')}" for i in range(n)]
        for at in [rng.randrange(n + 1)] * (s % 3):
            lines.insert(at, rng.choice(["  #  RESIDUE AA STRUCTURE", "# x", " #"]))
        lines += ["short", "", "!" * 17, None]
        rows += [(f"s{s}", i * (1 + s % 2) + s, x) for i, x in enumerate(lines)]
    return rows


def check(spark, rows, df):
    got = {}
    for r in reports.scan_dssp(df)[0].collect():
        got.setdefault(r["source"], {})[r["seg_no"]] = (r["fasta"], r["dssp"], r["resids"])
    want = {k: v for k, v in plain(rows).items() if v}
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    flat = {r["source"]: (r["fasta"], r["ss"]) for r in reports.flat_report(reports.scan_dssp(df)[0]).collect()}
    assert flat == {k: ("".join(p[0] for p in v), "".join(p[1] for p in v).replace(" ", "-")) for k, v in want.items()}


def test_reports_in_any_order_of_lines(spark):
    rows = sample()
    check(spark, rows, spark.createDataFrame(rows, "source string, line_no int, line string").coalesce(1))
    random.Random(1).shuffle(rows)
    check(spark, rows, spark.createDataFrame(rows, "source string, line_no int, line string").repartition(3))
    none = spark.createDataFrame([], "source string, line_no int, line string")
    assert reports.scan_dssp(none)[0].count() == reports.scan_dssp(none)[1].count() == 0


def test_lines_are_shuffled_in_runs(spark):
    lines = ["title", "  #  RESIDUE AA STRUCTURE", *[f"{i:5d} {i:4d} A A  H" for i in range(3000)]]
    batch = pa.RecordBatch.from_pydict({"source": ["x"] * len(lines), "line_no": list(range(len(lines))), "line": lines})
    packed = list(reports._packed_lines(iter([batch])))
    assert [b.num_rows for b in packed] == [2] and packed[0]["aa"].to_pylist()[1] == "A" * 3000
    df = spark.createDataFrame([("x", i, x) for i, x in enumerate(lines)], "source string, line_no int, line string")
    found = reports.scan_dssp(df.repartition(2, "source").sortWithinPartitions("source", "line_no"))[0]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.select(F.length("fasta")).collect() == [(3000,)]
