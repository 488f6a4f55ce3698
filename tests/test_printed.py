"""Coordinate lines round as printf does: by the exact binary value, ties to even."""

import random

from pyspark.sql import functions as F

from foldlake.sources import structures as S


def test_numbers_are_those_of_printf(spark):
    rng = random.Random(4)
    ties = [i / 16 for i in range(-999, 1000, 7)] + [i / 1000 + 0.0005 for i in range(-500, 500, 3)]
    values = [*ties, *[rng.gauss(0, 30) for _ in range(500)], 0.0, -0.0, -0.0004, 1.0015, 2.675, 999.9996, -999.9995, 1e-300]
    atoms = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "structure_id int, row_idx int, x double").withColumns(
        {c: F.lit("A") for c in ("record", "name", "element", "alt_loc", "res_name", "chain_id", "icode", "segid", "charge")} | {c: F.lit(1) for c in ("serial", "res_seq")}
        | {c: F.col("x") for c in ("y", "z", "occ", "temp")})
    lines = {r["structure_id"]: r["line"] for r in S.pdb_lines(atoms).collect()}
    for i, v in enumerate(values):
        assert lines[i][30:-14] == "%8.3f%8.3f%8.3f%6.2f%6.2f" % (v, v, v, v, v), v
