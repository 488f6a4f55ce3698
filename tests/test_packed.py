"""Packed texts, counted values in chunks, tagged merges, terminal variants, pairs of angles."""

import random
from collections import Counter

from pyspark.sql import functions as F

from foldlake.operators import backbone, database, statistics
from foldlake.sources import packed, structures


def test_texts_come_back_from_few_files(spark, tmp_path):
    rows = [(i, f"text {i}\n" * (i % 5)) for i in range(300)] + [(7, "twice é"), (None, None), (500, "x" * 9000)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(2)
    packed.write_packed(df, str(tmp_path / "p"), shard_bytes=4000)
    files = list((tmp_path / "p" / "shards").iterdir())
    assert 3 <= len(files) <= 12 and sum(f.stat().st_size > 4000 for f in files) == 1
    key = lambda i: None if i is None else str(i)
    assert Counter((r.id, r.text) for r in packed.read_packed(spark, str(tmp_path / "p")).collect()) == Counter((key(i), t or "") for i, t in rows)
    (tmp_path / "a.list").write_text("7\n 500 \n\n7\nnowhere\n")
    found, missing = packed.resolve(spark, str(tmp_path / "p"), [str(tmp_path / "a.list")])
    assert sorted(len(r.text) for r in packed.read_packed(spark, str(tmp_path / "p"), found).collect()) == sorted(len(t) for i, t in rows if i in (7, 500))
    assert [r.id for r in missing.collect()] == ["nowhere"]
    packed.write_packed(df.limit(0), str(tmp_path / "none"))
    assert packed.read_packed(spark, str(tmp_path / "none")).count() == 0


def test_multisets_merge_and_stay_small(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else "k", rng.choice([rng.uniform(-2, 3), 0.5, -0.25, None])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double")
    a, b = (statistics.multisets(df.filter(F.col("v") < 0.5 if i else F.col("v") >= 0.5), ["k"], "v", width=64) for i in (0, 1))
    got = statistics.merge_multisets(a, b, ["k"], width=64).collect()
    assert max(len(r.entries) for r in got) <= 64
    assert sum((Counter({(r.k, e["value"]): e["n"] for e in r.entries}) for r in got), Counter()) == Counter((k, round(v * 10000) / 10000) for k, v in rows if v is not None)
    assert all(r.n == sum(e["n"] for e in r.entries) for r in got) and len({(r.k, r.chunk) for r in got}) == len(got)


def test_tagged_merge(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "id int, x string")
    right = spark.createDataFrame([(2, 5), (3, None), (None, 9)], "id int, y int")
    assert sorted(map(str, (tuple(r) for r in database.merge_tagged(left, right, "id").collect()))) == sorted(map(str, [(1, "left", "a", None), (2, "both", None, 5), (3, "right", None, None), (None, "left", "n", None), (None, "right", None, 9)]))


def test_terminal_variants_fall_back(spark):
    atoms = spark.createDataFrame([("ALA", "N", 1.0), ("NALA", "N", 2.0), ("GLY", "N", 3.0)], "residue string, atom string, charge double")
    wanted = spark.createDataFrame([("ALA", ""), ("ALA", "N"), ("ALA", "C"), ("GLY", "N"), ("TRP", "")], "residue string, terminal string")
    got = {(r.residue, r.terminal): (r.used, r.charge) for r in structures.terminal_atoms(wanted, atoms).collect()}
    assert got == {("ALA", ""): ("ALA", 1.0), ("ALA", "N"): ("NALA", 2.0), ("ALA", "C"): ("ALA", 1.0), ("GLY", "N"): ("GLY", 3.0)}


def test_angle_pairs_by_residue_and_by_place(spark):
    t = [("s", "A", r, "psi", 10.0 * r) for r in (1, 2, 3)] + [("s", "A", r, "phi", r / 10) for r in (2, 3, 4)] + [("s", "A", 1, "omega", 9.0)]
    df = spark.createDataFrame(t, "structure_id string, chain_id string, res_seq int, kind string, degrees double")
    assert sorted((r.res_seq, r.phi, r.psi) for r in backbone.angle_pairs(df).collect()) == [(2, 0.2, 20.0), (3, 0.3, 30.0)]
    assert sorted((r.res_seq, r.phi, r.psi) for r in backbone.angle_pairs(df, legacy_index=True).collect()) == [(1, 0.2, 10.0), (2, 0.3, 20.0), (3, 0.4, 30.0)]
    assert backbone.chain_records(df).first()["phi"] == [0.2, 0.3, 0.4]
