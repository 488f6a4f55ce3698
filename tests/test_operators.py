"""Golden values, brute force and damaged input for the library's operators."""

import math
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.functions import geometry as G
from foldlake.functions import residues as R
from foldlake.operators import backbone, database, gridjoin, islands, kmers, pairs, sampling, structures
from foldlake.sources import lines as L
from foldlake.sources import reports, sinks
from foldlake.sources import structures as S


def test_label_runs(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("LLLHEEE")], "k int, pos int, c string")
    assert sorted((r.c, r.start, r.stop) for r in islands.label_runs(df, ["k"], "pos", "c").collect()) == [("E", 4, 7), ("H", 3, 4), ("L", 0, 3)]


@pytest.mark.parametrize("tolerance, expected", [(1, [(1, 4), (6, 8), (10, 11)]), (2, [(1, 11)])])
def test_int_runs(spark, tolerance, expected):
    df = spark.createDataFrame([(0, v) for v in (1, 2, 3, 6, 7, 10) if tolerance == 1] + [(0, v) for v in (1, 3, 5, 7, 8, 10) if tolerance == 2], "k int, v int")
    assert sorted((r["first"], r["last"]) for r in islands.int_runs(df, ["k"], "v", tolerance).collect()) == expected


def test_fragment_index(spark):
    seg = spark.createDataFrame([(0, "AADDAADDAADD", "LLLLLLLLLLLL")], "segment_id long, fasta string, dssp string")
    hits = kmers.fragment_index(seg, spark.createDataFrame([(2, "AD")], "k int, kmer string"), [2], ["L"])
    assert sorted((r.start, r.stop) for r in hits.collect()) == [(1, 3), (5, 7), (9, 11)]


def test_fragment_before_proline(spark):
    seg = spark.createDataFrame([(0, "ADPAD", "LLLHH")], "segment_id long, fasta string, dssp string")
    hits = kmers.fragment_index(seg, spark.createDataFrame([(2, "AD")], "k int, kmer string"), [2], ["L", "H"]).collect()
    assert sorted((r.followed_by_pro, r.ss_class, r.start, r.stop) for r in hits) == [(False, "H", 3, 5), (False, "L", 0, 2), (True, "L", 0, 3)]


def _extend(query, target, seed, limit):
    out = set()
    for i in range(len(query) - seed + 1):
        for j in range(len(target) - seed + 1):
            if query[i : i + seed] != target[j : j + seed]:
                continue
            size, bad = seed, 0
            out.add((i, j, size, bad))
            while i + size < len(query) and j + size < len(target):
                equal = query[i + size] == target[j + size]
                if not equal and math.ceil(100 * (bad + 1) / (size + 1)) > limit:
                    break
                size, bad = size + 1, bad + (not equal)
                out.add((i, j, size, bad))
    return out


@pytest.mark.parametrize("limit", [0, 25, 50])
def test_seed_extend(spark, limit):
    query, target = "ABCABDABC", "XABCABCABDABDABC"
    got = kmers.seed_extend(spark.createDataFrame([(0, target)], "segment_id long, fasta string"), query, max_percent=limit).collect()
    assert {(r.q_start, r.start, r.size, r.mismatches) for r in got} == _extend(query, target, 3, limit)


def test_tolerant_hits(spark):
    seg = spark.createDataFrame([(0, "AGSAG")], "segment_id long, fasta string")
    allowed = spark.createDataFrame([("A", "A"), ("A", "S"), ("G", "G")], "aa string, other string")
    got = kmers.tolerant_hits(seg, spark.createDataFrame([(2, "AG")], "k int, kmer string"), allowed, [2])
    assert sorted(r.start for r in got.collect()) == [0, 3]


def test_bin10(spark):
    df = spark.createDataFrame([(h / 2,) for h in range(-360, 361)], "d double").select("d", G.bin10(F.radians("d")).alias("b"))
    for r in df.collect():
        # degrees(radians(x)) may miss a half by one unit in the last place
        assert r.b == 10 * round(round(math.degrees(math.radians(r.d))) / 10)


def test_dihedral(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(50, 4, 3))
    df = spark.createDataFrame([(i, *[float(v) for v in p.ravel()]) for i, p in enumerate(pts)], "i int, " + ", ".join(f"c{k} double" for k in range(12)))
    v = [tuple(F.col(f"c{3 * k + j}") for j in range(3)) for k in range(4)]
    got = {r.i: r.t for r in df.select("i", G.dihedral(*v).alias("t")).collect()}
    for i, (a, b, c, d) in enumerate(pts):
        n1, n2 = np.cross(b - a, c - b), np.cross(c - b, d - c)
        m = np.cross(n1, (c - b) / np.linalg.norm(c - b))
        assert abs(got[i] - math.atan2(-(m @ n2), n1 @ n2)) < 1e-9


def test_grid_join_is_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(0, 3, size=(200, 3))
    df = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], "k int, i int, x double, y double, z double")
    got = {(r.a.i, r.b.i) for r in gridjoin.within(df, df, ["k"], 1.3, (["i"], ["i"])).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 1.3), strict=True)}


def _chain(spark):
    rows = []
    for r in range(1, 4):
        for j, n in enumerate(("N", "CA", "C")):
            rows.append((1, "A", r, "ALA", n, 1.4 * (3 * r + j), float(j % 2), 0.1 * r))
    return spark.createDataFrame(rows, "structure_id int, chain_id string, res_seq int, res_name string, name string, x double, y double, z double")


def test_torsions_reject_long_bonds(spark):
    a = _chain(spark)
    assert backbone.torsions(a, 2.1).count() == 6
    assert backbone.torsions(a, 1.0).count() == 0
    assert backbone.torsions(a.filter("not (res_seq = 2 and name = 'C')"), 9.0).count() == 0


def test_bonds_of_all_structures_are_expanded(spark):
    from foldlake.plans import pair_queries as P
    from foldlake.plans import views as V

    atoms = V.atoms(spark, "/root/testdata/sf0.001")
    got = {r.structure_id: r["count"] for r in P.structure_separations(atoms).groupBy("structure_id").count().collect()}
    assert got == {r.structure_id: 2 * (20 + 19 + 18) for r in atoms.select("structure_id").distinct().collect()} and len(got) > 1
    read = P.expand_bonds(spark, "/root/testdata/sf0.001")._jdf.inputFiles()
    assert any("embeddings" in f for f in read)


def test_bond_separation(spark):
    got = {(r.a, r.b): r.sep for r in pairs.bond_separation(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a int, b int")).collect()}
    assert got == {(i, j): abs(i - j) for i in range(1, 6) for j in range(1, 6) if 0 < abs(i - j) <= 3}


def test_delete_insertions(spark):
    rows = [(1, i, "A", r, c) for i, (r, c) in enumerate([(1, ""), (1, "A"), (2, ""), (2, ""), (3, "B")])]
    got = structures.delete_insertions(spark.createDataFrame(rows, "structure_id int, row_idx int, chain_id string, res_seq int, icode string"))
    assert [r.res_seq_new for r in got.orderBy("row_idx").collect()] == [1, 2, 3, 3, 4]


def test_parse_id(spark):
    df = spark.createDataFrame([("1abc",), ("1abcXY",), ("1abc_d",), ("1abc_D_seg3 x",), ("model7.pdb",)], "t string")
    assert [tuple(r.p) for r in df.select(database.parse_id(F.col("t")).alias("p")).collect()] == [("1ABC", None, None), ("1ABC", "XY", None), ("1ABC", "d", None), ("1ABC", "D", "seg3"), ("model7", None, None)]


def test_ratio(spark):
    chains = spark.createDataFrame([("a", "AYIAKQ"), ("b", "AYIA")], "chain string, fasta string")
    queries = spark.createDataFrame([(0, "AYIA"), (1, "AKQ")], "q_idx int, query string")
    assert [(r.chain, r.q_idx, r.ratio) for r in database.best_match(chains, queries).collect()] == [("a", 0, 0.8)]


def test_uniform_is_repeatable(spark):
    df = spark.range(1000).select(sampling.uniform(3, F.col("id"), F.col("id") * 7).alias("u"))
    u = [r.u for r in df.collect()]
    assert sorted(u) == sorted(r.u for r in df.repartition(7).collect())
    assert 0 <= min(u) and max(u) < 1 and 0.4 < sum(u) / 1000 < 0.6


def test_similar_codes(spark):
    df = spark.createDataFrame([("ALA",), ("HIP",), ("FOO",), (None,)], "n string")
    assert [r.a for r in df.select(R.one_letter(F.col("n")).alias("a")).collect()] == ["A", "p", "X", "X"]


def _lines(spark, **files):
    return spark.createDataFrame([(s, i, t) for s, text in files.items() for i, t in enumerate(text.split("\n"))], L.LINES)


def test_pdb_quarantine(spark):
    atom = "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00  0.00           C  "
    atoms, bad = S.scan_pdb(_lines(spark, good=atom, half="MODEL 1\n" + atom, none="REMARK", two=f"MODEL 1\n{atom}\nENDMDL\nMODEL 2\n{atom}\nENDMDL", odd=atom.replace("11.104", "   abc")))
    assert {(r.source, r.reason) for r in bad.collect()} == {("half", "model marks"), ("none", "no atoms")}
    got = {r.structure_id: r for r in atoms.collect()}
    assert set(got) == {"good", "two", "odd"} and atoms.count() == 3
    assert (got["good"].name, got["good"].x, got["good"].element, got["odd"].x) == ("CA", 11.104, "C", None)


def test_cif_quarantine(spark):
    head = "loop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.label_asym_id\n_atom_site.auth_asym_id\n"
    atoms, bad = S.scan_cif(_lines(spark, good=head + "ATOM 1 A ?\n#", eof=head + "ATOM 1 A B", wide=head + "ATOM 1 A B C\n#", none="data_"))
    assert {(r.source, r.reason) for r in bad.collect()} == {("eof", "no end mark"), ("wide", "row width"), ("none", "no atom loop")}
    assert [(r.structure_id, r.serial, r.chain_id) for r in atoms.collect()] == [("good", 1, "A")]


def test_dssp_without_header(spark):
    seg, bad = reports.scan_dssp(_lines(spark, wrong="nothing\nhere", right="  #  RESIDUE\n    1    5 A M  H\n    2        !   \n    3    7 A K   "))
    assert [r.source for r in bad.collect()] == ["wrong"]
    assert [(r.seg_no, r.fasta, r.dssp, r.resids) for r in seg.orderBy("seg_no").collect()] == [(0, "M", "H", "5"), (1, "K", " ", "7")]


def test_fasta_without_header(spark):
    got = {(r.source, r.header): r.sequence for r in reports.scan_fasta(_lines(spark, a=">x\nAB C\nD\n>y\nE", b="AC\nDE")).collect()}
    assert got == {("a", ">x"): "ABCD", ("a", ">y"): "E", ("b", "1"): "ACDE"}


def test_files(spark, tmp_path):
    for n in ("1ABC_A.pdb", "2DEF_B.pdb"):
        (tmp_path / n).write_text(f"ATOM {n}\nEND")
    (tmp_path / "ids.list").write_text("1ABC_A.pdb\n9XYZ_C.pdb\n")
    folder = str(tmp_path)
    assert {r.source for r in L.read_lines(spark, folder, "*.pdb").collect()} == {"1ABC_A", "2DEF_B"}
    assert {r.id for r in L.existing_ids(spark, folder).collect()} == {"1ABC_A", "2DEF_B"}
    found, missing = L.resolve(spark, [folder], [str(tmp_path / "ids.list")], "*.pdb")
    assert found.count() == 2 and [r.path for r in missing.collect()] == ["9XYZ_C.pdb"]


def test_tar(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("ATOM one\nEND")
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        t.add(tmp_path / "a.pdb", "in/a.pdb")
    (tmp_path / "bad.tar").write_bytes(b"no archive at all")
    members = L.read_tar(spark, str(tmp_path), ".pdb").collect()
    assert sorted((m.archive, m.name) for m in members if m.name) == [("x", "in/a.pdb")]
    assert [m.archive for m in members if not m.name] == ["bad"]
    assert L.split_tar_lines(L.read_tar(spark, str(tmp_path), ".pdb")).count() == 2


def test_forcefield(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<ForceField><Residues><Residue name="ALA"><Atom name="N" type="t1" charge="-0.4"/><Atom name="CA" type="t2" charge="0.1"/></Residue></Residues>'
                                    '<NonbondedForce lj14scale="0.5"><Atom type="t1" sigma="0.3" epsilon="0.7"/></NonbondedForce></ForceField>')
    atoms, bonded = S.scan_forcefield(spark, str(tmp_path / "f.xml"))
    assert sorted(tuple(r) for r in atoms.collect()) == [("ALA", "CA", "t2", 0.1), ("ALA", "N", "t1", -0.4)]
    assert [tuple(r) for r in bonded.collect()] == [("t1", 0.3, 0.7)]


def test_sinks(spark, tmp_path):
    counts = spark.createDataFrame([(1, "A", 3), (1, "B", 5), (2, "AB", 1)], "k int, kmer string, n long")
    sinks.write_counts(counts, str(tmp_path / "counts"))
    assert spark.read.option("header", True).csv(str(tmp_path / "counts" / "k=1")).count() == 2
    rows = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("t", 0, "c")], "segment_id string, line_no int, line string")
    sinks.write_segments(rows, str(tmp_path / "seg"))
    assert [r.value for r in spark.read.text(str(tmp_path / "seg" / "segment_id=s")).collect()] == ["a", "b"]


def test_ingest(spark, tmp_path):
    from foldlake.streaming.incremental import ingest

    for part in (0, 1):
        spark.createDataFrame([(i, f"s{i}") for i in range(part * 2, part * 2 + 4)], "id long, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, t string").parquet(str(tmp_path / "in"))
        ingest(stream, lambda b: b.withColumn("n", F.length("t")), str(tmp_path / "out"), str(tmp_path / "check"), "id")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))


def test_reference_independent_of_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "foldlake")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    text = open(os.path.join(folder, n)).read()
                    assert "llm" not in text, n
