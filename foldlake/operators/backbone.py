"""Backbone geometry by windows over (structure, chain), ordered by residue and atom: one shuffle and one sort serve
bond lengths, torsions and breaks alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.residues import BOND_MEANS, one_letter

CHAIN = ["structure_id", "chain_id"]
RANK = {"N": 0, "CA": 1, "C": 2}
BONDS = {"N": "N_CA", "CA": "CA_C", "C": "C_N"}
TORSIONS = {"N": "psi", "CA": "omega", "C": "phi"}
ANGLES = ["cm1_n_ca", "n_ca_c", "ca_c_np1", "ca_c_o"]
LENGTHS = ["n_ca", "ca_c", "c_np1", "c_o"]


def _by_name(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])[F.col("name")]


def trace(atoms: DataFrame, ahead: int = 3) -> DataFrame:
    """Backbone atoms in order: p0 ... p<ahead> are the atom's point and those of the following ones."""
    w = Window.partitionBy(*CHAIN).orderBy("res_seq", "_rank")
    b = atoms.filter(F.col("name").isin(*RANK)).withColumn("_rank", _by_name(RANK)).withColumn("p0", F.struct("x", "y", "z"))
    for i in range(1, ahead + 1):
        b = b.withColumn(f"p{i}", F.lead("p0", i).over(w))
    return b.select(*CHAIN, "res_seq", "res_name", "name", "_rank", *[f"p{i}" for i in range(ahead + 1)])


def bond_lengths(atoms: DataFrame) -> DataFrame:
    """structure_id, chain_id, res_seq, res_name, bond, length of every consecutive backbone pair."""
    t = trace(atoms, 1).filter(F.col("p1").isNotNull())
    return t.select(*CHAIN, "res_seq", "res_name", _by_name(BONDS).alias("bond"), G.distance(G.point("p0"), G.point("p1")).alias("length"))


def torsions(atoms: DataFrame, max_bond: float = 2.1) -> DataFrame:
    """structure_id, chain_id, res_seq, kind, degrees: psi and omega of the residue, phi of the residue it belongs to. Chains
    with a longer step than ``max_bond``, or with residues that lack an atom, are left out whole."""
    w = Window.partitionBy(*CHAIN)
    o = w.orderBy("res_seq", "_rank")
    t = trace(atoms).withColumn("_step", G.distance(G.point("p0"), G.point("p1")))
    t = t.withColumn("_far", F.max("_step").over(w))
    counts = [F.sum((F.col("name") == n).cast("int")).over(w) for n in RANK]
    t = t.withColumn("_even", (counts[0] == counts[1]) & (counts[1] == counts[2]))
    t = t.withColumn("_next", F.lead("res_seq").over(o)).filter((F.col("_far") <= max_bond) & F.col("_even") & F.col("p3").isNotNull())
    d = G.rounded(F.degrees(G.dihedral(*[G.point(f"p{i}") for i in range(4)])), 4)
    res = F.when(F.col("name") == "C", F.col("_next")).otherwise(F.col("res_seq"))
    return t.select(*CHAIN, res.alias("res_seq"), _by_name(TORSIONS).alias("kind"), F.when(d == -180, 180.0).otherwise(d).alias("degrees"))


def chain_breaks(atoms: DataFrame, max_bond: float = 2.1) -> DataFrame:
    """structure_id, chain_id, piece, n_atoms, first, last, sequence of the continuous pieces of chains that have a break.
    The sequence takes every third atom's residue."""
    o = Window.partitionBy(*CHAIN).orderBy("res_seq", "_rank")
    t = trace(atoms, 0).withColumn("_before", F.lag("p0").over(o))
    t = t.withColumn("_broken", (F.coalesce(G.distance(G.point("p0"), G.point("_before")), F.lit(0.0)) > max_bond).cast("int"))
    t = t.withColumn("piece", F.sum("_broken").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_any", F.max("_broken").over(Window.partitionBy(*CHAIN))).filter("_any = 1")
    rows = F.array_sort(F.collect_list(F.struct("res_seq", "_rank", one_letter(F.col("res_name")).alias("aa"))))
    p = t.groupBy(*CHAIN, "piece").agg(F.count(F.lit(1)).alias("n_atoms"), F.min("res_seq").alias("first"), F.max("res_seq").alias("last"), rows.alias("_r"))
    aa = F.array_join(F.transform(F.filter("_r", lambda x, i: i % 3 == 0), lambda x: x["aa"]), "")
    return p.select(*CHAIN, F.col("piece").cast("int").alias("piece"), "n_atoms", "first", "last", aa.alias("sequence"))


def residues(atoms: DataFrame, names: list[str] = ["N", "CA", "C", "O", "H", "HA"]) -> DataFrame:  # noqa: B006
    """A row for each residue, with a point (or null) for each atom name."""
    points = [F.max(F.when(F.col("name") == n, F.struct("x", "y", "z"))).alias(n.lower()) for n in names]
    return atoms.groupBy(*CHAIN, "res_seq").agg(F.min("res_name").alias("res_name"), *points)


def _neighbours(r: DataFrame) -> DataFrame:
    o = Window.partitionBy(*CHAIN).orderBy("res_seq")
    aa = one_letter(F.col("res_name"))
    return r.withColumn("aa", aa).withColumn("pc", F.lag("c").over(o)).withColumn("nn", F.lead("n").over(o)).withColumn("before", F.lag("aa").over(o)).withColumn("after", F.lead("aa").over(o))


def bond_geometry(atoms: DataFrame) -> DataFrame:
    """For each residue between two others: phi and psi (radians), four encoded bend angles, four lengths. Bends are
    stored as (pi - a) / 2, CA-C-O as a / 2; residues without the atoms needed get nulls or fall out."""
    r = _neighbours(residues(atoms)).filter(F.col("pc").isNotNull() & F.col("nn").isNotNull() & F.col("n").isNotNull() & F.col("ca").isNotNull() & F.col("c").isNotNull())
    pc, n, ca, c, o, nn = (G.point(x) for x in ("pc", "n", "ca", "c", "o", "nn"))
    bend = lambda *p: (F.lit(3.141592653589793) - G.angle(*p)) / 2
    values = [bend(pc, n, ca), bend(n, ca, c), bend(ca, c, nn), G.angle(ca, c, o) / 2, G.distance(n, ca), G.distance(ca, c), G.distance(c, nn), G.distance(c, o)]
    return r.select(*CHAIN, "res_seq", "aa", "before", "after", G.dihedral(pc, n, ca, c).alias("phi"), G.dihedral(n, ca, c, nn).alias("psi"), *[v.alias(k) for k, v in zip(ANGLES + LENGTHS, values, strict=True)])


def long_geometry(geometry: DataFrame, kinds: list[str]) -> DataFrame:
    """trimer, aa, pair, phi_bin, psi_bin, kind, value for every residue and kind."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds]))
    g = geometry.filter(~F.col("aa").isin("X") & ~F.col("before").isin("X") & ~F.col("after").isin("X"))
    g = g.select(F.concat("before", "aa", "after").alias("trimer"), "aa", F.concat("before", "after").alias("pair"), G.bin10(F.col("phi")).alias("phi_bin"), G.bin10(F.col("psi")).alias("psi_bin"), pairs.alias("g"))
    return g.select("trimer", "aa", "pair", "phi_bin", "psi_bin", "g.kind", "g.value").filter(F.col("value").isNotNull())


def coupling_torsions(atoms: DataFrame) -> DataFrame:
    """H-N-CA-HA torsion of each residue in degrees; prolines null; residues without the atoms are left out."""
    r = residues(atoms)
    d = G.rounded(F.degrees(G.dihedral(*(G.point(x) for x in ("h", "n", "ca", "ha")))), 4)
    full = F.col("h").isNotNull() & F.col("n").isNotNull() & F.col("ca").isNotNull() & F.col("ha").isNotNull()
    return r.filter(full).select(*CHAIN, "res_seq", F.when(F.col("res_name") != "PRO", d).alias("degrees"))


def off_bonds(lengths: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Bonds that differ from the mean of their kind by more than tolerance + 1e-5 * mean."""
    mean = F.create_map(*[F.lit(x) for item in BOND_MEANS.items() for x in item])[F.col("bond")]
    return lengths.withColumn("expected", mean).filter(F.abs(F.col("length") - F.col("expected")) > tolerance + 1e-5 * F.abs("expected"))


def angle_pairs(torsions: DataFrame, legacy_index: bool = False) -> DataFrame:
    """structure_id, chain_id, res_seq, phi, psi of each residue that has both. With ``legacy_index`` the angles are paired by their
    places in the chain's lists instead, the first phi with the first psi; as a chain's first residue has no phi, that is
    the psi of a residue with the phi of the next one."""
    kinds = torsions.filter(F.col("kind").isin("phi", "psi"))
    at = F.col("res_seq")
    if legacy_index:
        o = Window.partitionBy(*CHAIN, "kind").orderBy("res_seq")
        kinds = kinds.withColumn("_at", F.row_number().over(o))
        first = kinds.groupBy(*CHAIN, "_at").agg(*[F.max(F.when(F.col("kind") == k, F.col("degrees"))).alias(k) for k in ("phi", "psi")], F.max(F.when(F.col("kind") == "psi", at)).alias("res_seq"))
        out = first.select(*CHAIN, "res_seq", "phi", "psi")
    else:
        out = kinds.groupBy(*CHAIN, "res_seq").agg(*[F.max(F.when(F.col("kind") == k, F.col("degrees"))).alias(k) for k in ("phi", "psi")])
    return out.filter(F.col("phi").isNotNull() & F.col("psi").isNotNull())


def chain_records(torsions: DataFrame) -> DataFrame:
    """structure_id, phi, psi, omega: the angles of each structure as lists, in order of residues."""
    every = torsions.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("chain_id", "res_seq", "kind", "degrees"))).alias("_t"))
    return every.select("structure_id", *[F.transform(F.filter("_t", lambda t: t["kind"] == k), lambda t: t["degrees"]).alias(k) for k in ("phi", "psi", "omega")])  # noqa: B023


def region(phi: Column, psi: Column) -> Column:
    """Ramachandran region of two angles in degrees; bounds are strict."""
    alpha = (phi > -180) & (phi < 10) & (psi > -120) & (psi < 45)
    beta = (phi > -180) & (phi < 0) & (((psi > -180) & (psi < -120)) | ((psi > 45) & (psi < 180)))
    return F.when(alpha, "alpha").when(beta, "beta").otherwise("other")


def polyproline(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Adds ss_new: P for blank residues with phi within [-104, -46] and psi within [116, 174] beside another such, never
    for the first of a chain. ``df`` has ss, phi, psi."""
    o = Window.partitionBy(*keys).orderBy(pos)
    fits = (F.col("ss") == " ") & F.col("phi").between(-104, -46) & F.col("psi").between(116, 174) & (F.row_number().over(o) > 1)
    t = df.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    beside = (F.lag("_fits").over(o) & (F.lag(pos).over(o) == F.col(pos) - 1)) | (F.lead("_fits").over(o) & (F.lead(pos).over(o) == F.col(pos) + 1))
    return t.withColumn("ss_new", F.when(F.col("_fits") & F.coalesce(beside, F.lit(False)), "P").otherwise(F.col("ss"))).drop("_fits")
