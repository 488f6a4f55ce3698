"""Coordinate files to atoms and back. Damaged files go to quarantine tables, never to exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.residues import lookup
from ..operators.broadcasts import checked

# Columns of a coordinate line, as (start, end) from 0, end exclusive.
PDB_COLUMNS = {
    "record": (0, 6), "serial": (6, 11), "name": (12, 16), "alt_loc": (16, 17), "res_name": (17, 20), "chain_id": (21, 22), "res_seq": (22, 26), "icode": (26, 27),
    "x": (30, 38), "y": (38, 46), "z": (46, 54), "occ": (54, 60), "temp": (60, 66), "segid": (72, 76), "element": (76, 78), "charge": (78, 80),
}
TYPES = {"serial": "int", "res_seq": "int", "x": "double", "y": "double", "z": "double", "occ": "double", "temp": "double"}
# Atom columns and the labels that hold them.
CIF_COLUMNS = {
    "record": ["group_PDB"], "serial": ["id"], "name": ["auth_atom_id", "label_atom_id"], "alt_loc": ["label_alt_id"], "res_name": ["auth_comp_id", "label_comp_id"],
    "chain_id": ["auth_asym_id", "label_asym_id"], "res_seq": ["auth_seq_id", "label_seq_id"], "icode": ["pdbx_PDB_ins_code"], "x": ["Cartn_x"], "y": ["Cartn_y"], "z": ["Cartn_z"],
    "occ": ["occupancy"], "temp": ["B_iso_or_equiv"], "element": ["type_symbol"], "charge": ["pdbx_formal_charge"],
}
PDB_LINE = "%-6s%5d %s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f      %-4s%2s%2s"


def scan_pdb(lines: DataFrame, records: tuple[str, ...] = ("ATOM", "HETATM")) -> tuple[DataFrame, DataFrame]:
    """(atoms, quarantine). Of files with MODEL and ENDMDL lines only the first model; with one kind alone they are
    quarantined, as are files without atoms."""
    word = F.trim(F.substring("line", 1, 6))
    marks = lines.groupBy("source").agg(F.min(F.when(word == "MODEL", F.col("line_no"))).alias("m"), F.min(F.when(word == "ENDMDL", F.col("line_no"))).alias("e"), F.max(word.isin(*records)).alias("any"))
    bad = F.when(F.col("m").isNull() != F.col("e").isNull(), "model marks").when(~F.col("any"), "no atoms")
    quarantine = marks.select("source", bad.alias("reason")).filter("reason is not null")
    good = marks.filter(bad.isNull()).select("source", "m", "e")
    rows = lines.filter(word.isin(*records)).join(good, "source").filter(F.col("m").isNull() | F.col("line_no").between(F.col("m"), F.col("e")))

    def column(name: str) -> Column:
        a, b = PDB_COLUMNS[name]
        text = F.trim(F.substring("line", a + 1, b - a))
        return F.expr(f"try_cast(trim(substring(line, {a + 1}, {b - a})) as {TYPES[name]})") if name in TYPES else text

    return rows.select(F.col("source").alias("structure_id"), F.col("line_no").alias("row_idx"), *[column(c).alias(c) for c in PDB_COLUMNS]), quarantine


def atom_name(name: Column, element: Column) -> Column:
    """Four characters: names of one-letter elements begin in the second, if they fit."""
    short = (F.length(element) == 1) & (F.length(name) <= 3)
    return F.when(short, F.format_string(" %-3s", name)).otherwise(F.format_string("%-4s", name))


def printed(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """``df`` with the doubles nearest to some columns' values rounded as C's printf does: by the exact binary value, ties to even.
    Java rounds the shortest decimal form, ties up. The product's rounding error, exact by splitting, decides where it seems a tie."""
    n = {c: F.lit(float(10**d)) for c, d in decimals.items()}
    p, w, big, high = ({c: F.col(f"_{k}_{c}") for c in decimals} for k in ("p", "w", "b", "h"))
    s = df.withColumns({f"_p_{c}": F.col(c) * n[c] for c in decimals} | {f"_b_{c}": F.col(c) * F.lit(134217729.0) for c in decimals})
    s = s.withColumns({f"_w_{c}": F.rint(p[c]) for c in decimals} | {f"_h_{c}": big[c] - (big[c] - F.col(c)) for c in decimals})
    for c in decimals:
        error = (high[c] * n[c] - p[c]) + (F.col(c) - high[c]) * n[c]
        side = F.when(F.abs(p[c] - w[c]) != 0.5, 0.0).otherwise(F.when(F.signum(error) == F.signum(p[c] - w[c]), F.signum(error)).otherwise(0.0))
        s = s.withColumn(f"_s_{c}", side)
    return s.select(*[c for c in df.columns if c not in decimals], *[F.when(F.abs(c) < 1e9, F.when(F.col(f"_s_{c}") == 0, w[c]).otherwise(w[c] + F.col(f"_s_{c}")) / n[c]).otherwise(F.col(c)).alias(c) for c in decimals])


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """structure_id, row_idx, line. Missing texts are blank, missing numbers zero. Numbers are rounded as printf does."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind))
    decimals = {"x": 3, "y": 3, "z": 3, "occ": 2, "temp": 2}
    a = printed(atoms.withColumns({c: number(c, "double") for c in decimals}), decimals)
    line = F.format_string(PDB_LINE, text("record"), number("serial", "int"), atom_name(text("name"), text("element")), text("alt_loc"), text("res_name"), F.substring(text("chain_id"), 1, 1), number("res_seq", "int"), text("icode"),
                           *decimals, text("segid"), text("element"), text("charge"))
    return a.select("structure_id", "row_idx", line.alias("line"))


def scan_cif(lines: DataFrame, prefer_auth: bool = True) -> tuple[DataFrame, DataFrame]:
    """(atoms, quarantine) from the atom-site loop: headers from the first one on, rows up to a ``#`` or blank line. Files
    without loop, without an end mark, or with a row of another width are quarantined. ``?`` and ``.`` are missing; an
    alternative 1 is A; a chain that is missing is taken from the other label."""
    line = F.trim("line")
    head = lines.filter(line.startswith("_atom_site.")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("line_no", F.substring(line, len("_atom_site.") + 1, 100).alias("h")))).alias("h"), F.max("line_no").alias("last"))
    ends = lines.filter((line == "") | line.startswith("#")).select("source", "line_no").join(head.select("source", "last"), "source").filter("line_no > last").groupBy("source").agg(F.min("line_no").alias("end"))
    loop = head.join(ends, "source").select("source", F.transform("h", lambda x: x["h"]).alias("h"), "last", "end")
    rows = lines.join(loop, "source").filter((F.col("line_no") > F.col("last")) & (F.col("line_no") < F.col("end"))).withColumn("t", F.split(line, r"\s+"))
    odd = rows.filter(F.size("t") != F.size("h")).select("source").distinct()
    rows = rows.join(odd, "source", "left_anti").withColumn("m", F.map_from_arrays("h", "t"))

    def value(labels: list[str]) -> Column:
        order = labels if prefer_auth else labels[::-1]
        return F.coalesce(*[F.when(~F.try_element_at("m", F.lit(x)).isin("?", "."), F.try_element_at("m", F.lit(x))) for x in order], F.lit(""))

    def column(name: str) -> Column:
        v = value(CIF_COLUMNS[name])
        if name == "alt_loc":
            v = F.when(v == "1", "A").otherwise(v)
        return v.try_cast(TYPES[name]) if name in TYPES else v

    every = lines.select("source").distinct()
    quarantine = every.join(head, "source", "left_anti").withColumn("reason", F.lit("no atom loop"))
    quarantine = quarantine.unionByName(head.join(ends, "source", "left_anti").select("source", F.lit("no end mark").alias("reason"))).unionByName(odd.withColumn("reason", F.lit("row width")))
    return rows.select(F.col("source").alias("structure_id"), F.col("line_no").alias("row_idx"), *[column(c).alias(c) for c in CIF_COLUMNS]), quarantine


ATOM_TYPES = "_name string, Atom array<struct<_name:string,_type:string,_charge:double>>"


def parse_residues(texts: DataFrame, column: str = "xml") -> DataFrame:
    """(residue, atom, type, charge) from the texts of residue elements; what does not parse gives no row."""
    r = texts.select(F.from_xml(column, ATOM_TYPES, {"mode": "PERMISSIVE"}).alias("r"))
    return r.select(F.col("r._name").alias("residue"), F.explode("r.Atom").alias("a")).select("residue", F.col("a._name").alias("atom"), F.col("a._type").alias("type"), F.col("a._charge").alias("charge"))


def scan_forcefield(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(residue, atom, type, charge) and (type, sigma, epsilon) of an XML force field."""
    atoms = spark.read.format("xml").option("useLegacyXMLParser", True).option("rowTag", "Residue").schema(ATOM_TYPES).load(path)
    atoms = atoms.select(F.col("_name").alias("residue"), F.explode("Atom").alias("a")).select("residue", F.col("a._name").alias("atom"), F.col("a._type").alias("type"), F.col("a._charge").alias("charge"))
    bonded = spark.read.format("xml").option("useLegacyXMLParser", True).option("rowTag", "NonbondedForce").schema("Atom array<struct<_type:string,_sigma:double,_epsilon:double>>").load(path)
    bonded = bonded.select(F.explode("Atom").alias("a")).select(F.col("a._type").alias("type"), F.col("a._sigma").alias("sigma"), F.col("a._epsilon").alias("epsilon"))
    return atoms, bonded


def terminal_atoms(wanted: DataFrame, atoms: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (residue, terminal: '', N or C) with the atoms of the residue's terminal variant, whose name is the
    letter before the residue's; of the plain residue where the force field has no such variant. ``used`` names it."""
    known = checked(atoms.select(F.col("residue").alias("_known")).distinct())
    named = F.concat("terminal", "residue")
    w = wanted.withColumn("_named", named).join(known, F.col("_named") == F.col("_known"), "left")
    w = w.withColumn("used", F.coalesce("_known", "residue")).drop("_named", "_known")
    return w.join(atoms.withColumnRenamed("residue", "used"), "used")


def element_radius(element: Column, table: dict[str, float]) -> Column:
    return lookup(element, table, 0.0)
