"""Residue codes, secondary-structure classes and radii, as tables and column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Three-letter to one-letter residue codes.
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLU": "E", "GLN": "Q", "GLY": "G", "HIS": "H", "HIP": "p", "HIE": "e", "HID": "d",
    "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "SEP": "s", "THR": "T", "TPO": "t", "TRP": "W", "TYR": "Y", "VAL": "V",
}
# Secondary-structure codes and the reduced class of each.
SS_CODES, SS_CLASSES = "HGETS BIP", "HHELLLLLL"
# Van der Waals radii by element (Tsai 1999, Bondi 1964).
RADII = {
    "tsai1999": {"C": 1.7, "H": 1.0, "N": 1.625, "O": 1.480, "P": 1.871, "S": 1.782},
    "bondi1964": {"C": 1.7, "H": 1.09, "N": 1.55, "O": 1.52, "P": 1.8, "S": 1.8},
}
# Elements and alternative locations kept when chains are cleaned.
ELEMENTS = ["C", "O", "N", "H", "S", "Se", "D"]
ALT_LOCS = ["A", "", " ", "1"]
# Mean backbone bond lengths.
BOND_MEANS = {"N_CA": 1.46, "CA_C": 1.525, "C_N": 1.33}

AMINO = "ACDEFGHIKLMNPQRSTVWY"
ONE_TO_THREE = {one: three for three, one in THREE_TO_ONE.items()}


def lookup(key: Column, table: dict[str, object], default: object = None) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def one_letter(res_name: Column) -> Column:
    """Unknown residues are X."""
    return lookup(res_name, THREE_TO_ONE, "X")


def three_letter(aa: Column, protonated: bool = False) -> Column:
    """H becomes HIS, or HIP where ``protonated``."""
    return lookup(aa, ONE_TO_THREE | ({"H": "HIP"} if protonated else {"H": "HIS"}))


def reduce_ss(ss: Column) -> Column:
    return F.translate(ss, SS_CODES, SS_CLASSES)


def report_ss(ss: Column) -> Column:
    """Blank codes as dashes."""
    return F.translate(ss, " ", "-")


def valid_fasta(seq: Column) -> Column:
    return F.coalesce(seq.rlike(f"^[{''.join(sorted(ONE_TO_THREE))}]+$") & (F.upper(seq) == seq), F.lit(False))


def unknown_residues(seq: Column) -> Column:
    return F.array_sort(F.array_except(letters(seq), F.array(*[F.lit(c) for c in (*ONE_TO_THREE, "")])))


def remap(seq: Column, kept: str = "PG", target: str = "A") -> Column:
    """Every residue out of ``kept`` becomes ``target``."""
    return F.regexp_replace(seq, f"[^{kept}]", target)


def letters(seq: Column) -> Column:
    """array of the sequence's letters, in time linear in its length."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def substitute(seq: Column, options: dict[str, str]) -> Column:
    """Each residue with options becomes a character class of itself and them."""
    classes = {c: f"[{c}{''.join(x for x in more if x != c)}]" for c, more in options.items()}
    return F.array_join(F.transform(letters(seq), lambda c: F.coalesce(lookup(c, classes), c)), "")


def radii_table(spark: SparkSession, name: str = "tsai1999") -> DataFrame:
    return spark.createDataFrame(list(RADII[name].items()), "element string, radius double")


def parameters(text: Column) -> Column:
    """map of a parameter string ``k=v k=v``: words of a name, ``=`` and a value, which may be empty; of one name the last
    counts, and words without ``=`` are names without value (null). Null for a null text."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    pairs = F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.when(w.contains("="), F.regexp_replace(w, "^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)
