"""Which residues may stand for which."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Substitutes of each residue by score (5, 3, 2, 1, 0) of a substitution matrix for disordered proteins.
SCORES = (5, 3, 2, 1, 0)
EDSS50 = {
    "A": ("", "", "", "TV", "SG"),
    "C": ("", "Y", "W", "F", "SVH"),
    "D": ("", "", "E", "", ""),
    "E": ("", "", "D", "", ""),
    "F": ("Y", "", "WL", "MIC", "VH"),
    "G": ("", "", "", "", "A"),
    "H": ("", "", "YQ", "N", "FRC"),
    "I": ("", "VM", "L", "F", "T"),
    "K": ("", "", "R", "", "Q"),
    "M": ("", "I", "VL", "F", "T"),
    "N": ("", "", "", "H", "STD"),
    "P": ("", "", "", "", ""),
    "Q": ("", "", "H", "", "KR"),
    "R": ("", "", "K", "", "HQW"),
    "S": ("", "", "", "", "TCNA"),
    "T": ("", "", "", "A", "VSMIN"),
    "W": ("", "", "YFC", "", "R"),
    "Y": ("F", "", "C", "", "WH"),
}
# A preset, each residue with its substitutes.
PRESETS = {
    "idp1": {
        "Y": "YF", "F": "FY", "K": "KR", "R": "RK", "V": "VILA", "A": "AVIL", "I": "ILVA", "L": "LVIA", "Q": "QNST", "T": "TS", "S": "ST",
    },
}


def substitutes(scores: Iterable[int] = SCORES) -> list[tuple[str, int, str]]:
    """(aa, score, other): a row for each substitute of the matrix whose score is among ``scores``."""
    rows = [(aa, score, other) for aa, others in EDSS50.items() for score, letters in zip(SCORES, others, strict=True) for other in letters]
    return [r for r in rows if r[1] in set(scores)]


def by_score(scores: int | Iterable[int] = SCORES) -> dict[str, str]:
    """Each residue of the matrix with itself and its substitutes of the chosen scores."""
    table = {aa: aa for aa in EDSS50}
    for aa, _, other in substitutes([scores] if isinstance(scores, int) else scores):
        table[aa] += other
    return table


def allowed(table: dict[str, str], residues: str) -> dict[str, str]:
    """Substitutes of each of ``residues``, sorted; itself always, and alone where the table has no entry."""
    return {aa: "".join(sorted({aa, *table.get(aa, "")})) for aa in residues}


def allowed_table(spark: SparkSession, table: dict[str, str], residues: str) -> DataFrame:
    """(aa, other): a row for each residue and what may stand for it, itself included."""
    rows = {(aa, other) for aa in residues for other in (aa, *table.get(aa, ""))}
    return spark.createDataFrame(sorted(rows), "aa string, other string")
