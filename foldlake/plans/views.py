"""Protein-shaped views of the given tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.residues import AMINO, ONE_TO_THREE

# Labels of event types.
EVENT_SS = {"click": "H", "error": "G", "purchase": "E", "signup": "T", "view": " "}
SCALE = 8.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(plain, f"[^{AMINO}]", "").alias("seq"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 atoms of each embedding: seven residues of N, CA and C."""
    e = table(spark, sf_dir, "embeddings").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(20))))
    at = lambda i: F.element_at("embedding", F.col("p") * 3 + i + 1).cast("double") * SCALE
    res = (F.floor(F.col("p") / 3) + 1).cast("int")
    names = F.array(*[F.lit(ONE_TO_THREE[a] if a != "H" else "HIS") for a in AMINO])
    name = F.element_at(F.array(F.lit("N"), F.lit("CA"), F.lit("C")), F.col("p") % 3 + 1)
    return e.select(
        F.col("vec_id").alias("structure_id"), "label", (F.col("p") + 1).alias("serial"), res.alias("res_seq"), name.alias("name"), F.substring(name, 1, 1).alias("element"),
        F.element_at(names, ((F.col("vec_id") * 7 + res * 3 + F.col("label")) % 20 + 1).cast("int")).alias("res_name"), F.lit("A").alias("chain_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"),
    )


def ss(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = F.lit(None)
    for kind, code in EVENT_SS.items():
        label = F.when(F.col("event_type") == kind, code).otherwise(label)
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("pos"), label.alias("ss"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every residue of every document; as structure the labels of the user with that id, over and over along the whole
    sequence, blank where there is no such user."""
    labels = ss(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ss"))), lambda x: x["ss"]), "").alias("dssp"))
    s = seqs(spark, sf_dir).filter(F.length("seq") > 0).join(labels, F.col("user_id") == F.col("doc_id"), "left")
    n, label = F.length("seq"), F.coalesce(F.nullif("dssp", F.lit("")), F.lit(" "))
    dssp = F.left(F.repeat(label, F.ceil(n / F.length(label)).cast("int")), n)
    return s.select(F.col("doc_id").alias("segment_id"), F.col("seq").alias("fasta"), dssp.alias("dssp"))


_THREE = ", ".join(f"'{ONE_TO_THREE[a] if a != 'H' else 'HIS'}'" for a in AMINO)
SQL = {
    "seqs": "select doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') as seq from documents",
    "atoms": f"""select vec_id as structure_id, label, (p + 1)::int as serial, (p // 3 + 1)::int as res_seq, ['N', 'CA', 'C'][p % 3 + 1] as name,
  left(['N', 'CA', 'C'][p % 3 + 1], 1) as element, [{_THREE}][(vec_id * 7 + (p // 3 + 1) * 3 + label) % 20 + 1] as res_name, 'A' as chain_id,
  embedding[p * 3 + 1]::double * 8 as x, embedding[p * 3 + 2]::double * 8 as y, embedding[p * 3 + 3]::double * 8 as z
  from embeddings, (select unnest(range(21)) as p)""",
    "ss": "select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as pos, case event_type "
    + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_SS.items()) + " end as ss from events",
    "segments": """select doc_id as segment_id, seq as fasta, left(repeat(label, (length(seq) // length(label) + 1)::int), length(seq)) as dssp
  from (select doc_id, seq, coalesce(dssp, ' ') as label from seqs left join (select user_id, string_agg(ss, '' order by pos) as dssp from ss group by user_id)
  on user_id = doc_id where length(seq) > 0)""",
}
NEEDS = {"segments": ("seqs", "ss")}


def with_views(*names: str, more: str = "") -> str:
    """The WITH clause of the named views and those they need; ``more``: further ones, comma first."""
    every: list[str] = []
    for n in names:
        every += [x for x in (*NEEDS.get(n, ()), n) if x not in every]
    parts = [f"{n} as ({SQL[n]})" for n in every] + ([more] if more else [])
    return "with " + ",\n".join(parts) + "\n"
