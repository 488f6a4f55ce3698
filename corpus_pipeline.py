"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each result as Parquet
and reads it again. All but the last return the columns of ``docs``, further columns included.

Defined results, for every stage: null texts count as empty and stay null where a text is kept; repeated rows are judged
each, but copies leave one row in the near-duplicate stage; rows with a null id are kept or dropped
by their text like others; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldlake.llm import decontaminate, jaccard, packing, pii, quality
from foldlake.llm.common import cut, remainder, shared_dir, small

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048


def _packed(docs: DataFrame) -> DataFrame:
    """The whole row as one column, beside id and text: no name of the input can clash with one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.col("text").alias("_raw"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.7 or more stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.filter(remainder(F.col("doc_id"), 4) != 2))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _unpacked(quality.score(docs, model, keep={"_row": row}).filter(F.col("predicted") == 1), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word n-grams, similarity 0.8) stays: that with the least id.
    Documents without n-grams stay. Different texts under one id are documents of their own; of rows without an id, in
    a group that has none, one of each text stays."""
    groups = cut(jaccard.similar_groups(docs, n=5, num=80, den=100), "stage_groups")
    has = F.col("n_shingles") > 0
    named = groups.filter(has & F.col("component_id").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = named.groupBy("doc_id", F.col("_t").alias("_u")).agg(F.count(F.lit(1)).alias("_n"))
    bare = groups.filter(has & F.col("component_id").isNull()).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    keys = cut(keys.unionByName(bare.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("_t").alias("_u"), "_n")).withColumnRenamed("doc_id", "_id"), "stage_keys")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    held = _packed(docs.filter(~wordless)).withColumn("_h", F.xxhash64("_raw"))
    held = held.join(small(keys, 1_000_000), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_u")))
    single, repeated = held.filter("_n = 1"), held.filter("_n > 1")
    one = F.row_number().over(Window.partitionBy("_id", "_u").orderBy("_h"))  # rows of one id and text
    kept = single.select("_row").unionByName(repeated.withColumn("_r", one).filter("_r = 1").select("_row"))
    return _unpacked(kept, docs).unionByName(docs.filter(wordless))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark passages of 13 words go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = cut(found.filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("_t").alias("_u")).distinct(), "stage_bad")
    return _unpacked(_packed(docs).join(small(bad), F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64("_raw") == F.col("_u")), "left_anti"), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the text; n_chars follows it."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    pieces = packing.tokenise(docs, public_tokenizers.path(TOKENIZER), size=SEQUENCE)
    return packing.pack(pieces, size=SEQUENCE).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: No stage of the model or of the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
