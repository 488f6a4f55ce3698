"""Writers: Parquet is the native form; texts are written per key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new table in the cluster's shared folder; where none is set, in a temporary one if the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-foldlake-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_segments(segments: DataFrame, path: str, key: str = "segment_id") -> None:
    """One folder of text for each key. Rows of one key stay in their order (column line_no)."""
    segments.repartition(F.col(key)).sortWithinPartitions(key, "line_no").select(key, "line").write.partitionBy(key).text(path)


def write_database(records: DataFrame, path: str) -> None:
    records.write.parquet(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """k-mer counts as one folder of CSV for each size, by falling count: its files follow each other by name."""
    counts.repartitionByRange(F.col("k"), F.desc("n"), F.col("kmer")).sortWithinPartitions("k", F.desc("n"), "kmer").write.partitionBy("k").option("header", True).csv(path)


def count_lines(counts: DataFrame) -> DataFrame:
    """k and the lines ``kmer,n`` by falling count."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kmer")))
    return counts.groupBy("k").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws(",", x["kmer"], (-x["m"]).cast("string"))), "\n").alias("lines"))


def write_energies(energies: DataFrame, path: str) -> None:
    energies.select("conformer", "energy").write.csv(path)
