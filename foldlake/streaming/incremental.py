"""Incremental building of the database from a stream of records: the batch operators run on each micro-batch.

The table lies in folders by batch and by a bucket of the key, beside a manifest with an entry for each finished batch. A
batch reads the keys of the buckets that its own keys fall into, of finished batches only, drops what is there, writes its
rows into its own folders, and is entered last. A batch that is run again after a failure overwrites what it had written; a
finished one adds nothing. ``compact`` puts the finished batches into one.

Defined results: of rows of one key in a batch one is kept, and none of a key that the table has; a null key is a key. An
empty batch is entered in the manifest and has no folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.broadcasts import checked

MANIFEST = "_manifest"
BUCKETS = 64


def _bucket(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """batch: the finished batches."""
    entries = f"{path}/{MANIFEST}"
    rows = spark.read.schema("batch string").parquet(entries) if _exists(spark, entries) else spark.createDataFrame([], "batch string")
    return rows.distinct()


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """batch, bucket and the columns of ``schema`` of all finished batches."""
    own = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*own.fields, *StructType.fromDDL("batch string, bucket int").fields])
    if not _exists(spark, path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path).join(checked(finished(spark, path)), "batch", "left_semi")


def present(spark: SparkSession, path: str, new: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The keys the table has in the buckets of ``new``'s keys; other buckets' files are not read."""
    own = sorted(r[0] for r in new.select(_bucket(key, buckets)).distinct().collect())  # at most the number of buckets
    return read(spark, path, new.select(key).schema).filter(F.col("bucket").isin(own)).select(key)


def add(batch: DataFrame, name: str, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Adds the rows of a batch that the table lacks, once, however often it is called."""
    spark = batch.sparkSession
    done = {r["batch"] for r in finished(spark, path).filter(F.col("batch") == name).collect()}
    if done:
        return
    new = batch.dropDuplicates([key])
    there = present(spark, path, new, key, buckets).withColumnRenamed(key, "_there")
    fresh = new.join(there, F.col(key).eqNullSafe(F.col("_there")), "left_anti").withColumn("bucket", _bucket(key, buckets))
    fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={name}")
    spark.createDataFrame([(name,)], "batch string").coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")


def compact(spark: SparkSession, path: str, schema: StructType | str, into: str) -> None:
    """A table at ``into`` with the same rows in one finished batch; the old one stays as it is."""
    rows = read(spark, path, schema).drop("batch")
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{into}/batch=compacted")
    spark.createDataFrame([("compacted",)], "batch string").coalesce(1).write.parquet(f"{into}/{MANIFEST}")


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str, buckets: int = BUCKETS) -> None:
    """Transforms what is available, and appends the rows whose key the table at ``path`` lacks. Batches are named by the
    stream's checkpoint and their number in it."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # its keys are asked before it is written
        try:
            add(transform(held), f"{name}-{number}", path, key, buckets)
        finally:
            held.unpersist()

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
