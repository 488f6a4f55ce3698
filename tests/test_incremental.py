"""Incremental ingest: replays, batches that failed half-way, buckets that are not read."""

import pytest
from pyspark.sql import functions as F

from foldlake.streaming import incremental as I

SCHEMA = "id long, t string"


def _rows(spark, path):
    return sorted(((r.id, r.t) for r in I.read(spark, path, SCHEMA).collect()), key=str)


def test_replayed_and_half_written_batches(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], SCHEMA)
    I.add(one, "s-0", path, "id", 4)
    I.add(one, "s-0", path, "id", 4)
    assert _rows(spark, path) == [(1, "a"), (2, "b"), (None, "n")]
    # a batch that wrote its rows but was not entered: they are not the table's, and its rerun replaces them
    spark.createDataFrame([(7, "lost", 0)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(f"{path}/batch=s-1")
    assert _rows(spark, path) == [(1, "a"), (2, "b"), (None, "n")]
    I.add(spark.createDataFrame([(2, "again"), (3, "c"), (None, "m")], SCHEMA), "s-1", path, "id", 4)
    assert _rows(spark, path) == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
    I.add(one.filter(F.lit(False)), "s-2", path, "id", 4)
    assert _rows(spark, path) == [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
    I.compact(spark, path, SCHEMA, str(tmp_path / "less"))
    assert _rows(spark, str(tmp_path / "less")) == _rows(spark, path)


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    path = str(tmp_path / "out")
    I.add(spark.range(500).select("id", F.lit("x").alias("t")), "s-0", path, "id", 16)
    new = spark.createDataFrame([(3, "y"), (1000, "z")], SCHEMA)
    there = I.present(spark, path, new, "id", 16)
    every = list((tmp_path / "out").glob("batch=*/bucket=*"))
    plan = there._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "ReadSchema: struct<id:bigint>" in plan
    asked = [r[0] for r in new.select(I._bucket("id", 16)).distinct().collect()]
    assert there.count() == I.read(spark, path, SCHEMA).filter(F.col("bucket").isin(asked)).count() < 200
    assert len(every) >= 16


def test_stream_from_its_start_twice(spark, tmp_path):
    spark.range(20).select("id", F.lit("x").alias("t")).repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    I.ingest(read(), lambda b: b, str(tmp_path / "out"), str(tmp_path / "c1"), "id", 4)
    I.ingest(read(), lambda b: b, str(tmp_path / "out"), str(tmp_path / "c2"), "id", 4)
    assert [r[0] for r in _rows(spark, str(tmp_path / "out"))] == sorted(range(20), key=str)
    assert I.finished(spark, str(tmp_path / "out")).count() >= 6


def test_failing_transform_adds_nothing(spark, tmp_path):
    spark.range(3).select("id", F.lit("x").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="no such column|UNRESOLVED_COLUMN"):
        I.ingest(stream, lambda b: b.select("other"), str(tmp_path / "out"), str(tmp_path / "c"), "id")
    I.ingest(stream, lambda b: b, str(tmp_path / "out"), str(tmp_path / "c"), "id")
    assert len(_rows(spark, str(tmp_path / "out"))) == 3
