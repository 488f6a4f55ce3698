"""Many small texts in few files: shards of bounded size, and a table of where each text lies.

Tasks append the texts they hold to a shard until it is full, and list (id, shard, start, length) in a table. So there are
as many files as the bytes ask for, however many texts there are. A text is read back by its range; ids alone need the
table only. A shard of a task that failed is in no table.

Defined results: a null text is an empty one; rows of one id are texts of their own; a text longer than a shard has a shard
of its own. An empty table has no shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a shard.
SHARD_BYTES = 64 << 20
OFFSETS = "id string, shard string, start bigint, length bigint"


def write_packed(texts: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Packs ``texts`` (id, text) into ``path``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pyarrow.fs.FileSystem.from_uri(f"{path}/shards")
        store.create_dir(folder)
        out, name, size = None, "", 0
        try:
            for batch in batches:
                rows: list[list] = [[], [], [], []]
                for key, text in zip(batch["id"], batch["text"], strict=True):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    if out is None or size and size + len(data) > shard_bytes:
                        if out is not None:
                            out.close()
                        name, size = uuid.uuid4().hex, 0
                        out = store.open_output_stream(f"{folder}/{name}")
                    out.write(data)
                    for column, value in zip(rows, (key.as_py(), name, size, len(data)), strict=True):
                        column.append(value)
                    size += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["id", "shard", "start", "length"])
        finally:
            if out is not None:
                out.close()

    rows = texts.select(F.col("id").cast("string").alias("id"), "text")
    rows.mapInArrow(pack, OFFSETS).write.parquet(f"{path}/offsets")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OFFSETS).parquet(f"{path}/offsets")


def read_packed(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """id, text of all texts, or of those that ``wanted`` (rows of offsets) lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pyarrow.fs.FileSystem.from_uri(f"{path}/shards")
        name, file = None, None
        try:
            for batch in batches:
                texts = []
                for shard, start, length in zip(batch["shard"].to_pylist(), batch["start"].to_pylist(), batch["length"].to_pylist(), strict=True):
                    if shard != name:
                        if file is not None:
                            file.close()
                        name, file = shard, store.open_input_file(f"{folder}/{shard}")
                    texts.append(file.read_at(length, start).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], ["id", "text"])
        finally:
            if file is not None:
                file.close()

    rows = offsets(spark, path) if wanted is None else wanted
    return rows.select("id", "shard", "start", "length").mapInArrow(read, "id string, text string")


def resolve(spark: SparkSession, path: str, lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """(offsets of the texts that list files name, the entries that no text has). Entries are trimmed; blank ones do not count."""
    named = spark.read.text(lists).select(F.trim("value").alias("id")).filter("id <> ''").distinct()
    every = offsets(spark, path)
    return every.join(named, "id", "left_semi"), named.join(every.select("id"), "id", "left_anti")
