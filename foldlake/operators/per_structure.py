"""A function of the caller's, once for each structure, with failures set aside.

The rows of a structure come to one task as Arrow batches and are counted in bytes as they come: a structure that exceeds the
bound is set aside before the rest of it is held. What the function raises, or returns without fitting the schema, is that
structure's reason; no other structure is touched. Rows and reasons are written once, with the outcome as partition column.

Defined results: rows with a null key are one structure. The order of a structure's rows is that of ``order``, if given.
An empty result is no failure. An empty table gives two empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.sinks import new_folder

#: Bytes of a structure's rows, as Arrow counts them.
MOST_BYTES = 64 << 20


def per_structure(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, *, key: str = "structure_id",
                  order: list[str] | None = None, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows of ``schema``, quarantine): quarantine has the key and a reason."""
    spark = df.sparkSession
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    fields = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in wanted])
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, value = [], 0, None
        reason, rows = None, pa.array([], fields)
        for batch in batches:
            value = batch[key][0] if value is None else value
            size += batch.nbytes
            if size > most_bytes:
                held, reason = [], "too large"
                break
            held.append(batch)
        if reason is None:
            try:
                part = pa.Table.from_batches(held).to_pandas()
                found = fn(part.sort_values(order, kind="stable", ignore_index=True) if order else part)
                found = found[wanted.names]
                if len(found):
                    rows = pa.RecordBatch.from_pandas(found, schema=pa.schema(fields), preserve_index=False).to_struct_array()
            except Exception as e:  # whatever the caller's function does
                reason = f"{type(e).__name__}: {e}"
        n = 1 if reason else len(rows)
        rows = pa.array([None], fields) if reason else rows
        keys = pa.array([value.as_py()] * n, to_arrow_type(kind))
        yield pa.RecordBatch.from_arrays([keys, pa.array([reason is None] * n, pa.bool_()), pa.array([reason] * n, pa.string()), rows], ["key", "good", "reason", "row"])

    out = StructType().add("key", kind).add("good", "boolean").add("reason", "string").add("row", wanted)
    done = df.groupBy(key).applyInArrow(run, out)
    path = new_folder(spark, "per_structure")
    done.write.partitionBy("good").parquet(path)
    table = spark.read.schema(out).parquet(path)
    return table.filter("good").select("row.*"), table.filter("not good").select(F.col("key").alias(key), "reason")
