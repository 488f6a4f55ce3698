"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a table may be broadcast after it has been counted.
BROADCAST_ROWS = 200_000
#: Bytes up to which a table of wide rows may be broadcast.
BROADCAST_BYTES = 64 << 20

#: What an operator's functions remember in a Python worker, and how to drop it.
_memories: dict[str, Callable[[], None]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of our own only where none is set and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-foldlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here, and the table
    outlives any executor. What reads it plans fresh exchanges, whose skewed partitions Spark can split."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, width: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffled join. With ``width``, the
    bytes of a row of unbounded size, these must not exceed BROADCAST_BYTES in all. ``df`` should be a written table: it is
    counted here."""
    fits = df.limit(rows + 1).count() <= rows
    if fits and width is not None:
        fits = df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int")


def text_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of whole texts that a Python worker holds at once, unless the session already sets fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def packed(keep: dict[str, Column] | None) -> Column:
    """Columns to be kept, as one: no name of theirs can clash with one of ours."""
    return F.struct(*[c.alias(n) for n, c in (keep or {}).items()]) if keep else F.struct(F.lit(0).alias("none"))


def unpacked(keep: dict[str, Column] | None, column: str = "kept") -> list[Column]:
    return [F.col(f"{column}.`{n}`").alias(n) for n in keep or {}]


def bounded_sample(df: DataFrame, id_col: str, rows: int, by: str | None = None) -> DataFrame:
    """About ``rows`` rows of ``df`` (of each value of ``by``), all if there are fewer, chosen by a hash of the id.

    The number is a bound in expectation; the hash is uniform, so for 1,000 rows or more it is exceeded by under a
    tenth. Only the counts reach the driver.
    """
    if by is None:
        n = df.count()
        share = F.lit(rows / n if n else 1.0)
    else:
        counts = {r[by]: r["count"] for r in df.groupBy(by).count().collect()}
        share = F.lit(0.0)
        for value, n in counts.items():
            share = F.when(F.col(by) == F.lit(value), rows / n).otherwise(share)
    return df.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < share * (1 << 30))


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """``forget`` drops what this operator remembers in a worker."""
    _memories[operator] = forget


@contextlib.contextmanager
def worker_of(operator: str):
    """Around an operator's work in a Python worker. Spark uses a worker for many tasks, whichever operator they are of: what
    other operators remember goes, and freed memory is given back at the end, as the worker may lie idle beside a full heap."""
    for name, forget in _memories.items():
        if name != operator:
            forget()
    yield
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def work_of(operator: str):
    """Decorates a function from batches to batches."""

    def around(f):
        @functools.wraps(f)
        def within(batches: Iterator) -> Iterator:
            with worker_of(operator):
                yield from f(batches)

        return within

    return around


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows that a Python worker is sent at once, for the jobs that run within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
