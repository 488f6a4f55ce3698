"""Tar archives of any size, by their headers: a task walks an archive's headers without reading what lies between, which
gives a table of members; their contents are then read by ranges, by as many tasks as there are bytes for.

Defined results: names of the ustar format, long names (of either kind) included; only plain files are members. What is no
archive, or breaks off, gives a row without a name for its archive, and the members before the damage. An empty file is an
empty archive.
"""

from __future__ import annotations

import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 512
MEMBERS = "archive string, path string, name string, start bigint, size bigint"
#: Members whose contents one Arrow batch holds.
AT_ONCE = 64


def _text(field: bytes) -> str:
    return field.split(b"\0", 1)[0].decode("utf-8", "replace")


def _number(field: bytes) -> int:
    """Octal digits, or big-endian bytes behind a set high bit."""
    if field[:1] >= b"\x80":
        return int.from_bytes(field[1:], "big")
    digits = field.strip(b"\0 ")
    return int(digits, 8) if digits else 0


def walk(file, length: int) -> Iterator[tuple[str | None, int, int]]:
    """(name, start, size) of the plain files of an open archive; a name of None where it is damaged, and no more after it."""
    at, named = 0, None
    while at < length:
        head = file.read_at(BLOCK, at)
        if len(head) == BLOCK and not head.strip(b"\0"):
            return  # the end mark
        try:
            whole = len(head) == BLOCK and _number(head[148:156]) == sum(head) - sum(head[148:156]) + 8 * 32
            size, kind = (_number(head[124:136]), head[156:157]) if whole else (-1, b"")
        except ValueError:
            size = -1
        start = at + BLOCK
        if size < 0 or start + size > length:
            yield None, at, 0
            return
        if kind == b"L":
            named = _text(file.read_at(size, start))
        elif kind in (b"x", b"X"):
            records = file.read_at(size, start).decode("utf-8", "replace").split("\n")
            named = next((r.split("path=", 1)[1] for r in records if r.partition(" ")[2].startswith("path=")), named)
        else:
            prefix = _text(head[345:500]) if head[257:262] == b"ustar" else ""
            name = named if named is not None else (f"{prefix}/" if prefix else "") + _text(head[:100])
            named = None
            if kind in (b"0", b"\0", b"7"):
                yield name, start, size
        at = start + -(-size // BLOCK) * BLOCK
    if at > length:
        yield None, at, 0


def members(spark: SparkSession, folder: str, suffix: str = "", glob: str = "*.tar") -> DataFrame:
    """MEMBERS of the archives under ``folder`` whose names end in ``suffix``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                store, at = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                archive = at.rpartition("/")[2].rpartition(".")[0]
                with store.open_input_file(at) as f:
                    found = [x for x in walk(f, length) if x[0] is None or x[0].endswith(suffix)]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([archive] * n, pa.string()), pa.array([path] * n, pa.string()), *[pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]], ["archive", "path", "name", "start", "size"])

    return files.repartition(F.col("path")).mapInArrow(look, MEMBERS)


def contents(found: DataFrame) -> DataFrame:
    """archive, name, content of some members, read by their ranges."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = None, None
        for whole in batches:
            for first in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(first, AT_ONCE)
                out = []
                for path, name, start, size in zip(*[batch[c].to_pylist() for c in ("path", "name", "start", "size")], strict=True):
                    if path != last:
                        store, at = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                        last, file = path, store.open_input_file(at)
                    out.append(None if name is None else file.read_at(size, start))
                yield pa.RecordBatch.from_arrays([batch["archive"], batch["name"], pa.array(out, pa.binary())], ["archive", "name", "content"])

    return found.repartition("path", F.floor(F.col("start") / (32 << 20))).mapInArrow(read, "archive string, name string, content binary")


def write_tars(texts: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> None:
    """``texts`` (name, text) as archives of about so many bytes; a failed task's archives are removed when it ends."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(at)
        for batch in _filled(batches, archive_bytes):
            name = f"{at}/{uuid.uuid4().hex}"
            with store.open_output_stream(f"{name}.part") as out, tarfile.open(fileobj=out, mode="w|") as t:
                for rows in batch:
                    for member, text in zip(rows["name"].to_pylist(), rows["text"].to_pylist(), strict=True):
                        data = (text or "").encode()
                        info = tarfile.TarInfo(member)
                        info.size = len(data)
                        t.addfile(info, pa.BufferReader(data))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    done = texts.select("name", "text").mapInArrow(write, "name string").collect()  # a name for each archive
    if done:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for r in done:
            store.move(f"{r['name']}.part", f"{r['name']}.tar")


def _filled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until they hold ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield held
            held = []
    if held:
        yield held
