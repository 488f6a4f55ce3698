"""Zstandard WARC archives: written and read back by Spark tasks.

An archive begins with a skippable frame that holds its dictionary, then has one Zstandard frame for each record. Of
records with equal payloads of at least ``least`` bytes one is a response and the others are revisits without payload
that refer to it. Tasks write archives of bounded size under names of their own into a shared folder; only the archives
that finished tasks report are read, so a repeated task does no harm. Reading loads the dictionary, decodes frame by
frame, and checks version, headers, lengths, digests and that each frame is exactly one record.

Defined results: a null payload is empty. Equal payloads have equal SHA-1 digests and lengths. Of repeated ids with the
largest id of their group each is a response. A null id is never referred to: it revisits the group's largest id, or is
a response if the group has none. A null URL is left out. An empty table gives no archive and no rows. A payload of any
length is one record; archives close after the record that fills them. Ids are whole numbers.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, shared_dir, small, text_batches

#: Magic number of the skippable frame that holds a dictionary; Zstandard's own frame magic.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, error string"
ARROW_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())])


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A whole WARC record; ``digest`` is the payload's SHA-1 in hex."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(url.split())))
    if revisit:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of RECORD from a whole record; ValueError if it is not exactly one valid record."""
    top, sep, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.split(b"\r\n")
    if version != VERSION or not sep:
        raise ValueError("version")
    head = {}
    for line in lines:
        k, colon, v = line.decode().partition(":")
        if not colon or k.lower() in head:
            raise ValueError("header line")
        head[k.lower()] = v.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - head.keys()
    if missing:
        raise ValueError("missing " + ", ".join(sorted(missing)))
    n = int(head["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("record length")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    said = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = head["warc-type"] == "revisit"
    if not sep or len(said) != 1 or head["warc-type"] not in ("response", "revisit"):
        raise ValueError("type or block")
    if revisit and (payload or head.get("warc-profile") != PROFILE or "warc-refers-to" not in head):
        raise ValueError("revisit")
    if not revisit and (said[0] != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload length or digest")
    return {"page_id": _page(head["warc-record-id"]), "payload_bytes": said[0], "payload_digest": digest, "record_type": head["warc-type"],
            "refers_to": _page(head["warc-refers-to"]) if revisit else None, "error": None}


class Archive:
    """Collects records; the dictionary is trained on the first of them."""

    def __init__(self, dictionary_bytes: int = 16_384, samples: int = 200, level: int = 3):
        self.dictionary_bytes, self.samples, self.level = dictionary_bytes, samples, level
        self.waiting: list[bytes] = []
        self.parts: list[bytes] = []
        self.size = self.records = 0
        self.compress = None

    def _begin(self) -> None:
        try:
            dictionary = zstandard.train_dictionary(self.dictionary_bytes, [w[:65536] for w in self.waiting]).as_bytes()
        except zstandard.ZstdError:  # too little to learn from
            dictionary = b""
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=self.level, dict_data=given, write_content_size=True, write_checksum=True).compress
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        for w in self.waiting:
            self._put(self.compress(w))
        self.waiting = []

    def _put(self, part: bytes) -> None:
        self.parts.append(part)
        self.size += len(part)

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.compress:
            self._put(self.compress(raw))
            return
        self.waiting.append(raw)
        if len(self.waiting) >= self.samples or sum(map(len, self.waiting)) >= 1 << 22:
            self._begin()

    def content(self) -> bytes:
        if not self.compress:
            self._begin()
        return b"".join(self.parts)


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame; ValueError where it is damaged."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    if at > len(data):
        raise ValueError("dictionary length")
    given = zstandard.ZstdCompressionDict(data[8:at]) if at > 8 else None
    decoder, view = zstandard.ZstdDecompressor(dict_data=given), memoryview(data)
    while at < len(data):
        if data[at : at + 4] != FRAME:
            raise ValueError("frame magic")
        one, out = decoder.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("cut off")
            step = view[at : at + 32_768]
            try:
                out.append(one.decompress(step))
            except zstandard.ZstdError as e:
                raise ValueError(f"frame: {e}") from e
            at += len(step) - len(one.unused_data)
        yield b"".join(out)


def with_types(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """page_id, url, payload (binary), digest, revisit, refers_to."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    groups = p.filter(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    groups = cut(groups.select(F.col("digest").alias("_digest"), "first"), "digests")
    p = p.join(small(groups), large & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return p.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, *, archive_bytes: int = 8 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes ``records`` of with_types() to ``folder`` (a URI that every executor reaches). The result is a written table
    (name, records, bytes) of the archives."""
    text_batches(records.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)

        def close(a: Archive) -> pd.DataFrame:
            name, content = f"{uuid.uuid4().hex}.warc.zst", a.content()
            with store.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(content)
            return pd.DataFrame({"name": [name], "records": [a.records], "bytes": [len(content)]})

        archive = Archive()
        for batch in batches:
            for r in batch.astype({"page_id": object, "refers_to": object}).itertuples(index=False):
                page, refers = (None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to))
                archive.add(record(page, r.url, r.payload, r.digest, refers, bool(r.revisit), date))
                if archive.size >= archive_bytes:
                    yield close(archive)
                    archive = Archive()
        if archive.records:
            yield close(archive)

    return cut(records.mapInPandas(write, "name string, records bigint, bytes bigint"), "archives")


def read_archives(folder: str, archives: DataFrame) -> DataFrame:
    """RECORD rows of the listed archives, a written table. What is not valid is a row with its ``error``."""
    spark = archives.sparkSession
    if archives.isEmpty():
        return spark.createDataFrame([], RECORD)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                out = []
                try:
                    for raw in frames(data.as_py()):
                        try:
                            out.append(parse(raw))
                        except ValueError as e:
                            out.append({"error": str(e)})
                except ValueError as e:
                    out.append({"error": str(e)})
                yield pa.RecordBatch.from_pylist(out, schema=ARROW_RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(small(archives.select("name")), "name", "left_semi")
    with batches_of(spark, 1):  # a row holds a whole archive
        return cut(files.select("content").mapInArrow(rows, RECORD), "records")


def archive_pages(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes the pages to ``folder`` (by default a new one in the shared folder), reads them back: RECORD rows."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(folder, write_archives(with_types(pages, **columns), folder))
