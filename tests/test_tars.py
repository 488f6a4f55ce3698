"""Tar archives by their headers: long names, other kinds of members, damage; written and read back."""

import io
import tarfile

import pyarrow as pa
import pytest

from foldlake.sources import lines as L
from foldlake.sources import tars


def _archive(kind, files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=kind) as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(data)
            t.addfile(info, io.BytesIO(data or b""))
    return out.getvalue()


FILES = [("a.pdb", b"one"), ("folder", None), ("folder/" + "x" * 180 + ".pdb", b"y" * 1500), ("é.txt", b""), ("b.pdb", b"z" * 512)]


@pytest.mark.parametrize("kind", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_headers_are_walked(kind):
    files = FILES if kind != tarfile.USTAR_FORMAT else [("d" * 90 + "/" + "e" * 60, b"split"), *FILES[:2], FILES[4]]
    data = _archive(kind, files)
    found = list(tars.walk(pa.BufferReader(data), len(data)))
    assert [(n, data[s : s + k]) for n, s, k in found] == [(n, d) for n, d in files if d is not None]
    cut = data[: found[-1][1] + 3]
    assert [n for n, _, _ in tars.walk(pa.BufferReader(cut), len(cut))] == [n for n, _, _ in found[:-1]] + [None]
    assert list(tars.walk(pa.BufferReader(b""), 0)) == []
    assert [n for n, _, _ in tars.walk(pa.BufferReader(b"no archive" * 90), 900)] == [None]


def test_folder_of_archives(spark, tmp_path):
    (tmp_path / "x.tar").write_bytes(_archive(tarfile.GNU_FORMAT, FILES))
    (tmp_path / "y.tar").write_bytes(_archive(tarfile.PAX_FORMAT, FILES)[:700])
    (tmp_path / "empty.tar").write_bytes(b"")
    got = sorted((r.archive, r.name, bytes(r.content) if r.content is not None else None) for r in L.read_tar(spark, str(tmp_path), ".pdb").collect() if r.name)
    assert got == sorted([("x", n, d) for n, d in FILES if d is not None and n.endswith(".pdb")] + [("y", "a.pdb", b"one")])
    assert [r.archive for r in L.read_tar(spark, str(tmp_path)).collect() if r.name is None] == ["y"]


def test_written_and_read_back(spark, tmp_path):
    rows = [(f"{i}.txt", f"text {i} é" * (i % 9)) for i in range(500)] + [("none.txt", None)]
    tars.write_tars(spark.createDataFrame(rows, "name string, text string").repartition(3), f"file://{tmp_path}/out", archive_bytes=5000)
    assert len(list((tmp_path / "out").glob("*.tar"))) >= 3
    got = {r.name: bytes(r.content).decode() for r in L.read_tar(spark, f"file://{tmp_path}/out").collect()}
    assert got == {n: t or "" for n, t in rows}
