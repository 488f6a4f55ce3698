"""Queries whose point is an order give their rows in it."""

import pytest

from foldlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "key"), [
    ("sort_ids", lambda r: r["id"]),
    ("sort_hits", lambda r: (-r["n"], r["kmer"])),
    ("sort_report", lambda r: r["structure_id"]),
])
def test_rows_come_in_order(spark, name, key):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert len(rows) > 5 and [key(r) for r in rows] == sorted(key(r) for r in rows)
