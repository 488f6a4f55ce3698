"""Broadcasts of sides whose size has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast.
ROWS = 200_000


def checked(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else as it is, so that the join is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
