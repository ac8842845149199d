"""Joins whose small side is broadcast only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits for rows with words or lists, and for rows of a few numbers.
BROADCAST_ROWS = 100_000
ID_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most ``limit`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df
