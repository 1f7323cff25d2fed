"""Joins with sides of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows (it is counted up to there), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
