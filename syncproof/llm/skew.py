"""A left join whose left side may hold any share of its rows under one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_hot(left: DataFrame, right: DataFrame, on: Sequence[str], shares: int = 200) -> DataFrame:
    """left with right's further columns (null where there is no partner); right has each key once, keys are not null.

    Keys of more than one in `shares` of the left rows are at most `shares` in number: their partners are broadcast, and those rows
    stay where they are. All other rows meet by a shuffle.
    """
    total = left.count()
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") * shares > total).select(*on, F.lit(True).alias("_hot")).limit(shares)
    marked = left.join(F.broadcast(hot), list(on), "left")
    few = right.join(F.broadcast(hot), list(on), "left_semi")
    more = [c for c in right.columns if c not in on]
    near = marked.filter("_hot").drop("_hot").join(F.broadcast(few), list(on), "left")
    far = marked.filter("_hot is null").drop("_hot").join(right, list(on), "left")
    return near.select(*left.columns, *more).unionByName(far.select(*left.columns, *more))
