"""Positions of rows in an order, without one task for all rows or for all rows of a group.

Rows are dealt to partitions by ranges of the order, sorted there and written; what lies before a partition is summed from
counts of partitions, so that no task sees more than a range. Rows alike in all order columns are told apart by where
they stand in the input, so that even a third of all rows being equal is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncproof.llm.common import cut

_ROW, _TIE = "_row_in_order", "_row_in_input"


def _ordered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df written in its order, with a row id that grows along it: the partition in the high bits, the place there in the low 33."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn(_TIE, F.monotonically_increasing_id())
    keys = [*order, F.col(_TIE)]
    return cut(tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(_TIE).withColumn(_ROW, F.monotonically_increasing_id()))


def _split(df: DataFrame) -> DataFrame:
    return df.withColumn("_part", F.shiftright(_ROW, 33)).withColumn("_at", F.col(_ROW).bitwiseAND((1 << 33) - 1)).drop(_ROW)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2, ... along the order. The table of partitions, one row each, is broadcast."""
    rows = _split(_ordered(df, order))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(parts), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def numbered_within(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2, ... within each group (no null groups), along the order. A group may hold any share of the rows."""
    rows = _split(_ordered(df, [F.col(group), *order]))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(shifts, [group, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
