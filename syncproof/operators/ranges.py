"""Previous values and running sums of keys that may hold any share of the rows.

Rows are laid out once by ranges of (keys, order). Within a range a window does the work; what a range begins with comes of the ranges before it.
Only the first key of a range can go on from an earlier one, so that table has a row a range at most and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncproof.scratch import cut

PART, ROW = "_part", "_row"


def laid(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, written in the order of keys and then `order`, with the row's range and a number that grows along it. Rows alike in all of these are in any order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    return cut(dealt.drop("_tie").withColumn(ROW, F.monotonically_increasing_id()).withColumn(PART, F.spark_partition_id()))


def with_previous(rows: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows of laid() with the last value of their key before them that is not null (null: there is none)."""
    own = F.last("_value", ignorenulls=True).over(Window.partitionBy(PART, *keys).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1))
    valued = rows.withColumn("_value", value)
    ends = valued.groupBy(PART, *keys).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(ROW))).alias("_end"))
    begin = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    met = _begun(valued.withColumn("_own", own), ends.withColumn("_begin", begin).filter("_begin is not null"), keys)
    return met.withColumn(name, F.coalesce("_own", "_begin")).drop("_value", "_own", "_begin")


def with_running(rows: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows of laid() with the sum of value (a long) over the rows of their key up to and with themselves."""
    own = F.sum("_value").over(Window.partitionBy(PART, *keys).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    valued = rows.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0)))
    sums = valued.groupBy(PART, *keys).agg(F.sum("_value").alias("_end"))
    begin = F.sum("_end").over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    met = _begun(valued.withColumn("_own", own), sums.withColumn("_begin", begin).filter("_begin is not null"), keys)
    return met.withColumn(name, F.col("_own") + F.coalesce("_begin", F.lit(0))).drop("_value", "_own", "_begin")


def _begun(rows: DataFrame, begins: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = begins.select(F.col(PART).alias("_begin_part"), *[F.col(f"`{k}`").alias(f"_begin_{i}") for i, k in enumerate(keys)], "_begin")
    on = [F.col(PART) == F.col("_begin_part"), *[F.col(f"`{k}`").eqNullSafe(F.col(f"_begin_{i}")) for i, k in enumerate(keys)]]
    return rows.join(F.broadcast(side), on, "left").drop("_begin_part", *[f"_begin_{i}" for i in range(len(keys))])
