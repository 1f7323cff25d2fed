"""As-of and interval joins without a task for a whole key.

As-of: both sides are laid out together by ranges of (key, time); within a range the last right row is carried on, and what a range begins with is
the last right row of the ranges before it, one row for each range and key. Interval: an interval is put into buckets as wide as itself at least, two
at most, and a point asks one bucket of each width that occurs, so that both meet by equality; keys of very many points are salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncproof.scratch import cut


def asof_join(left: DataFrame, right: DataFrame, at: str, right_at: str, by: Sequence[str] = (), tolerance: object | None = None) -> DataFrame:
    """Each left row with the last right row of its keys at or before its time; right columns (but keys) are null where there is none.

    Right rows of one key and time: the greatest in the order of all columns counts. Null times meet nothing; null keys meet null keys. With a
    tolerance, older right rows than that do not count. Right columns must not have names of the left side's, but for the keys.
    """
    spark, more = left.sparkSession, [c for c in right.columns if c not in by]
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]
    none = lambda df: F.lit(None).cast(df)
    carried, own = F.struct(*[F.col(f"`{c}`") for c in more]), F.struct(*[F.col(f"`{c}`") for c in left.columns])
    r = right.filter(F.col(f"`{right_at}`").isNotNull()).select(*named, F.col(f"`{right_at}`").alias("_t"), F.lit(0).alias("_side"), carried.alias("_right"))
    l = left.select(*named, F.col(f"`{at}`").alias("_t"), F.lit(1).alias("_side"), own.alias("_left"))  # noqa: E741
    both = r.withColumn("_left", none(l.schema["_left"].dataType)).unionByName(l.withColumn("_right", none(r.schema["_right"].dataType)))
    order = [*keys, "_t", "_side", "_right"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = both.withColumn("_tie", F.monotonically_increasing_id())
    laid = cut(tied.repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).drop("_tie"))
    within = F.last("_right", ignorenulls=True).over(Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    ends = laid.groupBy("_part", *keys).agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col("_row"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = ends.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"{k}b") for k in keys], before.alias("_begin")).filter("_begin is not null")
    met = laid.withColumn("_found", within).filter("_side = 1").join(begins, [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys]], "left")
    found = F.coalesce("_found", "_begin")
    ok = F.col("_t").isNotNull()
    if tolerance is not None:
        ok = ok & (F.col("_t") - found[right_at] <= F.lit(tolerance))
    return met.select("_left.*", F.when(ok, found).alias("_r")).select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_r.`{c}`").alias(c) for c in more])


def interval_join(points: DataFrame, intervals: DataFrame, at: str, lo: str, hi: str, by: Sequence[str] = (), width: int = 1, salts: int = 1) -> DataFrame:
    """Points of lo <= at < hi (longs) of their keys with the columns of both sides; names must differ but for the keys.

    Buckets are `width` times a power of two wide. Empty intervals and null ends meet nothing. With salts, points of a key are dealt to so many
    shares, and each interval is there in every one.
    """
    length = F.col(hi) - F.col(lo)
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / width))).cast("int")
    size = lambda x: F.lit(width).cast("long") * F.pow(F.lit(2), x).cast("long")
    bucket = lambda t, x: t - F.pmod(t, size(x))
    whole = intervals.filter(length > 0).withColumn("_level", level)
    first, last = bucket(F.col(lo), F.col("_level")), bucket(F.col(hi) - 1, F.col("_level"))
    wide = whole.withColumn("_bucket", F.explode(F.array_distinct(F.array(first, last))))
    levels = [r[0] for r in whole.select("_level").distinct().collect()]  # 64 at most
    asked = points.filter(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bucket", bucket(F.col(at), F.col("_level")))
    on = [*by, "_level", "_bucket"]
    if salts > 1:
        asked, wide, on = asked.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), F.lit(salts))), wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "_salt"]
    return asked.join(wide, on).filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_level", "_bucket", "_salt")


def lexicographic(keys: Sequence[Column], bound: Sequence[Column], at_least: bool) -> Column:
    """keys >= bound (or keys < bound) in the order of tuples; the first key alone is compared too, for scans that take plain predicates."""
    out = F.lit(at_least)
    for k, b in reversed(list(zip(keys, bound, strict=True))):
        out = (k > b if at_least else k < b) | ((k == b) & out)
    return (keys[0] >= bound[0] if at_least else keys[0] <= bound[0]) & out
