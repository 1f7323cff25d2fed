"""Anomaly scores of metric series: median and MAD of up to 200 values before, mean and deviation where MAD is 0."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from syncproof.functions.joins import bounded
from syncproof.scratch import cut

COLD, MAD_FACTOR, LIMIT, MEMORY = 8, 0.6745, 3.5, 200


def judged(df: DataFrame, value: str) -> DataFrame:
    """df with the history's _n, _mean, _sd, _med and _mad -> status, score and anomaly in their place."""
    v = F.col(value)
    robust = F.abs(MAD_FACTOR * (v - F.col("_med")) / F.when(F.col("_mad") > 0, F.col("_mad")))
    plain = F.abs(v - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd"))
    flag = F.when(robust.isNotNull() | plain.isNotNull(), F.coalesce(robust, plain) > LIMIT).otherwise(v != F.col("_mean"))
    warm = F.col("_n") >= COLD
    return df.withColumns({"status": F.when(warm, "scored").otherwise("cold_start"), "score": F.when(warm, F.coalesce(robust, plain, F.lit(0.0))).otherwise(0.0), "anomaly": warm & F.coalesce(flag, F.lit(False))}).drop("_n", "_mean", "_sd", "_med", "_mad")


def anomaly_mad(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, memory: int = MEMORY) -> DataFrame:
    """Each row against the up to `memory` rows before it in its series, itself not among them."""
    return judged(with_history(df, keys, order, value, memory, life=False), value)


def anomaly_lifetime(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The batch twin of the streaming model: mean and deviation over the whole life of a series, median and MAD over the last 200."""
    return judged(with_history(df, keys, order, value, MEMORY, life=True), value)


def with_history(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, memory: int, life: bool, block: int = 4096) -> DataFrame:
    """df with _n, _mean, _sd (of the `memory` rows before, or of all with life), _med and _mad (of the `memory` rows before); NULL values do not count.

    A series may hold a third of all rows, so it is never one task's: rows are dealt into ranges of (keys, order) and ranked by
    place in the range and rows in the ranges before; ranks make blocks, each of which also gets the last rows of the one before.
    A block's windows are worked out in numpy. Of the life before a block only three sums go on.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(keys))]
    dealt = df.withColumns({n: F.col(k) for n, k in zip(names, keys, strict=True)}).repartitionByRange(ranges, *names, *order).withColumn("_range", F.spark_partition_id())
    rows = cut(dealt.withColumn("_v", F.col(value).cast("double")))  # written, as the ranges come from a sample
    sizes = rows.groupBy(*names, "_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("_range").alias("_range_"), before.alias("_before"))
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    within = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*names, "_range").orderBy(*order)))
    ranked = within.join(bounded(starts), [*same, F.col("_range") == F.col("_range_")]).withColumn("_rank", F.col("_before") + F.col("_i") - 1).drop("_range", "_i", "_before", "_range_", *[f"{n}_" for n in names])
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / block))
    if life:
        sums = ranked.groupBy(*names, "_block").agg(F.count("_v").alias("_b0"), F.sum("_v").alias("_b1"), F.sum(F.col("_v") * F.col("_v")).alias("_b2"))
        w = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        earlier = sums.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("_block").alias("_block_"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("double").alias(f"_s{i}") for i, c in enumerate(("_b0", "_b1", "_b2"))])
        ranked = ranked.join(bounded(earlier), [*same, F.col("_block") == F.col("_block_")]).drop("_block_", *[f"{n}_" for n in names])
    kept = [c for c in ranked.columns if c not in ("_block", *names)]
    row = F.struct(*kept)
    own = ranked.select(*names, "_block", row.alias("_row"), F.lit(True).alias("_own"))
    lead = ranked.filter(F.col("_rank") % block >= block - memory).select(*names, (F.col("_block") + 1).alias("_block"), row.alias("_row"), F.lit(False).alias("_own"))
    stats = ["_n", "_mean", "_sd", "_med", "_mad"]
    schema = T.StructType([T.StructField("_row", own.schema["_row"].dataType), *[T.StructField(c, T.LongType() if c == "_n" else T.DoubleType()) for c in stats]])

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rank, mine = pc.struct_field(group["_row"], "_rank").to_numpy(), group["_own"].to_numpy()
        at = np.argsort(rank, kind="stable")
        v = pc.struct_field(group["_row"], "_v").to_numpy(zero_copy_only=False).astype(float)[at]
        first = int((~mine).sum())
        if first == len(at):  # rows that only lead a block which does not come
            return pa.table({f.name: pa.array([], t) for f, t in zip(schema, types, strict=True)})
        carried = [float(pc.struct_field(group["_row"], f"_s{i}")[int(at[first])].as_py()) for i in range(3)] if life else None
        found = windows(v, first, memory, carried)
        out = [group["_row"].combine_chunks().take(pa.array(at[first:])), pa.array(found[0].astype(np.int64))]
        return pa.table([*out, *[pa.array(x, from_pandas=True) for x in found[1:]]], names=["_row", *stats])

    types = [to_arrow_type(f.dataType) for f in schema]
    judged_rows = own.unionByName(lead).groupBy(*names, "_block").applyInArrow(work, schema)
    return judged_rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns], *stats)


def windows(v: np.ndarray, first: int, memory: int, carried: list[float] | None) -> list[np.ndarray]:
    """count, mean, deviation, median and MAD of the up to `memory` values before each v[first:], NaN standing for NULL.

    carried: count, sum and sum of squares of the series before v[first], if the first three are over the whole life.
    """
    padded = np.concatenate([np.full(memory, np.nan), v])
    out = [np.empty(len(v) - first) for _ in range(5)]
    step = max(1, (1 << 20) // memory)
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        for a in range(first, len(v), step):
            b = min(len(v), a + step)
            w = np.lib.stride_tricks.sliding_window_view(padded[a : b + memory - 1], memory)
            whole = ~np.isnan(padded[a : b + memory - 1]).any()
            middle = np.median if whole else np.nanmedian
            med = middle(w, axis=1)
            n = np.full(b - a, memory) if whole else (~np.isnan(w)).sum(axis=1)
            mean = np.nanmean(w, axis=1)
            sd = np.where(n > 1, np.sqrt(np.nansum((w - mean[:, None]) ** 2, axis=1) / np.maximum(n - 1, 1)), np.nan)
            for x, y in zip(out, (n, mean, sd, med, middle(np.abs(w - med[:, None]), axis=1)), strict=True):
                x[a - first : b - first] = y
        if carried is not None:
            own = np.nan_to_num(v[first:])
            there = (~np.isnan(v[first:])).astype(float)
            n, s, q = (c + np.concatenate([[0], np.cumsum(x)[:-1]]) for c, x in zip(carried, (there, own, own * own), strict=True))
            out[0], out[1] = n, np.where(n > 0, s / n, np.nan)
            out[2] = np.where(n > 1, np.sqrt(np.maximum(q - s * s / np.maximum(n, 1), 0) / np.maximum(n - 1, 1)), np.nan)
    return out


def recent_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, most: int = MEMORY) -> DataFrame:
    """(keys, n, series): the newest values of each series, oldest first. Ranked rows above `most` are dropped before they are gathered."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    newest = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(value).alias("v")))), lambda x: x["v"])
    return newest.groupBy(*keys).agg(F.count("*").alias("n"), ordered.alias("series"))


def anomaly_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(keys, value, score): series whose newest value is an anomaly against the up to 199 before it; at least two points.

    The statistics are plain aggregates of ranked rows, so no arrays are built.
    """
    w, v = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]), F.col(value)
    ranked = df.select(*keys, v.alias(value), F.row_number().over(w).alias("_r")).filter(F.col("_r") <= MEMORY)
    before = ranked.filter("_r > 1")
    stats = before.groupBy(*keys).agg(F.count(v).alias("_n"), F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sd"), F.percentile(v, 0.5).alias("_med"))
    mads = before.join(stats.select(*keys, "_med"), list(keys)).groupBy(*keys).agg(F.percentile(F.abs(v - F.col("_med")), 0.5).alias("_mad"))
    rows = ranked.filter("_r = 1").join(stats, list(keys)).join(mads, list(keys))
    return judged(rows, value).filter("anomaly").select(*keys, value, "score")


def seasonal_key(base: Column, ts: Column) -> Column:
    """`base|d-HH`: weekday (0 is Sunday) and hour."""
    return F.concat(base, F.lit("|"), (F.dayofweek(ts) - 1).cast("string"), F.lit("-"), F.lpad(F.hour(ts).cast("string"), 2, "0"))


def anomaly_seasonal(df: DataFrame, base: str, ts: str, order: Sequence[str], value: str) -> DataFrame:
    """anomaly_mad with a series of its own for every weekday and hour."""
    return anomaly_mad(df.withColumn("season", seasonal_key(F.col(base), F.col(ts))), ["season"], order, value)
