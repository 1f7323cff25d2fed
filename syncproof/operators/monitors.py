"""Quality monitors: freshness, volume, null rate and distribution drift, evaluated as one join of monitors and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PSI_FLOOR = 1e-6
RESULT = ("value", "breached")


def freshness(now: Column, last_sync: Column, threshold_seconds: Column) -> tuple[Column, Column]:
    """(value: seconds since the last sync, breached); NULL if there never was one."""
    value = F.unix_timestamp(now).cast("double") - F.unix_timestamp(last_sync)
    return value, value > threshold_seconds


def volume(current: Column, mean: Column, max_deviation: Column) -> tuple[Column, Column]:
    """(value: relative deviation from the mean, breached); a mean of 0 or less never breaches, its value is the current one."""
    deviation = F.abs(current - mean) / F.when(mean > 0, mean)
    return F.when(mean > 0, deviation).otherwise(current.cast("double")), F.coalesce(deviation > max_deviation, F.lit(False))


def null_rate(nulls: Column, rows: Column, baseline: Column, max_increase: Column) -> tuple[Column, Column]:
    """(value: share of NULLs, breached); NULL without rows. A drop never breaches."""
    value = nulls / F.when(rows > 0, rows)
    return value, (value - baseline) > max_increase


def psi(hist: DataFrame, base: str = "n_base", current: str = "n_cur", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, psi): population stability index of aligned bucket counts; 0 where either side is empty."""
    totals = hist.groupBy(*keys).agg(F.sum(base).alias("_b"), F.sum(current).alias("_c"))
    met = hist.join(totals, list(keys)) if keys else hist.join(F.broadcast(totals))
    b, c = F.coalesce(F.col(base), F.lit(0)) / F.when(F.col("_b") > 0, F.col("_b")) + PSI_FLOOR, F.coalesce(F.col(current), F.lit(0)) / F.when(F.col("_c") > 0, F.col("_c")) + PSI_FLOOR
    return met.groupBy(*keys).agg(F.coalesce(F.sum((c - b) * F.ln(c / b)), F.lit(0.0)).alias("psi"))


def aligned(base: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """Two histograms (keys, n) as (keys, n_base, n_cur)."""
    met = base.withColumnRenamed("n", "n_base").join(current.withColumnRenamed("n", "n_cur"), list(keys), "full_outer")
    return met.select(*keys, F.coalesce("n_base", F.lit(0)).alias("n_base"), F.coalesce("n_cur", F.lit(0)).alias("n_cur"))


def latest_stat(stats: DataFrame, order: tuple[str, ...] = ("ts", "sync_id")) -> DataFrame:
    """The newest row of (pipeline_id, stream, column_name), and of (pipeline_id, stream) under an empty column name."""
    row = F.struct("sync_id", "ts", "row_count", "null_count")
    both = stats.withColumn("column_name", F.explode(F.array("column_name", F.lit(""))))
    return both.groupBy("pipeline_id", "stream", "column_name").agg(F.max_by(row, F.struct(*order)).alias("s")).select("pipeline_id", "stream", "column_name", "s.*")


def monitor_run(monitors: DataFrame, stats: DataFrame, syncs: DataFrame, now: Column, drifts: DataFrame | None = None, custom: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """(monitor_id, pipeline_id, sync_id, kind, value, breached): a row for each enabled monitor that can be evaluated.

    monitors: (id, pipeline_id, stream, column_name, kind, enabled, threshold_seconds, max_deviation, max_increase, mean,
    null_rate, max_psi); stats: latest_stat(); syncs: (pipeline_id, last_sync_at); drifts: (pipeline_id, stream, column_name, psi).
    custom: further kinds, each with its (value, breached) over the columns above; one of a known kind's name replaces it.
    """
    met = monitors.filter("enabled").join(stats, ["pipeline_id", "stream", "column_name"], "left").join(syncs, "pipeline_id", "left")
    met = met.withColumn("psi", F.lit(None).cast("double")) if drifts is None else met.join(drifts, ["pipeline_id", "stream", "column_name"], "left")
    by_kind = {
        "freshness": freshness(now, F.col("last_sync_at"), F.col("threshold_seconds")),
        "volume": volume(F.col("row_count"), F.col("mean"), F.col("max_deviation")),
        "null_rate": null_rate(F.col("null_count"), F.col("row_count"), F.col("null_rate"), F.col("max_increase")),
        "distribution": (F.col("psi"), F.col("psi") > F.col("max_psi")),
    } | (custom or {})
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == k, v[i]) for k, v in by_kind.items()])
    measured = F.coalesce(*[F.when(F.col("kind") == k, v[0].isNotNull()) for k, v in by_kind.items()], F.lit(False))
    sync = F.when(~F.col("kind").isin("freshness", "distribution"), F.col("sync_id"))
    return met.filter(measured).select(F.col("id").alias("monitor_id"), "pipeline_id", F.coalesce(sync, F.lit("")).alias("sync_id"), "kind", pick(0).cast("double").alias("value"), F.coalesce(pick(1), F.lit(False)).alias("breached"))


def breaches_as_events(results: DataFrame, now: Column) -> DataFrame:
    """quality_breach rows in the event envelope, to be added to the event log."""
    payload = F.to_json(F.struct("monitor_id", "kind", "value"))
    return results.filter("breached").select(now.alias("ts"), F.lit("quality_breach").alias("event"), "sync_id", "pipeline_id", F.lit("").alias("stream"), payload.alias("payload"))
