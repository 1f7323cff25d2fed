"""Reports over the control tables: health, badges, cost, overviews and newest-first lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncproof.functions.joins import bounded

COST_PER_GB, COST_PER_HOUR = 0.023, 0.10


def cents(x: Column) -> Column:
    """Truncated to two places (of amounts that are not negative)."""
    return F.floor(x * 100) / 100


def cost_analytics(pipelines: DataFrame, metrics: DataFrame, per_gb: float = COST_PER_GB, per_hour: float = COST_PER_HOUR) -> DataFrame:
    """(name, n_rows, bytes, seconds, est_cost_usd) by pipeline name, zeros where nothing ran."""
    zero = lambda c, out: F.coalesce(F.sum(c), F.lit(0)).alias(out)
    totals = pipelines.join(metrics, "pipeline_id", "left").groupBy("name").agg(zero("rows_written", "n_rows"), zero("bytes_written", "bytes"), zero("duration_seconds", "seconds"))
    return totals.withColumn("est_cost_usd", cents(F.col("bytes") / (1 << 30) * per_gb + F.col("seconds") / 3600 * per_hour))


def cost_total(costs: DataFrame) -> DataFrame:
    return costs.agg(cents(F.sum("est_cost_usd")).alias("total_est_cost_usd"))


def monthly_rollup(pipelines: DataFrame, metrics: DataFrame) -> DataFrame:
    """(month, name, n_rows, seconds), with totals by month (NULL name) and over all (NULL month)."""
    joined = metrics.join(bounded(pipelines), "pipeline_id").withColumn("month", F.date_format(F.date_trunc("month", F.col("ts")), "yyyy-MM"))
    return joined.rollup("month", "name").agg(F.sum("rows_written").alias("n_rows"), F.sum("duration_seconds").alias("seconds"))


def diff_badge(diff_runs: DataFrame, order: tuple[str, ...] = ("created_at", "seq")) -> DataFrame:
    """(pipeline_id, diff_verified, verified_rows) over the diffs of each pipeline's latest sync."""
    latest = diff_runs.groupBy("pipeline_id").agg(F.max_by("sync_id", F.struct(*order)).alias("sync_id"))
    return diff_runs.join(latest, ["pipeline_id", "sync_id"]).groupBy("pipeline_id").agg(F.bool_and("match").alias("diff_verified"), F.coalesce(F.sum(F.when(F.col("match"), F.col("dest_rows"))), F.lit(0)).alias("verified_rows"))


def health_score(pipelines: DataFrame, events: DataFrame, diff_runs: DataFrame, incidents: DataFrame, now: Column) -> DataFrame:
    """(pipeline_id, health_score, diff_verified, verified_rows, open_incidents, recent_failure).

    100, less 40 for any failed sync in the day before now, 25 unless the latest sync's diffs all matched, and 10 for each
    unresolved incident up to 30; never below 0.
    """
    failures = events.filter((F.col("ts") > now - F.expr("interval 1 day")) & (F.col("ts") <= now)).groupBy("pipeline_id").agg(F.bool_or(F.col("event") == "sync_failed").alias("recent_failure"))
    opened = incidents.filter(F.col("status").isin("open", "acked", "snoozed")).groupBy("pipeline_id").agg(F.count("*").alias("open_incidents"))
    met = pipelines.select("pipeline_id")
    for side in (failures, diff_badge(diff_runs), opened):
        met = met.join(side, "pipeline_id", "left")
    met = met.select("pipeline_id", F.coalesce("recent_failure", F.lit(False)).alias("recent_failure"), F.coalesce("diff_verified", F.lit(True)).alias("diff_verified"), F.coalesce("verified_rows", F.lit(0)).alias("verified_rows"), F.coalesce("open_incidents", F.lit(0)).alias("open_incidents"))
    score = 100 - F.when(F.col("recent_failure"), 40).otherwise(0) - F.when(~F.col("diff_verified"), 25).otherwise(0) - F.least(F.col("open_incidents") * 10, F.lit(30))
    return met.withColumn("health_score", F.greatest(score, F.lit(0)).cast("long"))


def fleet_overview(health: DataFrame, diff_runs: DataFrame) -> DataFrame:
    """One row: average health (rounded), verified pipelines and rows, open incidents, mismatched diffs."""
    fleet = health.agg(F.round(F.avg("health_score")).cast("long").alias("avg_health"), F.count_if("diff_verified").alias("verified"), F.sum("open_incidents").alias("open_incidents"), F.sum("verified_rows").alias("verified_rows"))
    return fleet.join(diff_runs.agg(F.count_if(~F.col("match")).alias("mismatches")))


def pipeline_overview(metrics: DataFrame) -> DataFrame:
    """(pipeline_id, n_runs, rows_per_run, total_bytes, avg_seconds)."""
    return metrics.groupBy("pipeline_id").agg(F.count("*").alias("n_runs"), (F.sum("rows_written") / F.count("*")).alias("rows_per_run"), F.sum("bytes_written").alias("total_bytes"), F.avg("duration_seconds").alias("avg_seconds"))


def newest(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The k newest rows (200 diffs, 200 incidents, 500 audit rows, 100 backfills by default in their lists): a top-k, not a sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(k)


def with_pipeline_name(df: DataFrame, pipelines: DataFrame) -> DataFrame:
    """df with pipeline_name, empty for global rows; pipelines is a dimension of bounded size."""
    return df.join(pipelines.select("pipeline_id", F.col("name").alias("pipeline_name")), "pipeline_id", "left").withColumn("pipeline_name", F.coalesce("pipeline_name", F.lit("")))


def metrics_series(metrics: DataFrame, pipeline_id: int, since: Column | None = None) -> DataFrame:
    """One pipeline's points by time."""
    rows = metrics.filter(F.col("pipeline_id") == pipeline_id)
    return (rows if since is None else rows.filter(F.col("ts") >= since)).orderBy("ts", "sync_id")


def lineage_edges(lineage: DataFrame, pipeline_id: int) -> DataFrame:
    return lineage.filter(F.col("pipeline_id") == pipeline_id).orderBy("source_stream", "source_column", "dest_column")
