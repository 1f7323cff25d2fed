"""The event log: its envelope, and the tables derived from it. All of it runs on batches; streaming twins are in streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENVELOPE = "v int, ts timestamp, event string, sync_id string, pipeline_id string, stream string, payload string"
FINISHED = "rows_read long, rows_written long, bytes_written long, duration_seconds double"
CHECKSUM = "side string, rows long, checksum string"
MAPPING = "source_column string, source_type string, dest_column string, dest_type string"
STATS = "columns array<struct<column:string,rows:long,nulls:long,distinct:long,min:string,max:string>>"


def parse_events(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of JSON lines. Lines that are no object or have no kind are rejects; blank lines are nothing.

    pipeline_id may be a number or a text; the payload stays JSON text.
    """
    line = lines.filter(F.trim(value) != "")
    parsed = line.withColumn("e", F.from_json(value, ENVELOPE, {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.col("e.event").isNotNull() & F.try_parse_json(value).isNotNull(), F.lit(False))
    return parsed.filter(good).select(*[c for c in lines.columns if c != value], "e.*"), parsed.filter(~good).select(*lines.columns)


def derive_metrics(events: DataFrame) -> DataFrame:
    rows = events.filter("event = 'sync_finished'").withColumn("p", F.from_json("payload", FINISHED))
    return rows.select(F.col("pipeline_id").cast("long").alias("pipeline_id"), "sync_id", "ts", "p.*")


def last_syncs(events: DataFrame, seq: str = "seq") -> DataFrame:
    """(pipeline_id, last_sync_at): of the last finished sync that came in."""
    return events.filter("event = 'sync_finished'").groupBy(F.col("pipeline_id").cast("long").alias("pipeline_id")).agg(F.max_by("ts", seq).alias("last_sync_at"))


def derive_diff_runs(events: DataFrame, seq: str = "seq") -> DataFrame:
    """A row for each pair of source and destination checksums of (pipeline, sync, stream), in the order they came.

    A side that comes again before the other overwrites; a pair is cleared once it is out, so a key may pair repeatedly.

    In runs of rows of one side: the first row of a run pairs with the last row before it if that was still held. After a run of
    several rows one is held; a run of a single row holds it just if nothing was held before. So whether one is held follows from
    the number of runs since the last run of several.
    """
    keys = ["pipeline_id", "sync_id", "stream"]
    rows = events.filter("event = 'checksum_computed'").withColumn("p", F.from_json("payload", CHECKSUM))
    rows = rows.select(*keys, F.col(seq).alias("seq"), F.coalesce(F.col("p.side") == "source", F.lit(False)).alias("is_source"), F.struct("p.rows", "p.checksum").alias("own"))
    w = Window.partitionBy(*keys).orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("starts", F.coalesce(F.col("is_source") != F.lag("is_source").over(w), F.lit(True))).withColumn("other", F.lag("own").over(w))
    rows = rows.withColumn("run", F.sum(F.col("starts").cast("long")).over(so_far))
    rows = rows.withColumn("several", F.coalesce(F.max(F.when(~F.col("starts"), F.col("run"))).over(so_far), F.lit(0)))
    since = F.col("run") - F.col("several") - 1
    held = F.when(F.col("several") > 0, since % 2 == 0).otherwise(since % 2 == 1)
    pairs = rows.filter(F.col("starts") & held)
    side = lambda of, field: F.when(F.col("is_source") == (of == "source"), F.col(f"own.{field}")).otherwise(F.col(f"other.{field}")).alias(f"{of}_{field}")
    out = pairs.select(F.col("pipeline_id").cast("long").alias("pipeline_id"), "sync_id", "stream", "seq", side("source", "rows"), side("dest", "rows"), side("source", "checksum"), side("dest", "checksum"))
    return out.withColumn("match", F.col("source_rows").eqNullSafe(F.col("dest_rows")) & F.col("source_checksum").eqNullSafe(F.col("dest_checksum")))


def derive_lineage(events: DataFrame, seq: str = "seq") -> DataFrame:
    """The last mapping of each (pipeline, stream, source column, destination column); the destination table is the stream."""
    rows = events.filter("event = 'column_mapping'").withColumn("p", F.from_json("payload", MAPPING))
    keys = [F.col("pipeline_id").cast("long").alias("pipeline_id"), F.col("stream").alias("source_stream"), "p.source_column", "p.dest_column"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("p.source_type", "p.dest_type", "sync_id"), seq).alias("l"))
    return last.select("pipeline_id", "source_stream", "source_column", F.col("l.source_type").alias("source_type"), F.col("source_stream").alias("dest_table"), "dest_column", F.col("l.dest_type").alias("dest_type"), F.col("l.sync_id").alias("sync_id"))


def derive_column_stats(events: DataFrame) -> DataFrame:
    rows = events.filter("event = 'column_stats'").select(F.col("pipeline_id").cast("long").alias("pipeline_id"), "stream", "sync_id", "ts", F.explode(F.from_json("payload", STATS)["columns"]).alias("c"))
    return rows.select("pipeline_id", "stream", F.col("c.column").alias("column_name"), "sync_id", "ts", F.col("c.rows").alias("row_count"), F.col("c.nulls").alias("null_count"), F.col("c.distinct").alias("distinct_estimate"), F.col("c.min").alias("min_value"), F.col("c.max").alias("max_value"))


def event_windows(events: DataFrame, ts: str, kind: str, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, kind, n) in tumbling or sliding windows; a watermark on the input makes it a streaming operator."""
    w = F.window(F.col(ts).cast("timestamp"), width, slide) if slide else F.window(F.col(ts).cast("timestamp"), width)
    return events.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def event_sessions(events: DataFrame, ts: str, key: str, gap: str = "5 minutes") -> DataFrame:
    """(key, session_start, session_end, n): events of a key with no longer gap between them."""
    s = F.session_window(F.col(ts).cast("timestamp"), gap)
    return events.groupBy(key, s.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def audit_field_diff(df: DataFrame, keys: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """(keys, field, from_value, to_value): top-level fields whose JSON values differ, whatever the order of inner keys."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = df.select(*keys, as_map(before).alias("b"), as_map(after).alias("a"))
    field = F.explode(F.array_distinct(F.concat(F.map_keys("b"), F.map_keys("a"))))
    each = rows.select(*keys, "b", "a", field.alias("field")).select(*keys, "field", F.try_element_at("b", F.col("field")).alias("from_value"), F.try_element_at("a", F.col("field")).alias("to_value"), F.map_contains_key("b", F.col("field")).alias("in_b"), F.map_contains_key("a", F.col("field")).alias("in_a"))
    same_json = lambda c: F.coalesce(F.to_json(F.try_parse_json(c)), F.col(c))
    unlike = ~same_json("from_value").eqNullSafe(same_json("to_value")) | (F.col("in_b") != F.col("in_a"))
    return each.filter(unlike).drop("in_b", "in_a")


def config_versions(df: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """Only the rows whose content differs from the one before, numbered from 1: a history of changes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = df.withColumn("_before", F.lag(F.struct(content)).over(w)).filter(F.col("_before").isNull() | ~F.col(f"_before.{content}").eqNullSafe(F.col(content)))
    return changed.drop("_before").withColumn("version", F.row_number().over(w).cast("long"))


def rollback(history: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """A new last version for each (keys, target) that repeats the target's content; unknown targets give none."""
    last = history.groupBy(*keys).agg(F.max("version").alias("_last"))
    old = history.join(targets, [*keys]).filter(F.col("version") == F.col("target")).drop("target")
    return old.join(last, list(keys)).withColumn("version", F.col("_last") + 1).select(*history.columns)
