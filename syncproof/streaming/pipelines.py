"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from syncproof.operators.anomaly import COLD, LIMIT, MAD_FACTOR, MEMORY, windows
from syncproof.operators.events import CHECKSUM, parse_events
from syncproof.operators.log import inject_metadata


def ingest_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """A stream of JSON lines as a stream of events; lines that are none are left out."""
    return parse_events(lines, value)[0]


def apply_changes(changes: DataFrame, path: str, keys: Sequence[str], checkpoint: str, kind: str = "kind"):
    """Appends a change stream to a log table, each batch under its number: a batch that runs again overwrites its own folder only.

    The checkpoint is the position; it moves after the batch is written. Starts with all that is there and ends (availableNow).
    """
    code = F.when(F.col(kind) == "insert", "i").when(F.col(kind) == "update", "u").when(F.col(kind) == "delete", "d").otherwise("i")

    def write(batch: DataFrame, number: int) -> None:
        inject_metadata(batch, keys, code, F.current_timestamp()).drop(kind).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(rows: DataFrame, ts: str, late: str, key: str = "_sys_id") -> DataFrame:
    """At-least-once delivery to effectively once: repeated ids within the watermark are dropped."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def pair_checksums(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(pipeline_id, sync_id, stream, rows and checksums of both sides, match) by a join of the two sides' streams within the watermark."""
    rows = events.filter("event = 'checksum_computed'").withColumn("p", F.from_json("payload", CHECKSUM)).select("ts", "pipeline_id", "sync_id", "stream", "p.*")
    s = rows.filter("side = 'source'").withWatermark("ts", late).select("pipeline_id", "sync_id", "stream", F.col("ts").alias("source_ts"), F.col("rows").alias("source_rows"), F.col("checksum").alias("source_checksum"))
    d = rows.filter("side <> 'source'").withWatermark("ts", late).select(F.col("pipeline_id").alias("_p"), F.col("sync_id").alias("_s"), F.col("stream").alias("_t"), F.col("ts").alias("dest_ts"), F.col("rows").alias("dest_rows"), F.col("checksum").alias("dest_checksum"))
    near = F.expr(f"dest_ts >= source_ts - interval {late} AND dest_ts <= source_ts + interval {late}")
    met = s.join(d, (F.col("pipeline_id") == F.col("_p")) & (F.col("sync_id") == F.col("_s")) & (F.col("stream") == F.col("_t")) & near)
    return met.drop("_p", "_s", "_t").withColumn("match", (F.col("source_rows") == F.col("dest_rows")) & (F.col("source_checksum") == F.col("dest_checksum")))


def windowed_counts(events: DataFrame, ts: Column, kind: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(window_start, kind, n) of closed windows; rows later than the watermark are dropped."""
    rows = events.withColumn("_ts", ts.cast("timestamp")).withWatermark("_ts", late)
    w = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    return rows.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def score_then_learn(values: Sequence[float], state: tuple) -> tuple[list[tuple[str, float, bool]], tuple]:
    """Each value against (count, mean, m2, the last 200), which then take it in: mean and deviation are those of the whole life.

    A missing value (NaN) has a place among the last 200, but counts for nothing, and its score is 0.
    """
    status, score, anomaly, state = scored(np.asarray(values, float), state)
    return list(zip(status.tolist(), score.tolist(), anomaly.tolist(), strict=True)), state


def scored(v: np.ndarray, state: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """score_then_learn() as arrays: medians and MADs of all places at once, by windows that go on from the state's values."""
    count, mean, m2, ring = state
    before = np.concatenate([np.asarray(ring, float), v])
    _, _, _, med, mad = windows(before, len(ring), MEMORY, None)
    n, mu, sd = np.empty(len(v), np.int64), np.empty(len(v)), np.empty(len(v))
    for i, x in enumerate(v.tolist()):
        n[i], mu[i], sd[i] = count, mean, (m2 / (count - 1)) ** 0.5 if count > 1 else 0.0
        if x == x:
            count += 1
            delta = x - mean
            mean += delta / count
            m2 += delta * (x - mean)
    with np.errstate(all="ignore"):
        robust, plain = np.abs(MAD_FACTOR * (v - med) / mad), np.abs(v - mu) / sd
    score = np.nan_to_num(np.where(mad > 0, robust, np.where(sd > 0, plain, 0.0)), posinf=np.inf)
    warm = n >= COLD
    anomaly = warm & ~np.isnan(v) & np.where((mad > 0) | (sd > 0), score > LIMIT, v != mu)
    return np.where(warm, "scored", "cold_start"), np.where(warm, score, 0.0), anomaly, (count, mean, m2, before[-MEMORY:].tolist())


def anomaly_stream(points: DataFrame, key: str = "pipeline_id", order: str = "seq", value: str = "value") -> DataFrame:
    """(key, seq, value, status, score, anomaly) with 200 values and three numbers of state for each series."""
    slim = points.select(F.col(key).cast("string").alias("key"), F.col(order).alias("seq"), F.col(value).cast("double").alias("value"))

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (0, 0.0, 0.0, [])
        part = pd.concat(list(parts)).sort_values("seq")
        status, score, anomaly, kept = scored(part["value"].to_numpy(float), kept)
        state.update(kept)
        yield pd.DataFrame({"key": keys[0], "seq": part["seq"].to_numpy(), "value": part["value"].to_numpy(), "status": status, "score": score, "anomaly": anomaly})

    return slim.groupBy("key").applyInPandasWithState(run, "key string, seq long, value double, status string, score double, anomaly boolean", "count long, mean double, m2 double, ring array<double>", "append", GroupStateTimeout.NoTimeout)


def incidents_stream(matches: DataFrame) -> DataFrame:
    """(fingerprint, seq, opened, event_count): matches and resolves (column resolve) folded per fingerprint in the order of seq.

    The first match opens an incident, later ones raise its count; after a resolve the next match opens a new one.
    """
    slim = matches.select("fingerprint", "seq", F.coalesce("resolve", F.lit(False)).alias("resolve"))

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
            if r.resolve:
                count = 0
            else:
                count += 1
                out.append((keys[0], r.seq, count == 1, count))
        state.update((count,))
        yield pd.DataFrame(out, columns=["fingerprint", "seq", "opened", "event_count"])

    return slim.groupBy("fingerprint").applyInPandasWithState(run, "fingerprint string, seq long, opened boolean, event_count long", "count long", "append", GroupStateTimeout.NoTimeout)
