"""Streaming operators with typed state, timers and an end to state (transformWithStateInPandas).

They need the RocksDB state store: `spark.sql.streaming.stateStore.providerClass` of the session that starts the query must name it
(ROCKSDB below). Silence is told by event-time timers: when the watermark has passed a key's deadline, the key speaks and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from syncproof.operators.events import CHECKSUM

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(t) -> int:
    return int(pd.Timestamp(t).value // 1000)


class Silence(StatefulProcessor):
    """One row for each stretch of a key that is followed by `after` seconds without an event; nothing is kept of a key that has spoken."""

    def __init__(self, after: int):
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = sorted(micros(t) for part in rows for t in part["ts"])
        at, n = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for t in times:
            if at is not None and t - at > self.after * 1_000_000:  # silence that ended before the watermark told of it
                out.append((key[0], at, n))
                n = 0
            at, n = max(t, at or t), n + 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000 + self.after * 1000)
        self.last.update((at, n))
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.last.exists():
            at, n = self.last.get()
            out.append((key[0], at, n))
            self.last.clear()
        yield frame(out)

    def close(self) -> None:
        pass


def frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "last_at", "n"]).astype({"key": "str", "last_at": "int64", "n": "int64"})


def silences(events: DataFrame, key: str, ts: str, after: int, late: str = "0 seconds") -> DataFrame:
    """(key, last_at in microseconds, n): events of each key up to a silence of over `after` seconds, told when the watermark passes it.

    The freshness monitor as a stream: a key that goes quiet raises a row by itself. Rows of null key or time are left out.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Silence(after), "key string, last_at long, n long", "append", "eventTime")


class Pairs(StatefulProcessor):
    """The side of a pair that is held until the other comes; a pair clears both, and a held side ends with its time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "is_source boolean, rows long, checksum string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.held.get() if self.held.exists() else None
        out = []
        number = lambda x: None if pd.isna(x) else int(x)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            own = (bool(r.is_source), number(r.rows), r.checksum)
            if held is None or held[0] == own[0]:
                held = own
                continue
            source, dest = (own, held) if own[0] else (held, own)
            out.append((*key, r.seq, source[1], dest[1], source[2], dest[2]))
            held = None
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        names = ["pipeline_id", "sync_id", "stream", "seq", "source_rows", "dest_rows", "source_checksum", "dest_checksum"]
        yield pd.DataFrame(out, columns=names).astype({"source_rows": "Int64", "dest_rows": "Int64", "seq": "int64"})

    def close(self) -> None:
        pass


def pairs_that_clear(events: DataFrame, seq: str = "seq", ttl_seconds: int = 86_400) -> DataFrame:
    """events.derive_diff_runs() as a stream: a side that comes again before the other overwrites, a pair is given once and cleared.

    State is one side for each (pipeline, sync, stream) that waits, for ttl_seconds at most. Rows of a batch go in the order of seq.
    """
    keys = ["pipeline_id", "sync_id", "stream"]
    rows = events.filter("event = 'checksum_computed'").withColumn("p", F.from_json("payload", CHECKSUM))
    slim = rows.select(F.col("pipeline_id").cast("long").alias("pipeline_id"), "sync_id", "stream", F.col(seq).cast("long").alias("seq"), F.coalesce(F.col("p.side") == "source", F.lit(False)).alias("is_source"), "p.rows", "p.checksum")
    schema = "pipeline_id long, sync_id string, stream string, seq long, source_rows long, dest_rows long, source_checksum string, dest_checksum string"
    met = slim.groupBy(*keys).transformWithStateInPandas(Pairs(ttl_seconds * 1000), schema, "append", "processingTime")
    return met.withColumn("match", F.col("source_rows").eqNullSafe(F.col("dest_rows")) & F.col("source_checksum").eqNullSafe(F.col("dest_checksum")))
