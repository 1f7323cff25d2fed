import json
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from syncproof.operators import anomaly, log
from syncproof.streaming import pipelines

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="syncproof-test-")


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.sql(f"select * from {name}")


def source(spark, df, folder, files=2):
    df.repartition(files).write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_ingest(spark, folder):
    lines = [json.dumps({"v": 1, "ts": "2024-01-01T00:00:00Z", "event": "sync_started", "sync_id": f"s{i}", "pipeline_id": i, "stream": "", "payload": {}}) for i in range(5)] + ["torn {"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{folder}/in")
    assert run(pipelines.ingest_events(spark.readStream.text(f"{folder}/in")), "ingested").count() == 5


def test_changes_are_applied_once(spark, folder):
    changes = spark.createDataFrame([(1, "a", "insert"), (2, "b", "insert"), (1, "c", "update"), (2, None, "delete")], "id long, v string, kind string")
    stream = source(spark, changes.coalesce(1), folder, 1)
    for _ in range(2):  # the second run finds nothing new
        q = pipelines.apply_changes(stream, f"{folder}/log", ["id"], f"{folder}/ckpt")
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(f"{folder}/log")
    assert sorted(r._sys_op for r in got.collect()) == ["d", "i", "i", "u"]


def test_stream_dedup(spark, folder):
    rows = spark.createDataFrame([("a", T0), ("a", T0), ("b", T0 + timedelta(seconds=1))], "_sys_id string, ts timestamp")
    assert run(pipelines.stream_dedup(source(spark, rows, folder), "ts", "1 hour"), "deduped").count() == 2


def test_pairs(spark, folder):
    rows = [(T0, "checksum_computed", "s1", "7", "a", '{"side":"source","rows":3,"checksum":"x"}'), (T0, "checksum_computed", "s1", "7", "a", '{"side":"destination","rows":2,"checksum":"x"}'), (T0, "sync_failed", "s1", "7", "a", "{}")]
    df = spark.createDataFrame(rows, "ts timestamp, event string, sync_id string, pipeline_id string, stream string, payload string")
    got = run(pipelines.pair_checksums(source(spark, df, folder)), "pairs").collect()
    assert [(r.source_rows, r.dest_rows, r.match) for r in got] == [(3, 2, False)]


def test_anomaly_stream_is_its_batch_twin(spark, folder):
    rows = [("p" if i % 2 else "q", i, float((i * 37) % 11) + (500 if i == 60 else 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "pipeline_id string, seq long, value double")
    df.filter("seq < 40").coalesce(1).write.parquet(f"{folder}/in")
    df.filter("seq >= 40").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    import os
    import time

    parts = sorted((f for f in os.listdir(f"{folder}/in") if f.endswith(".parquet")), key=lambda f: spark.read.parquet(f"{folder}/in/{f}").agg(F.min("seq")).first()[0])
    for i, f in enumerate(parts):  # the stream reads by age
        os.utime(f"{folder}/in/{f}", (time.time() - 100 + i, time.time() - 100 + i))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = {r.seq: (r.status, round(r.score, 6), r.anomaly) for r in run(pipelines.anomaly_stream(stream), "scores").collect()}
    want = {r.seq: (r.status, round(r.score, 6), r.anomaly) for r in anomaly.anomaly_lifetime(df, ["pipeline_id"], ["seq"], "value").collect()}
    assert got == want and got[60][2]


def test_batches_come_in_order_and_missing_values_do_not_count(spark, monkeypatch):
    from syncproof.plans import streams

    made = []
    monkeypatch.setattr(streams, "new_path", lambda spark: made.append(tempfile.mkdtemp(prefix="syncproof-test-") + "/x") or made[-1])
    rows = [("p" if i % 2 else "q", i * 7919 % 5000, None if i % 50 == 3 else float(i * 37 % 11) + (500 if i == 60 else 0)) for i in range(5000)]
    df = spark.createDataFrame(rows, "pipeline_id string, seq long, value double").repartition(3)
    stream = streams.in_order(df, "seq", 900)
    seen = spark.read.parquet(made[0]).groupBy(F.input_file_name().alias("f")).agg(F.min("seq").alias("a"), F.max("seq").alias("z")).orderBy("f").collect()
    assert len(seen) == 6 and all(x.z < y.a for x, y in zip(seen, seen[1:], strict=False))
    got = {r.seq: (r.status, round(r.score, 6), r.anomaly) for r in run(pipelines.anomaly_stream(stream), "ordered_scores").collect()}
    assert got == {r.seq: (r.status, round(r.score, 6), r.anomaly) for r in anomaly.anomaly_lifetime(df, ["pipeline_id"], ["seq"], "value").collect()}


def test_incident_stream(spark, folder):
    rows = [("f", 1, False), ("f", 2, False), ("f", 3, True), ("f", 4, False), ("g", 5, False)]
    df = spark.createDataFrame(rows, "fingerprint string, seq long, resolve boolean")
    got = {r.seq: (r.opened, r.event_count) for r in run(pipelines.incidents_stream(source(spark, df.coalesce(1), folder, 1)), "incidents").collect()}
    assert got == {1: (True, 1), 2: (False, 2), 4: (True, 1), 5: (True, 1)}


def test_windows(spark, folder):
    rows = spark.createDataFrame([(T0 + timedelta(minutes=m), "a") for m in (1, 2, 70, 300)], "ts timestamp_ntz, kind string")
    got = run(pipelines.windowed_counts(source(spark, rows.coalesce(1), folder, 1), F.col("ts"), "kind", "1 hour", "10 minutes"), "windows").collect()
    assert sorted(r.n for r in got) == [1, 2]


def test_unavailable_values(spark):
    rows = spark.createDataFrame([(1, 1, "big"), (1, 2, "__same__"), (1, 3, None), (1, 4, "__same__")], "id long, seq long, v string")
    got = log.cdc_unavailable_patch(rows, ["v"], "__same__", ["id"], ["seq"]).orderBy("seq").collect()
    assert [r.v for r in got] == ["big", "big", None, None]


@pytest.fixture(scope="module")
def typed(spark):
    from syncproof.streaming import stateful

    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def in_batches(session, batches, schema, folder):
    import os
    import time

    for i, rows in enumerate(batches):
        session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for name in os.listdir(f"{folder}/in"):  # batches follow the files' times
            path = f"{folder}/in/{name}"
            if name.startswith("part") and os.path.getmtime(path) > 10**9:
                os.utime(path, (i + 1, i + 1))
    del time
    return session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_silence_is_told_and_leaves_no_state(typed, folder):
    from syncproof.streaming import stateful

    at = lambda *s: [T0 + timedelta(seconds=x) for x in s]
    batches = [[("a", x) for x in at(0, 5)] + [("b", x) for x in at(1)] + [(None, T0)], [("b", x) for x in at(500)], [("c", x) for x in at(2000)]]
    stream = stateful.silences(in_batches(typed, batches, "k string, ts timestamp", folder), "k", "ts", 60)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination(120)
    assert q.exception() is None
    us = lambda s: int(T0.timestamp() * 0 + 1704067200 * 10**6 + s * 10**6)
    got = sorted((r.key, r.last_at, r.n) for r in typed.read.parquet(f"{folder}/out").collect())
    assert got == [("a", us(5), 2), ("b", us(1), 1), ("b", us(500), 1)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # of c alone: its value, and its timer with the timer's index


def test_pairs_clear(typed, folder):
    from syncproof.operators import events
    from syncproof.streaming import stateful

    side = lambda i, s, n: (i, "checksum_computed", "s1", "7", "a", '{"side":"%s","rows":%d,"checksum":"x"}' % (s, n))
    batches = [[side(1, "source", 1), side(2, "source", 2)], [side(3, "destination", 2), side(4, "destination", 5)], [side(5, "source", 5), side(6, "source", 6), side(7, "destination", 7)]]
    schema = "seq long, event string, sync_id string, pipeline_id string, stream string, payload string"
    got = run(stateful.pairs_that_clear(in_batches(typed, batches, schema, folder)), "cleared").collect()
    twin = events.derive_diff_runs(typed.createDataFrame([r for b in batches for r in b], schema)).collect()
    rows = lambda x: sorted((r.seq, r.source_rows, r.dest_rows, r.match) for r in x)
    assert rows(got) == rows(twin) == [(3, 2, 2, True), (5, 5, 5, True), (7, 6, 7, False)]
