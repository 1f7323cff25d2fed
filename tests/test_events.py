import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from syncproof.operators import anomaly, events, monitors, profile, rules, schema, storms

T0 = datetime(2024, 1, 1)
LINES = [
    '{"v":1,"ts":"2024-01-01T00:00:00Z","event":"checksum_computed","sync_id":"s1","pipeline_id":"7","stream":"public.a","payload":{"side":"source","rows":3,"checksum":"ab"}}',
    "not json",
    "",
    '{"v":1,"ts":"2024-01-01T00:00:01Z","event":"checksum_computed","sync_id":"s1","pipeline_id":7,"stream":"public.a","payload":{"side":"destination","rows":3,"checksum":"ab"}}',
    '{"v":1,"ts":"2024-01-01T00:00:02Z","event":"column_mapping","sync_id":"s1","pipeline_id":"7","stream":"public.a","payload":{"source_column":"id","source_type":"int8","dest_column":"id","dest_type":"int64"}}',
    '{"v":1,"ts":"2024-01-01T00:00:03Z","event":"column_stats","sync_id":"s1","pipeline_id":"7","stream":"public.a","payload":{"columns":[{"column":"id","rows":3,"nulls":0,"distinct":3,"min":"1","max":"3"},{"column":"name","rows":3,"nulls":2,"distinct":1}]}}',
    '{"v":1,"ts":"2024-01-01T00:00:04Z","event":"sync_finished","sync_id":"s1","pipeline_id":"7","stream":"","payload":{"rows_read":3,"rows_written":3,"bytes_written":99,"duration_seconds":1.5}}',
]


def test_event_log(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "seq long, value string")
    got, bad = events.parse_events(lines)
    assert got.count() == 5 and [r.value for r in bad.collect()] == ["not json"]
    assert [(r.pipeline_id, r.match) for r in events.derive_diff_runs(got).collect()] == [(7, True)]
    assert [(r.rows_read, r.duration_seconds) for r in events.derive_metrics(got).collect()] == [(3, 1.5)]
    assert [(r.source_column, r.dest_type) for r in events.derive_lineage(got).collect()] == [("id", "int64")]
    assert sorted((r.column_name, r.null_count) for r in events.derive_column_stats(got).collect()) == [("id", 0), ("name", 2)]
    assert events.last_syncs(got).first().last_sync_at == datetime(2024, 1, 1, 0, 0, 4)


RULE = "id long, pipeline_id long, stream string, name string, enabled boolean, event string, field string, op string, value string, severity string, channel_ids array<long>"


def fire(spark, rule, payload, kind="k", pipeline=1, stream="s"):
    row = dict(id=1, pipeline_id=None, stream="", name="r", enabled=True, event="k", field="f", op="eq", value='"x"', severity="info", channel_ids=[1]) | rule
    rule_rows = spark.createDataFrame([tuple(row.values())], RULE)
    event = spark.createDataFrame([(0, T0, kind, pipeline, stream, payload)], "seq long, ts timestamp, event string, pipeline_id long, stream string, payload string")
    return rules.rule_match(event, rule_rows).count() == 1


@pytest.mark.parametrize(("rule", "payload", "want"), [
    ({}, '{"f":"x"}', True), ({}, '{"f":"y"}', False), ({}, "{}", False), ({"value": "5"}, '{"f":5}', True),
    ({"op": "ne"}, '{"f":"y"}', True), ({"op": "contains", "value": '"b"'}, '{"f":"abc"}', True),
    ({"op": "gt", "value": "3"}, '{"f":5}', True), ({"op": "gt", "value": "3"}, '{"f":"5"}', False), ({"op": "gt", "value": "5"}, '{"f":5}', False),
    ({"op": "gte", "value": "5"}, '{"f":5}', True), ({"op": "lt", "value": "5"}, '{"f":4.5}', True), ({"op": "lte", "value": "4"}, '{"f":5}', False),
    ({"op": "exists"}, '{"f":null}', True), ({"op": "exists"}, '{"g":1}', False),
    ({"op": "is_true"}, '{"f":true}', True), ({"op": "is_false"}, '{"f":false}', True), ({"op": "is_false"}, '{"f":"false"}', False), ({"op": "is_false"}, "{}", False),
    ({"field": ""}, "broken", True), ({"enabled": False}, '{"f":"x"}', False), ({"event": "other"}, '{"f":"x"}', False), ({"event": ""}, '{"f":"x"}', True),
    ({"pipeline_id": 2}, '{"f":"x"}', False), ({"pipeline_id": 1}, '{"f":"x"}', True), ({"stream": "t"}, '{"f":"x"}', False),
])
def test_rule_predicates(spark, rule, payload, want):
    assert fire(spark, rule, payload) is want


def test_storm_of_matches_is_one_incident(spark):
    m = spark.createDataFrame([(i, T0 + timedelta(seconds=i), "f", 1, 5, "s", "failed", "sync_failed", "critical", [1, 2]) for i in (1, 2, 3, 9)], "seq long, ts timestamp, fingerprint string, pipeline_id long, rule_id long, stream string, rule_name string, event string, severity string, channel_ids array<long>")
    got = sorted((r.island, r.event_count, r.title) for r in rules.incident_dedup(m, spark.createDataFrame([("f", 5)], "fingerprint string, seq long")).collect())
    assert got == [(0, 3, "failed: sync_failed on s"), (1, 1, "failed: sync_failed on s")]
    opened = rules.incident_dedup(m, spark.createDataFrame([], "fingerprint string, seq long"))
    assert rules.alert_fanout(opened).count() == 2 and rules.alert_fanout(opened, F.lit(True)).count() == 0


@pytest.mark.parametrize(("hour", "tz", "start", "end", "want"), [(23, "", "22:00", "06:00", True), (5, "", "22:00", "06:00", True), (6, "", "22:00", "06:00", False), (12, "", "09:00", "17:00", True), (12, "", "12:00", "12:00", False), (3, "America/New_York", "22:00", "23:00", True), (12, "", "x", "y", False)])
def test_quiet_hours(spark, hour, tz, start, end, want):
    ranges = F.array(F.struct(F.lit(start).alias("start"), F.lit(end).alias("end")))
    assert spark.range(1).select(rules.quiet(F.lit(datetime(2024, 1, 15, hour, 30 if hour != 6 else 0)).cast("timestamp"), F.lit(tz), ranges)).first()[0] is want


def test_transitions(spark):
    rows = [(1, 1, "ack"), (1, 2, "resolve"), (1, 3, "ack"), (2, 1, "snooze"), (2, 2, "ack"), (3, 1, "resolve"), (3, 2, "snooze")]
    got = {r.incident_id: (r.status, r.applied, r.rejected) for r in rules.incident_transitions(spark.createDataFrame(rows, "incident_id long, seq long, action string")).collect()}
    assert got == {1: ("resolved", 2, 1), 2: ("acked", 2, 0), 3: ("resolved", 1, 1)}


def test_enrichment(spark):
    rows = spark.createDataFrame([("wal_level", "m", False), ("odd", "boom", True), (None, None, None)], "code string, message string, retryable boolean")
    got = {r.code: (r.root_cause, r.severity) for r in rules.incident_enrich(rows).collect()}
    assert got["wal_level"][0].startswith("The source is not configured") and got["odd"] == ("The sync failed with: boom", "warning") and got[None] == (rules.NO_CAUSE, "critical")


def test_anomalies(spark):
    stable = [100.0, 102, 98, 101, 99, 100, 103, 97, 100, 101, 99, 100]
    rows = [("up", i, v) for i, v in enumerate([*map(float, stable), 100000.0])] + [("ok", i, v) for i, v in enumerate([*map(float, stable), 100.0])] + [("few", 0, 1.0), ("few", 1, 9.0), ("flat", 99, 6.0)] + [("flat", i, 5.0) for i in range(10)]
    df = spark.createDataFrame(rows, "p string, i long, v double")
    assert sorted(r.p for r in anomaly.anomaly_latest(df, ["p"], ["i"], "v").collect()) == ["flat", "up"]
    got = {(r.p, r.i): (r.status, r.anomaly) for r in anomaly.anomaly_mad(df, ["p"], ["i"], "v").collect()}
    assert got["up", 12] == ("scored", True) and got["ok", 12] == ("scored", False) and got["few", 1] == ("cold_start", False) and got["flat", 99] == ("scored", True)


def test_psi(spark):
    def of(cur):
        return monitors.psi(spark.createDataFrame(list(zip([100, 200, 300, 200, 100], cur, strict=True)), "n_base long, n_cur long")).first().psi

    assert of([100, 200, 300, 200, 100]) < 0.1 < 0.25 < of([300, 200, 100, 50, 10])
    assert of([0, 0, 0, 0, 0]) == 0


def test_null_rate_monitor(spark):
    m = spark.createDataFrame([(1, 7, "s", "c", "null_rate", True, None, None, 0.1, None, 0.02, None), (2, 7, "s", "c", "volume", True, None, 0.5, None, 0.0, None, None), (3, 8, "s", "c", "freshness", True, 60.0, None, None, None, None, None)], "id long, pipeline_id long, stream string, column_name string, kind string, enabled boolean, threshold_seconds double, max_deviation double, max_increase double, mean double, null_rate double, max_psi double")
    stats = spark.createDataFrame([(7, "s", "c", "s1", 1000, 600)], "pipeline_id long, stream string, column_name string, sync_id string, row_count long, null_count long")
    syncs = spark.createDataFrame([], "pipeline_id long, last_sync_at timestamp")
    got = {r.monitor_id: (r.value, r.breached) for r in monitors.monitor_run(m, stats, syncs, F.lit(T0)).collect()}
    assert got == {1: (0.6, True), 2: (1000.0, False)}
    assert monitors.breaches_as_events(monitors.monitor_run(m, stats, syncs, F.lit(T0)), F.lit(T0)).count() == 1


def test_custom_monitor(spark):
    rows = [(1, 7, "s", "c", "few_rows", True), (2, 7, "s", "d", "few_rows", True), (3, 7, "s", "c", "unknown", True)]
    none = [F.lit(None).cast("double").alias(c) for c in ("threshold_seconds", "max_deviation", "max_increase", "mean", "null_rate", "max_psi")]
    m = spark.createDataFrame(rows, "id long, pipeline_id long, stream string, column_name string, kind string, enabled boolean").select("*", *none)
    stats = spark.createDataFrame([(7, "s", "c", "s1", 12, 0)], "pipeline_id long, stream string, column_name string, sync_id string, row_count long, null_count long")
    syncs = spark.createDataFrame([], "pipeline_id long, last_sync_at timestamp")
    custom = {"few_rows": (F.col("row_count").cast("double"), F.col("row_count") < 50)}
    got = monitors.monitor_run(m, stats, syncs, F.lit(T0), custom=custom).collect()
    assert [(r.monitor_id, r.sync_id, r.value, r.breached) for r in got] == [(1, "s1", 12.0, True)]


def test_transitions_against_a_loop(spark):
    draw = random.Random(5)
    moves = {"ack": ({"open", "snoozed"}, "acked"), "snooze": ({"open", "acked"}, "snoozed"), "resolve": ({"open", "acked", "snoozed"}, "resolved")}
    rows = [(i, s, draw.choice(["ack", "ack", "snooze", "snooze", "note", "resolve"])) for i in range(60) for s in range(draw.randrange(1, 9))]
    want = {}
    for i, _, a in sorted(rows):
        status, applied, rejected = want.get(i, ("open", 0, 0))
        ok = a in moves and status in moves[a][0]
        want[i] = (moves[a][1] if ok else status, applied + ok, rejected + (not ok))
    got = rules.incident_transitions(spark.createDataFrame(rows, "incident_id long, seq long, action string").repartition(3))
    assert {r.incident_id: tuple(r)[1:] for r in got.collect()} == want


def test_diff_runs_against_a_loop(spark):
    draw, rows, want = random.Random(6), [], []
    for key in range(40):
        held = {}
        for seq in range(draw.randrange(1, 14)):
            side, n = draw.choice(["source", "dest"]), draw.randrange(3)
            rows.append((key * 100 + seq, "checksum_computed", str(key), "y", "s", f'{{"side":"{side}","rows":{n},"checksum":"c{n}"}}'))
            held[side] = n
            if len(held) == 2:
                want.append((key, key * 100 + seq, held["source"], held["dest"], held["source"] == held["dest"]))
                held = {}
    log = spark.createDataFrame(rows, "seq long, event string, pipeline_id string, sync_id string, stream string, payload string").repartition(3)
    got = events.derive_diff_runs(log).select("pipeline_id", "seq", "source_rows", "dest_rows", "match").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_column_stats(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (10, None), (3, "x")], "id long, name string")
    got = {r.column: tuple(r)[1:] for r in profile.column_stats(df).collect()}
    assert got == {"id": (4, 0, 4, "1", "3"), "name": (4, 2, 1, "x", "x")}


def test_storms(spark):
    rows = [("a", 0, "", "slot 5 stalled at page 3"), ("a", 10, "", "slot 9 stalled at page 5"), ("a", 400, "", "slot stalled at first page"), ("a", 2000, "", "slot 1 stalled at page 2"), ("b", 0, "E1", "x"), ("b", 5, "E1", "y"), ("b", 6, "E2", "x")]
    df = spark.createDataFrame([(c, i, T0 + timedelta(seconds=s), k, m) for i, (c, s, k, m) in enumerate(rows)], "connector string, seq long, ts timestamp, code string, message string")
    got = {r.seq: (r.cluster, r.is_new) for r in storms.storm_fuzzy(df).collect()}
    assert got == {0: (1, True), 1: (1, False), 2: (2, True), 3: (3, True), 4: (1, True), 5: (1, False), 6: (2, True)}
    soon = spark.createDataFrame([("a", 0, T0, "", "slot stalled at first page"), ("a", 1, T0, "", "slot stalled at very first page")], df.schema)
    assert [r.cluster for r in storms.storm_fuzzy(soon).collect()] == [1, 1]
    s = df.select("seq", storms.signature(F.col("connector"), F.col("code"), F.col("message")).alias("s")).collect()
    assert {r.s for r in s if r.seq < 2} == {"a|slot ? stalled at page ?"}


def test_audit_and_versions(spark):
    d = spark.createDataFrame([(1, '{"a":1,"b":{"x":1,"y":2}}', '{"b":{"y":2,"x":1},"c":null}'), (2, None, '{"a":1}'), (3, "broken", "{}")], "id long, before string, after string")
    assert sorted((r.id, r.field, r.from_value, r.to_value) for r in events.audit_field_diff(d, ["id"]).collect()) == [(1, "a", "1", None), (1, "c", None, None), (2, "a", None, "1")]
    h = spark.createDataFrame([(1, i, c) for i, c in enumerate("aabba")], "k long, i long, content string")
    assert [(r.i, r.version) for r in events.config_versions(h, ["k"], ["i"], "content").orderBy("i").collect()] == [(0, 1), (2, 2), (4, 3)]


def test_catalog(spark):
    streams = spark.createDataFrame([("users", ["full_load", "incremental", "cdc"]), ("logs", ["full_load"])], "stream string, modes array<string>")
    cols = spark.createDataFrame([("users", "id"), ("users", "updated_at"), ("logs", "line")], "stream string, name string")
    chosen = spark.createDataFrame([("users", "incremental", "updated_at"), ("users", "incremental", ""), ("users", "incremental", "nope"), ("logs", "cdc", None), ("gone", "full_load", None), ("logs", "full_load", None)], "stream string, mode string, cursor_field string")
    assert sorted(r.error for r in schema.catalog_validate(chosen, streams, cols).collect()) == ["cursor_field missing", "cursor_field not in schema", "mode not supported", "stream not in catalog"]
