"""Rules over events: matches, muting, incidents, alerts, escalation and on-call rotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncproof.functions.joins import bounded
from syncproof.operators.ranges import laid, with_running

#: Error codes with their causes and fixes, as users read them (fixed values).
KNOWN_CAUSES = [
    ("connection_refused", "The pipeline could not reach the source database.", "Verify the source is running and reachable, then check host/port/credentials in the pipeline config."),
    ("cdc_position_lost", "The change-data-capture position was no longer available on the source (WAL/binlog aged out).", "Re-run an initial backfill to re-anchor CDC, then resume streaming."),
    ("replica_identity_partial", "A source table lacks a full replica identity, so updates/deletes cannot be captured completely.", "Set REPLICA IDENTITY FULL (or a unique index) on the affected table."),
    ("wal_level", "The source is not configured for logical replication.", "Set wal_level=logical on the source and restart it, then re-check the connection."),
    ("schema_mismatch", "The source schema changed in a way the destination could not absorb automatically.", "Review the schema-change event and reconcile the destination table, then re-run the sync."),
]
NO_CAUSE = "The sync failed for an unspecified reason."
RETRY_FIX = "The error is marked retryable; re-run the sync, and if it recurs inspect the source and connector config."
OTHER_FIX = "Inspect the pipeline's latest run logs and the source system, then re-run once the underlying issue is resolved."


def in_scope(rules: DataFrame) -> DataFrame:
    """Enabled rules, their scope and condition under names of their own (rule_*)."""
    own = {"id": "rule_id", "pipeline_id": "rule_pipeline"} | {c: f"rule_{c}" for c in ("stream", "name", "event", "field", "op", "value") if c in rules.columns}
    return rules.filter("enabled").drop("enabled").withColumnsRenamed(own)


def rules_for_pipeline(rules: DataFrame, pipelines: DataFrame) -> DataFrame:
    """(pipeline_id, rule columns): each pipeline's own enabled rules and the global ones."""
    return pipelines.join(bounded(in_scope(rules)), F.col("rule_pipeline").isNull() | (F.col("rule_pipeline") == F.col("pipeline_id")))


def json_kind(value: Column) -> Column:
    """number, boolean, string, null or other, of a JSON text."""
    return F.when(value.rlike(r"^-?[0-9]"), "number").when(value.isin("true", "false"), "boolean").when(value.startswith('"'), "string").when(value == "null", "null").otherwise("other")


def rule_match(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with every rule that fires for them.

    rules: (id, pipeline_id, stream, name, enabled, event, field, op, value, ...); a NULL or empty event, stream or field does not
    restrict. Ops eq, ne and contains compare texts; gt, gte, lt and lte only compare JSON numbers with numbers; exists,
    is_true and is_false look at the field itself. A payload is parsed once, then each event meets the rules of its kind and those of
    any kind in one equi-join; rules are broadcast up to a counted number of them.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    scoped = in_scope(rules).withColumn("_kind", F.coalesce("rule_event", F.lit("")))
    fields = F.coalesce(F.from_json("payload", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    parsed = events.withColumn("_fields", fields).withColumn("_kind", F.explode(F.array_distinct(F.array(F.coalesce("event", F.lit("")), F.lit("")))))
    met = parsed.join(bounded(scoped), "_kind").drop("_kind")
    met = met.filter((F.col("rule_pipeline").isNull() | (F.col("rule_pipeline") == F.col("pipeline_id"))) & (blank("rule_stream") | (F.col("rule_stream") == F.col("stream"))))
    raw = F.to_json(F.try_element_at("_fields", F.col("rule_field")))
    met = met.withColumn("_there", F.coalesce(F.map_contains_key("_fields", F.col("rule_field")), F.lit(False))).withColumn("_raw", F.coalesce(raw, F.lit("null")))
    text = F.when(json_kind(F.col("_raw")) == "string", F.get_json_object(F.concat(F.lit('{"x":'), F.col("_raw"), F.lit("}")), "$.x")).when(F.col("_raw") == "null", "<nil>").otherwise(F.col("_raw"))
    number = F.when(json_kind(F.col("_raw")) == "number", F.col("_raw").try_cast("double"))
    want_text = F.when(json_kind(F.col("rule_value")) == "string", F.get_json_object(F.concat(F.lit('{"x":'), F.col("rule_value"), F.lit("}")), "$.x")).otherwise(F.col("rule_value"))
    want = F.when(json_kind(F.col("rule_value")) == "number", F.col("rule_value").try_cast("double"))
    fires = (
        F.when(blank("rule_field"), F.lit(True))
        .when(F.col("rule_op") == "exists", F.col("_there"))
        .when(F.col("rule_op") == "is_true", F.col("_there") & (F.col("_raw") == "true"))
        .when(F.col("rule_op") == "is_false", F.col("_there") & (F.col("_raw") == "false"))
        .when(~F.col("_there"), F.lit(False))
        .when(F.coalesce(F.col("rule_op"), F.lit("")).isin("eq", ""), text == want_text)
        .when(F.col("rule_op") == "ne", text != want_text)
        .when(F.col("rule_op") == "contains", F.contains(text, want_text))
        .when(F.col("rule_op") == "gt", number > want)
        .when(F.col("rule_op") == "gte", number >= want)
        .when(F.col("rule_op") == "lt", number < want)
        .when(F.col("rule_op") == "lte", number <= want)
    )
    return met.filter(F.coalesce(fires, F.lit(False))).drop("_fields", "_there", "_raw", "rule_event", "rule_pipeline", "rule_stream", "rule_field", "rule_op", "rule_value")


def maintenance_mute(matches: DataFrame, now: Column) -> DataFrame:
    """Matches whose rule is not in maintenance at `now`."""
    return matches.filter(F.col("maintenance_until").isNull() | (now >= F.col("maintenance_until")))


def quiet(now: Column, tz: Column, ranges: Column) -> Column:
    """Whether now is in any daily range (start, end as HH:MM) of the timezone: [start, end), over midnight if start is later."""
    local = F.from_utc_timestamp(now, F.coalesce(F.nullif(tz, F.lit("")), F.lit("UTC")))
    minute = F.hour(local) * 60 + F.minute(local)

    def of(hm: Column) -> Column:
        h, m = F.regexp_extract(hm, r"^(\d{1,2}):(\d{1,2})", 1).try_cast("int"), F.regexp_extract(hm, r"^(\d{1,2}):(\d{1,2})", 2).try_cast("int")
        return F.when((h <= 23) & (m <= 59), h * 60 + m)

    def inside(r: Column) -> Column:
        s, e = of(r["start"]), of(r["end"])
        return F.coalesce(F.when(s <= e, (minute >= s) & (minute < e)).otherwise((minute >= s) | (minute < e)), F.lit(False))

    return F.coalesce(F.exists(ranges, inside), F.lit(False))


def incident_fingerprint(pipeline: Column, rule: Column, stream: Column, kind: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", pipeline.cast("string"), rule.cast("string"), F.coalesce(stream, F.lit("")), kind), 256), 1, 32)


def incident_title(rule_name: Column, kind: Column, stream: Column) -> Column:
    return F.concat(rule_name, F.lit(": "), kind, F.when(F.coalesce(stream, F.lit("")) != "", F.concat(F.lit(" on "), stream)).otherwise(""))


def incident_dedup(matches: DataFrame, resolves: DataFrame, seq: str = "seq") -> DataFrame:
    """(fingerprint, island, opened_seq, opened_at, event_count, title, ...): matches of a fingerprint between two resolves are one incident.

    matches: rule_match() rows with fingerprint, ts and seq; resolves: (fingerprint, seq). The number of resolves before a match
    is its island. A fingerprint may hold any share of the matches: they are laid out by ranges.
    """
    rows = matches.withColumn("_resolve", F.lit(0)).unionByName(resolves.withColumn("_resolve", F.lit(1)), allowMissingColumns=True)
    whole = with_running(laid(rows, ["fingerprint"], [seq, "_resolve"]), ["fingerprint"], F.col("_resolve"), "island")
    islands = whole.filter("_resolve = 0")
    first = F.struct(F.col(seq).alias("opened_seq"), F.col("ts").alias("opened_at"), "pipeline_id", "rule_id", "stream", incident_title(F.col("rule_name"), F.col("event"), F.col("stream")).alias("title"), "severity", "channel_ids")
    return islands.groupBy("fingerprint", "island").agg(F.count("*").alias("event_count"), F.min_by(first, F.col(seq)).alias("f")).select("fingerprint", "island", "event_count", "f.*")


def alert_fanout(incidents: DataFrame, is_quiet: Column | None = None) -> DataFrame:
    """An alert (fingerprint, island, rule_id, channel_id) for each channel of a newly opened incident, unless it is quiet."""
    loud = incidents if is_quiet is None else incidents.filter(~is_quiet)
    return loud.select("fingerprint", "island", "rule_id", F.explode("channel_ids").alias("channel_id"))


def incident_transitions(actions: DataFrame, incident: str = "incident_id", seq: str = "seq", action: str = "action") -> DataFrame:
    """(incident, status, applied, rejected) after each incident's ordered actions; it starts open.

    Ack goes from open and snoozed, snooze from open and acked, resolve from all three; other moves are rejected. So nothing applies
    after the first resolve, and before it an ack or a snooze applies unless the last of these two was the same. Actions of one
    seq are taken in the order of their names.
    """
    w = Window.partitionBy(incident).orderBy(seq, action)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    a, toggles = F.col(action), F.when(F.col(action).isin("ack", "snooze"), F.col(action))
    closed = F.coalesce(F.max(a == "resolve").over(before), F.lit(False))
    seen = actions.withColumn("_closed", closed).withColumn("_held", F.last(toggles, ignorenulls=True).over(before))
    to = F.when(F.col("_closed"), None).when(a == "resolve", "resolved").when((a == "ack") & ~F.col("_held").eqNullSafe("ack"), "acked").when((a == "snooze") & ~F.col("_held").eqNullSafe("snooze"), "snoozed")
    moved = seen.withColumn("_to", to)
    last = F.max_by("_to", F.when(F.col("_to").isNotNull(), F.struct(seq, action)))
    return moved.groupBy(incident).agg(F.coalesce(last, F.lit("open")).alias("status"), F.count("_to").alias("applied"), F.count_if(F.col("_to").isNull()).alias("rejected"))


def escalation_first(opened_at: Column, steps: Column) -> Column:
    """When the first step of a new incident is due; NULL without a policy. steps: array of (after_seconds, channel_ids, oncall_schedule_id)."""
    return F.when(steps.isNotNull(), F.timestamp_micros(F.unix_micros(opened_at) + F.coalesce(F.get(steps, F.lit(0))["after_seconds"], F.lit(0)).cast("long") * 1_000_000))


def escalation_due(incidents: DataFrame, policies: DataFrame, now: Column, oncall: DataFrame | None = None) -> DataFrame:
    """(incident_id, targets, notified_step, next_step, next_escalation_at) of open incidents whose step is due at `now`.

    policies: (policy_id, steps); oncall: (schedule_id, channel_ids) of who is on call now. An exhausted policy gives no targets and
    no next time.
    """
    due = incidents.filter((F.col("status") == "open") & F.col("policy_id").isNotNull() & (F.col("next_escalation_at") <= now)).join(bounded(policies), "policy_id")
    due = due.withColumn("this", F.get("steps", F.col("step"))).withColumn("after", F.get("steps", F.col("step") + 1))
    if oncall is not None:
        due = due.join(bounded(oncall.select(F.col("schedule_id").alias("_schedule"), F.col("channel_ids").alias("_oncall"))), F.col("this.oncall_schedule_id") == F.col("_schedule"), "left")
    else:
        due = due.withColumn("_oncall", F.lit(None).cast("array<long>"))
    none = F.array().cast("array<long>")
    targets = F.concat(F.coalesce("this.channel_ids", none), F.coalesce("_oncall", none))
    exhausted = F.col("step") >= F.size("steps")
    at = F.timestamp_micros(F.unix_micros(now) + F.col("after.after_seconds").cast("long") * 1_000_000)
    return due.select("incident_id", F.when(exhausted, none).otherwise(targets).alias("targets"), F.when(~exhausted, F.col("step") + 1).alias("notified_step"), F.when(exhausted, F.col("step")).otherwise(F.col("step") + 1).alias("next_step"), F.when(~exhausted, at).alias("next_escalation_at"))


def oncall_current(at: DataFrame, schedules: DataFrame, overrides: DataFrame, ts: str = "ts") -> DataFrame:
    """at (rows with schedule_id and ts) with responder: the first listed override whose [start, end) holds ts, else the ISO week's turn.

    schedules: (schedule_id, responders array); overrides: (schedule_id, position, start, end, responder).
    """
    o = bounded(overrides.groupBy("schedule_id").agg(F.array_sort(F.collect_list(F.struct("position", "start", "end", "responder"))).alias("_overrides")))
    met = at.join(bounded(schedules), "schedule_id", "left").join(o, "schedule_id", "left")
    active = F.get(F.filter("_overrides", lambda x: (F.col(ts) >= x["start"]) & (F.col(ts) < x["end"])), F.lit(0))["responder"]
    turn = F.get("responders", F.pmod(F.weekofyear(ts), F.size("responders")))
    return met.select(*at.columns, F.coalesce(active, F.when(F.size("responders") > 0, turn)).alias("responder"))


def incident_enrich(failures: DataFrame) -> DataFrame:
    """failures (.., code, message, retryable) with root_cause, suggested_fix and severity."""
    known = failures.sparkSession.createDataFrame(KNOWN_CAUSES, "code string, _cause string, _fix string")
    met = failures.join(bounded(known), "code", "left")
    said = F.when(F.coalesce("message", F.lit("")) != "", F.concat(F.lit("The sync failed with: "), F.col("message"))).otherwise(NO_CAUSE)
    retry = F.coalesce("retryable", F.lit(False))
    return met.select(*failures.columns, F.coalesce("_cause", said).alias("root_cause"), F.coalesce("_fix", F.when(retry, RETRY_FIX).otherwise(OTHER_FIX)).alias("suggested_fix"), F.when(retry, "warning").otherwise("critical").alias("severity"))
