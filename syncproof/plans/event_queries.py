"""Queries of the event log, rules, incidents, storms and escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncproof.operators import events, reports, rules, storms
from syncproof.plans.fixtures import BASE, NOW, Registry
from syncproof.scratch import new_path
from syncproof.sources import files

R = Registry()
_NOW = f"make_timestamp(cast({NOW} as bigint))"
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def now():
    return F.timestamp_micros(F.lit(NOW).cast("long"))


def text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@R.query("src_events_jsonl", f"select {_TS} ts, event, sync_id, cast(pipeline_id as varchar) pipeline_id, stream, payload from {{event_log}} where seq % 100 <> 0")
def _(t):
    log = t("event_log")
    path = new_path(log.sparkSession)
    log_lines(log).write.text(path)
    return files.events_jsonl(log.sparkSession, path)[0].select(text("ts").alias("ts"), "event", "sync_id", "pipeline_id", "stream", "payload")


def log_lines(log):
    """Events as JSON lines; one in a hundred is torn."""
    line = F.to_json(F.struct("v", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "event", "sync_id", "pipeline_id", "stream"))
    whole = F.concat(F.substr(line, F.lit(1), F.length(line) - 1), F.lit(',"payload":'), "payload", F.lit("}"))
    return log.select(F.when(F.col("seq") % 100 == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("value"))


@R.query("derive_metrics", "select pipeline_id, sync_id, cast(k * 10 as bigint) rows_read, cast(k * 9 as bigint) rows_written, k * 1000 bytes_written, floor(value) + 0.5 duration_seconds from {event_log} where event = 'sync_finished'")
def _(t):
    return events.derive_metrics(t("event_log")).drop("ts")


@R.query("last_syncs", "select pipeline_id, strftime(arg_max(ts, seq), '%Y-%m-%d %H:%M:%S.%f') last_sync_at from {event_log} where event = 'sync_finished' group by 1")
def _(t):
    return events.last_syncs(t("event_log")).withColumn("last_sync_at", text("last_sync_at"))


@R.query("derive_diff_runs", """with recursive x as (select pipeline_id, sync_id, stream, seq, k % 2 = 0 src, 100 + k % 3 n, 'c' || cast(k % 2 as varchar) c, row_number() over (partition by pipeline_id, sync_id, stream order by seq) i from {event_log} where event = 'checksum_computed'),
f as (select x.*, case when src then n end sn, case when src then c end sc, case when not src then n end dn, case when not src then c end dc, false fin from x where i = 1
union all select x.*, case when x.src then x.n when f.fin then null else f.sn end, case when x.src then x.c when f.fin then null else f.sc end, case when not x.src then x.n when f.fin then null else f.dn end, case when not x.src then x.c when f.fin then null else f.dc end,
 not f.fin and (case when x.src then f.dn else f.sn end) is not null from f join x on x.pipeline_id = f.pipeline_id and x.sync_id = f.sync_id and x.stream = f.stream and x.i = f.i + 1)
select pipeline_id, sync_id, stream, seq, sn source_rows, dn dest_rows, sc source_checksum, dc dest_checksum, sn = dn and sc = dc as "match" from f where fin""")
def _(t):
    return events.derive_diff_runs(t("event_log"))


@R.query("derive_lineage", """select pipeline_id, stream source_stream, 'c' || cast(k % 7 as varchar) source_column, 'int4' source_type, stream dest_table, 'd' || cast(k % 7 as varchar) dest_column, arg_max(case when k % 2 = 0 then 'int32' else 'int64' end, seq) dest_type, arg_max(sync_id, seq) sync_id from {event_log} where event = 'column_mapping' group by pipeline_id, stream, k % 7""")
def lineage(t):
    return events.derive_lineage(t("event_log"))


@R.query("lineage_edges_list", """select stream source_stream, 'c' || cast(k % 7 as varchar) source_column, 'd' || cast(k % 7 as varchar) dest_column from {event_log} where event = 'column_mapping' and pipeline_id = 5 group by stream, k % 7""")
def _(t):
    return reports.lineage_edges(lineage(t), 5).select("source_stream", "source_column", "dest_column")


@R.query("derive_column_stats", """select pipeline_id, stream, 'a' column_name, sync_id, 100 + k row_count, k null_count, cast(5 as bigint) distinct_estimate, '0' min_value, '9' max_value from {event_log} where event = 'column_stats'
union all select pipeline_id, stream, 'b', sync_id, 100, k % 10, 7, 'a', 'z' from {event_log} where event = 'column_stats'""")
def _(t):
    return events.derive_column_stats(t("event_log")).drop("ts")


_MATCH = """with r as (select * from {rules} where enabled), m as (select e.*, r.id rule_id, r.name rule_name, r.severity, r.maintenance, r.quiet_start, r.quiet_end, r.n_channels from {event_log} e join r on (r.event = '' or r.event = e.event) and (r.pipeline_id is null or r.pipeline_id = e.pipeline_id) and (r.stream = '' or r.stream = e.stream)
where case r.id when 1 then true when 2 then floor(e.value) + 0.5 > 120 when 3 then k % 5 = 0 when 5 then json_extract_string(payload, '$.code') <> 'connection_refused' when 6 then contains(json_extract_string(payload, '$.message'), 'page 3') when 7 then false when 8 then e.event = 'checksum_computed' and 100 + k % 3 >= 102 end)
"""


def matches(t):
    r = t("rules").withColumn("maintenance_until", F.timestamp_micros("maintenance")).withColumn("quiet_ranges", F.when(F.col("quiet_start") != "", F.array(F.struct(F.col("quiet_start").alias("start"), F.col("quiet_end").alias("end")))).otherwise(F.array().cast("array<struct<start:string,end:string>>"))).withColumn("channel_ids", F.expr("sequence(1L, cast(n_channels as bigint))"))
    m = rules.rule_match(t("event_log"), r)
    return m.withColumn("fingerprint", rules.incident_fingerprint(F.col("pipeline_id"), F.col("rule_id"), F.col("stream"), F.col("event")))


@R.query("rule_match", _MATCH + "select seq, rule_id from m")
def _(t):
    return matches(t).select("seq", "rule_id")


@R.query("rules_for_pipeline", "select p.pipeline_id, r.id rule_id from {pipelines} p join {rules} r on enabled and (r.pipeline_id is null or r.pipeline_id = p.pipeline_id)")
def _(t):
    return rules.rules_for_pipeline(t("rules"), t("pipelines")).select("pipeline_id", "rule_id")


@R.query("maintenance_mute", _MATCH + f"select seq, rule_id from m where maintenance is null or epoch_us(ts) >= maintenance")
def _(t):
    return rules.maintenance_mute(matches(t), F.col("ts")).select("seq", "rule_id")


@R.query("quiet_hours", "select event_id, hour(ts) >= 22 or hour(ts) < 6 overnight, hour(ts) * 60 + minute(ts) between 570 and 629 morning, false never, (hour(ts) + 5) % 24 * 60 + (minute(ts) + 30) between 720 and 779 or (hour(ts) * 60 + minute(ts) + 330) % 1440 between 720 and 779 india from {ev}")
def _(t):
    r = lambda a, b: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")))
    q = lambda tz, a, b: rules.quiet(F.col("ts"), F.lit(tz), r(a, b))
    return t("ev").select("event_id", q("", "22:00", "06:00").alias("overnight"), q("UTC", "09:30", "10:30").alias("morning"), q("UTC", "08:00", "08:00").alias("never"), q("Asia/Kolkata", "12:00", "13:00").alias("india"))


@R.query("incident_fingerprint", "select seq, substr(sha256(cast(pipeline_id as varchar) || '|7|' || stream || '|' || event), 1, 32) fingerprint from {event_log}")
def _(t):
    return t("event_log").select("seq", rules.incident_fingerprint(F.col("pipeline_id"), F.lit(7), F.col("stream"), F.col("event")).alias("fingerprint"))


_INCIDENTS = _MATCH + """, fp as (select *, substr(sha256(cast(pipeline_id as varchar) || '|' || cast(rule_id as varchar) || '|' || stream || '|' || event), 1, 32) fingerprint from m),
res as (select fingerprint, seq from fp where k % 10 = 9), isl as (select fp.*, (select count(*) from res where res.fingerprint = fp.fingerprint and res.seq < fp.seq) island from fp),
inc as (select fingerprint, island, count(*) event_count, min(seq) opened_seq, arg_min(rule_name || ': ' || event || ' on ' || stream, seq) title, arg_min(severity, seq) severity, arg_min(rule_id, seq) rule_id, arg_min(n_channels, seq) n_channels, arg_min(hour(ts) >= 22 or hour(ts) < 6, seq) night from isl group by 1, 2)
"""


def incidents(t):
    m = matches(t)
    return rules.incident_dedup(m, m.filter("k % 10 = 9").select("fingerprint", "seq"))


@R.query("incident_dedup", _INCIDENTS + "select fingerprint, island, event_count, opened_seq, title, severity from inc")
def _(t):
    return incidents(t).select("fingerprint", "island", "event_count", "opened_seq", "title", "severity")


@R.query("alert_fanout", _INCIDENTS + "select fingerprint, island, cast(unnest(range(1, n_channels + 1)) as bigint) channel_id from inc where not (rule_id = 1 and night)")
def _(t):
    ranges = F.array(F.struct(F.lit("22:00").alias("start"), F.lit("06:00").alias("end")))
    muted = (F.col("rule_id") == 1) & rules.quiet(F.col("opened_at"), F.lit("UTC"), ranges)
    return rules.alert_fanout(incidents(t), muted).select("fingerprint", "island", "channel_id")


@R.query("incident_transitions", """with recursive a as (select user_id incident_id, case k % 4 when 0 then 'resolve' when 1 then 'ack' when 2 then 'snooze' else 'ack' end act, row_number() over (partition by user_id order by event_id) i from {ev}),
f as (select incident_id, cast(0 as bigint) i, 'open' status, cast(0 as bigint) applied, cast(0 as bigint) rejected from (select distinct incident_id from a)
union all select a.incident_id, a.i, case when act = 'ack' and status in ('open', 'snoozed') then 'acked' when act = 'snooze' and status in ('open', 'acked') then 'snoozed' when act = 'resolve' and status <> 'resolved' then 'resolved' else status end,
applied + case when (act = 'ack' and status in ('open', 'snoozed')) or (act = 'snooze' and status in ('open', 'acked')) or (act = 'resolve' and status <> 'resolved') then 1 else 0 end,
rejected + case when (act = 'ack' and status in ('open', 'snoozed')) or (act = 'snooze' and status in ('open', 'acked')) or (act = 'resolve' and status <> 'resolved') then 0 else 1 end from f join a on a.incident_id = f.incident_id and a.i = f.i + 1)
select incident_id, arg_max(status, i) status, max(applied) applied, max(rejected) rejected from f group by 1""")
def _(t):
    actions = t("ev").select(F.col("user_id").alias("incident_id"), F.col("event_id").alias("seq"), F.expr("case k % 4 when 0 then 'resolve' when 1 then 'ack' when 2 then 'snooze' else 'ack' end").alias("action"))
    return rules.incident_transitions(actions)


_SIG = "connector || '|' || case when coalesce(code, '') <> '' then code else trim(regexp_replace(regexp_replace(regexp_replace(lower(message), '0x[0-9a-fA-F]+|[0-9a-fA-F]{{8,}}', '?', 'g'), '[0-9]+', '?', 'g'), '\\s+', ' ', 'g')) end"


@R.query("signature", f"select seq, {_SIG} signature from {{failures}}")
def _(t):
    return t("failures").select("seq", storms.signature(F.col("connector"), F.col("code"), F.col("message")).alias("signature"))


@R.query("storm_exact", f"""with s as (select seq, ts, {_SIG} signature from {{failures}}), g as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by signature order by ts, seq)) > 7200000000, true) is_new from s)
select seq, signature, is_new, cast(sum(case when is_new then 1 else 0 end) over (partition by signature order by ts, seq) as bigint) as "cluster" from g""")
def _(t):
    rows = t("failures").select("seq", "ts", storms.signature(F.col("connector"), F.col("code"), F.col("message")).alias("signature"))
    return storms.storm_exact(rows, gap_seconds=7200).select("seq", "signature", "is_new", "cluster")


# The fixture's messages without a code are of two kinds: those about slots are alike, those about disks are not like them.
@R.query("storm_fuzzy", """with s as (select connector, seq, ts, case when coalesce(code, '') <> '' then code when message like '%slot%' then '~slot' else '~disk' end kind from {failures}),
g as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by connector, kind order by ts, seq)) > 7200000000, true) is_new from s),
n as (select *, sum(case when is_new then 1 else 0 end) over (partition by connector order by ts, seq) made from g)
select connector, seq, is_new, cast(max(case when is_new then made end) over (partition by connector, kind order by ts, seq) as bigint) as "cluster" from n""")
def _(t):
    return storms.storm_fuzzy(t("failures"), gap_seconds=7200)


@R.query("escalation_first", f"select incident_id, case when policy_id is null then null else cast(epoch_us(opened_at) + policy_id * 60000000 as bigint) end as due from {{incidents}}")
def _(t):
    step = lambda s: F.struct(s.alias("after_seconds"), F.array(F.lit(1).cast("long")).alias("channel_ids"))
    steps = F.when(F.col("policy_id").isNotNull(), F.array(step(F.col("policy_id") * 60), step(F.lit(600))))
    return t("incidents").select("incident_id", F.unix_micros(rules.escalation_first(F.col("opened_at"), steps)).alias("due"))


@R.query("escalation_due", f"""select incident_id, case when step >= policy_id then '' when step = 0 then '1,2' else '3,9' end targets, case when step < policy_id then step + 1 end notified_step, case when step >= policy_id then step else step + 1 end next_step, case when step + 1 < policy_id then cast({NOW} + 900000000 as bigint) end next_at
from {{incidents}} where status = 'open' and policy_id is not null and next_escalation_at <= {_NOW}""")
def _(t):
    spark = t("incidents").sparkSession
    policies = spark.createDataFrame([(1, [(60, [1, 2], None)]), (2, [(60, [1, 2], None), (900, [3], 77)])], "policy_id long, steps array<struct<after_seconds:long,channel_ids:array<long>,oncall_schedule_id:long>>")
    oncall = spark.createDataFrame([(77, [9])], "schedule_id long, channel_ids array<long>")
    out = rules.escalation_due(t("incidents"), policies, now(), oncall)
    return out.select("incident_id", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"), "notified_step", "next_step", F.unix_micros("next_escalation_at").alias("next_at"))


@R.query("oncall_current", f"""select event_id, case when user_id % 2 = 0 and epoch_us(ts) >= {BASE} + 86400000000 and epoch_us(ts) < {BASE} + 3 * 86400000000 then 'cover' else ['ann', 'bo', 'cy'][week(ts) % 3 + 1] end responder from {{ev}}""")
def _(t):
    spark = t("ev").sparkSession
    schedules = spark.createDataFrame([(0, ["ann", "bo", "cy"]), (1, ["ann", "bo", "cy"])], "schedule_id long, responders array<string>")
    span = spark.createDataFrame([(0, 0, BASE + 86_400_000_000, BASE + 3 * 86_400_000_000, "cover"), (0, 1, BASE, BASE + 2 * 86_400_000_000 - 86_400_000_000, "late")], "schedule_id long, position int, a long, b long, responder string")
    overrides = span.select("schedule_id", "position", F.timestamp_micros("a").alias("start"), F.timestamp_micros("b").alias("end"), "responder").filter("position = 0")
    rows = t("ev").select("event_id", F.expr("user_id % 2").alias("schedule_id"), "ts")
    return rules.oncall_current(rows, schedules, overrides).select("event_id", "responder")


@R.query("incident_enrich", """select seq, case code when 'connection_refused' then 'The pipeline could not reach the source database.' when 'wal_level' then 'The source is not configured for logical replication.' else 'The sync failed with: ' || message end root_cause, case when retryable then 'warning' else 'critical' end severity,
case code when 'connection_refused' then 'Verify the source is running and reachable, then check host/port/credentials in the pipeline config.' when 'wal_level' then 'Set wal_level=logical on the source and restart it, then re-check the connection.' else case when retryable then 'The error is marked retryable; re-run the sync, and if it recurs inspect the source and connector config.' else 'Inspect the pipeline''s latest run logs and the source system, then re-run once the underlying issue is resolved.' end end suggested_fix from {failures}""")
def _(t):
    return rules.incident_enrich(t("failures")).select("seq", "root_cause", "severity", "suggested_fix")


@R.query("audit_field_diff", """with x as (select event_id, k, user_id from {ev}) select event_id, 'k' field, cast(k as varchar) from_value, cast(k + 1 as varchar) to_value from x where k % 3 = 0
union all select event_id, 'gone', cast(user_id as varchar), null from x union all select event_id, 'new', null, '"n"' from x where false union all select event_id, 'new', null, 'n' from x""")
def _(t):
    before = F.expr("""concat('{"k":', k, ',"same":{"a":1,"b":2},"gone":', user_id, '}')""")
    after = F.expr("""concat('{"new":"n","same":{"b":2,"a":1},"k":', case when k % 3 = 0 then k + 1 else k end, '}')""")
    return events.audit_field_diff(t("ev").select("event_id", before.alias("before"), after.alias("after")), ["event_id"])


@R.query("config_versions", """with l as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) p from {ev}) select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as "version" from l where p is null or p <> event_type""")
def _(t):
    return events.config_versions(t("ev"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "version")


@R.query("config_rollback", """with l as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) p from {ev}), v as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) n from l where p is null or p <> event_type) select user_id, event_type, (select max(n) from v w where w.user_id = v.user_id) + 1 as "version" from v where n = 2""")
def _(t):
    history = events.config_versions(t("ev"), ["user_id"], ["ts", "event_id"], "event_type")
    targets = t("ev").select("user_id").distinct().withColumn("target", F.lit(2).cast("long"))
    return events.rollback(history, ["user_id"], targets).select("user_id", "event_type", "version")


@R.query("event_windows", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') window_start, event_type, count(*) n from {ev} group by 1, 2")
def _(t):
    return events.event_windows(t("events"), "ts", "event_type").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@R.query("event_windows_sliding", "select strftime(time_bucket(interval 30 minutes, ts) - to_minutes(cast(o * 30 as bigint)), '%Y-%m-%d %H:%M:%S') window_start, event_type, count(*) n from {ev}, (values (0), (1)) x(o) group by 1, 2")
def _(t):
    return events.event_windows(t("events"), "ts", "event_type", "1 hour", "30 minutes").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@R.query("event_sessions", """with l as (select user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) over w) > 21600000000, true) nw, event_id from {ev} window w as (partition by user_id order by ts, event_id)), s as (select *, sum(case when nw then 1 else 0 end) over (partition by user_id order by ts, event_id) sid from l)
select user_id, cast(epoch_us(min(ts)) as bigint) start_micros, count(*) n from s group by user_id, sid""")
def _(t):
    return events.event_sessions(t("events"), "ts", "user_id", "6 hours").select("user_id", F.unix_micros("session_start").alias("start_micros"), "n")
