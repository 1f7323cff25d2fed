"""Queries of profiles, monitors, anomalies and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncproof.operators import anomaly, events, monitors, profile, reports
from syncproof.plans.fixtures import NOW, Registry
from syncproof.scratch import cut

R = Registry()
_NOW = f"make_timestamp(cast({NOW} as bigint))"


def now():
    return F.timestamp_micros(F.lit(NOW).cast("long"))


@R.query("column_stats", """with n as (select * from {events_null})
select 'event_id' "column", count(*) n_rows, count(*) - count(event_id) nulls, least(count(distinct event_id), 10000) "distinct", min(cast(event_id as varchar)) "min", max(cast(event_id as varchar)) "max" from n
union all select 'user_id', count(*), count(*) - count(user_id), least(count(distinct user_id), 10000), min(cast(user_id as varchar)), max(cast(user_id as varchar)) from n
union all select 'event_type', count(*), count(*) - count(event_type), least(count(distinct event_type), 10000), min(event_type), max(event_type) from n
union all select 'value', count(*), count(*) - count(value), least(count(distinct cast(value as decimal(18,2))), 10000), min(cast(cast(value as decimal(38,2)) as varchar)), max(cast(cast(value as decimal(38,2)) as varchar)) from n""")
def _(t):
    return profile.column_stats(t("events_null").drop("half"), double_scale=2)


@R.query("numeric_sketch", "select half as \"group\", least(cast(floor(value / 50) as bigint), 9) bucket, count(*) n from {events_null} where value is not null group by 1, 2")
def _(t):
    return profile.histogram(t("events_null"), "value", 50.0, 9, F.col("half"))


@R.query("profile_sketches", """with s as (select half, event_type, user_id, value from {events_null}),
c as (select 'event_type' "column", count(*) n_rows, count(*) - count(event_type) nulls from s union all select 'user_id', count(*), count(*) - count(user_id) from s union all select 'value', count(*), count(*) - count(value) from s)
select "column", n_rows, nulls, true distinct_ok, true quantiles_ok from c""")
def _(t):
    """Profiles of two halves, stored and merged, against exact values of the whole: distinct counts within 5 %, quantiles' ranks within 2 %."""
    rows = t("events_null").select("half", "event_type", "user_id", "value")
    parts = [cut(profile.sketch_profile(rows.filter(F.col("half") == h).drop("half"))) for h in ("base", "current")]
    merged = cut(profile.read_profile(profile.merge_profiles(parts[0].unionByName(parts[1]))))
    found = {r.column: r for r in merged.collect()}  # a row a column
    asked = [(c, i, q) for c, r in found.items() for i, q in enumerate(r.quantiles or [])]
    exact = rows.agg(*[F.count_distinct(c).alias(f"d_{c}") for c in found], *[f(F.col(c), q).alias(f"{n}_{c}_{i}") for c, i, q in asked for n, f in (("lo", lambda x, q: F.count_if(x < q) / F.count(x)), ("hi", lambda x, q: F.count_if(x <= q) / F.count(x)))]).first()
    near = {c: abs(r.distinct - exact[f"d_{c}"]) <= max(1, 0.05 * exact[f"d_{c}"]) for c, r in found.items()}
    ranks = {c: all(exact[f"lo_{c}_{i}"] - 0.02 <= i / 4 <= exact[f"hi_{c}_{i}"] + 0.02 for d, i, _ in asked if d == c) for c in found}
    told = lambda x: F.create_map(*[F.lit(v) for kv in x.items() for v in kv])[F.col("column")]
    return merged.select("column", "n_rows", "nulls", told(near).alias("distinct_ok"), told(ranks).alias("quantiles_ok"))


@R.query("profile_drift", "select 'value' as \"column\", true small union all select 'shifted', false")
def _(t):
    """Drift of two windows from their sketches alone: events of two halves are alike, doubled values are not."""
    rows = t("events_null").select("half", "value", F.when(F.col("half") == "base", F.col("value")).otherwise(2 * F.col("value")).alias("shifted"))
    one = lambda h: profile.sketch_profile(rows.filter(F.col("half") == h).drop("half"))
    return profile.drift(one("base"), one("current")).select("column", (F.col("psi") < 0.1).alias("small"))


@R.query("sync_totals", "select pipeline_id, cast(sum(rows_read) as bigint) rows_read, cast(sum(rows_written) as bigint) rows_written, cast(sum(bytes_written) as bigint) bytes_written, sum(duration_seconds) duration_seconds from {metrics} group by 1")
def _(t):
    return profile.sync_totals(t("metrics"), ["pipeline_id"])


@R.query("baseline_snapshot", """with recursive m as (select pipeline_id, value, row_number() over (partition by pipeline_id order by ts desc, seq desc) r, count(*) over (partition by pipeline_id) n from {metrics}),
s as (select pipeline_id, value, row_number() over (partition by pipeline_id order by r desc) i from m where r <= 200),
e(pipeline_id, i, x) as (select pipeline_id, i, value from s where i = 1 union all select s.pipeline_id, s.i, e.x * 0.7 + s.value * 0.3 from e join s on s.pipeline_id = e.pipeline_id and s.i = e.i + 1)
select pipeline_id, count(*) sample_count, round(avg(value), 4) mean, round(stddev_samp(value), 4) stddev, round(median(value), 4) median, round(mad(value), 4) mad, round((select arg_max(x, i) from e where e.pipeline_id = m.pipeline_id), 4) ewma from m group by 1""")
def _(t):
    out = profile.baseline_snapshot(t("metrics"), ["pipeline_id"], "value", ["ts", "seq"])
    return out.select("pipeline_id", "sample_count", *[F.round(c, 4).alias(c) for c in ("mean", "stddev", "median", "mad", "ewma")])


@R.query("cost_analytics", """with x as (select name, cast(coalesce(sum(rows_written), 0) as bigint) n_rows, cast(coalesce(sum(bytes_written), 0) as bigint) bytes, coalesce(sum(duration_seconds), 0.0) "seconds" from {pipelines} left join {metrics} using (pipeline_id) group by name)
select name, n_rows, bytes, "seconds", floor((bytes / 1073741824.0::double * 0.023 + "seconds" / 3600 * 0.1) * 100) / 100 est_cost_usd from x""")
def _(t):
    return reports.cost_analytics(t("pipelines"), t("metrics")).withColumn("seconds", F.col("seconds").cast("double"))


@R.query("monthly_rollup", """select strftime(date_trunc('month', ts), '%Y-%m') "month", name, cast(sum(rows_written) as bigint) n_rows, sum(duration_seconds) "seconds" from {metrics} join {pipelines} using (pipeline_id) group by rollup("month", name)""")
def _(t):
    return reports.monthly_rollup(t("pipelines"), t("metrics"))


_BADGE = """badge as (select d.pipeline_id, bool_and("match") diff_verified, cast(coalesce(sum(case when "match" then dest_rows end), 0) as bigint) verified_rows from {diff_runs} d
join (select pipeline_id, arg_max(sync_id, seq) sync_id from {diff_runs} group by 1) l on l.pipeline_id = d.pipeline_id and l.sync_id = d.sync_id group by 1)"""
_HEALTH = f"""with {_BADGE}, f as (select pipeline_id, bool_or(event = 'sync_failed') recent_failure from {{event_log}} where ts > {_NOW} - interval 1 day and ts <= {_NOW} group by 1),
i as (select pipeline_id, count(*) n from {{incidents}} where status in ('open', 'acked', 'snoozed') group by 1),
h as (select pipeline_id, coalesce(recent_failure, false) recent_failure, coalesce(diff_verified, true) diff_verified, coalesce(verified_rows, 0) verified_rows, coalesce(n, 0) open_incidents from {{pipelines}} left join f using (pipeline_id) left join badge using (pipeline_id) left join i using (pipeline_id)),
s as (select *, cast(greatest(100 - case when recent_failure then 40 else 0 end - case when diff_verified then 0 else 25 end - least(open_incidents * 10, 30), 0) as bigint) health_score from h)
"""


@R.query("diff_badge", f"with {_BADGE} select * from badge")
def _(t):
    return reports.diff_badge(t("diff_runs"))


def health(t):
    return reports.health_score(t("pipelines"), t("event_log"), t("diff_runs"), t("incidents"), now())


@R.query("health_score", _HEALTH + "select * from s")
def _(t):
    return health(t)


@R.query("fleet_overview", _HEALTH + """select cast(round(avg(health_score)) as bigint) avg_health, count(*) filter (diff_verified) verified, cast(sum(open_incidents) as bigint) open_incidents, cast(sum(verified_rows) as bigint) verified_rows, (select count(*) from {diff_runs} where not "match") mismatches from s""")
def _(t):
    return reports.fleet_overview(health(t), t("diff_runs"))


@R.query("pipeline_overview", "select pipeline_id, count(*) n_runs, sum(rows_written) / count(*) rows_per_run, cast(sum(bytes_written) as bigint) total_bytes, avg(duration_seconds) avg_seconds from {metrics} group by 1")
def _(t):
    return reports.pipeline_overview(t("metrics"))


_SERIES = "with m as (select *, row_number() over (partition by pipeline_id order by ts desc, seq desc) r from {metrics}) "


@R.query("recent_series", _SERIES + "select pipeline_id, count(*) n, array_to_string(list(cast(cast(value as decimal(18,2)) as varchar) order by ts, seq), ',') series from m where r <= 200 group by 1")
def _(t):
    out = anomaly.recent_series(t("metrics"), ["pipeline_id"], ["ts", "seq"], "value")
    return out.withColumn("series", F.array_join(F.transform("series", lambda x: x.cast("decimal(18,2)").cast("string")), ","))


@R.query("latest_stat", """with c as (select pipeline_id, stream, unnest(['a', '']) column_name, sync_id, seq, 100 + k row_count, k null_count from {event_log} where event = 'column_stats' union all select pipeline_id, stream, unnest(['b', '']), sync_id, seq, 100, k % 10 from {event_log} where event = 'column_stats'),
r as (select *, row_number() over (partition by pipeline_id, stream, column_name order by seq desc, row_count desc, null_count desc) rn from c)
select pipeline_id, stream, column_name, sync_id, row_count, null_count from r where rn = 1""")
def _(t):
    stats = events.derive_column_stats(t("event_log"))
    return monitors.latest_stat(stats, ("ts", "row_count", "null_count")).drop("ts")


@R.query("metrics_series", "select sync_id, cast(epoch_us(ts) as bigint) as micros, rows_written from {metrics} where pipeline_id = 3")
def _(t):
    return reports.metrics_series(t("metrics"), 3).select("sync_id", F.unix_micros("ts").alias("micros"), "rows_written")


@R.query("topk_diffs", "select seq, pipeline_id, stream, \"match\" from {diff_runs} order by created_at desc, seq desc limit 200")
def _(t):
    return reports.newest(t("diff_runs"), ["created_at", "seq"], 200).select("seq", "pipeline_id", "stream", "match")


@R.query("topk_incidents", "select incident_id, status from {incidents} order by opened_at desc, seq desc limit 200")
def _(t):
    return reports.newest(t("incidents"), ["opened_at", "seq"], 200).select("incident_id", "status")


@R.query("topk_audit", "select event_id from {ev} order by ts desc, event_id desc limit 500")
def _(t):
    return reports.newest(t("ev"), ["ts", "event_id"], 500).select("event_id")


@R.query("topk_backfills", "select seq from {event_log} where event = 'sync_finished' order by ts desc, seq desc limit 100")
def _(t):
    return reports.newest(t("event_log").filter("event = 'sync_finished'"), ["ts", "seq"], 100).select("seq")


_MAD = """with h as (select *, count(value) over w n, avg(value) over w mu, stddev_samp(value) over w sd, median(value) over w med, mad(value) over w md from {from} window w as (partition by {part} order by ts, event_id rows between 200 preceding and 1 preceding)),
s as (select *, case when n < 8 then 'cold_start' else 'scored' end status, case when n < 8 then 0.0 when md > 0 then abs(0.6745 * (value - med) / md) when sd > 0 then abs(value - mu) / sd else 0.0 end score from h)
select event_id, status, floor(score * 10000 + 0.001) / 10000 score, case when n < 8 then false when md > 0 or sd > 0 then score > 3.5 else value <> mu end anomaly from s"""


def rounded(df):
    """Scores cut to four places, a little above exact ties, where engines differ in the last bit."""
    return df.withColumn("score", F.floor(F.col("score") * 10000 + 0.001) / 10000)


@R.query("anomaly_mad", _MAD.replace("{from}", "{ev}").replace("{part}", "event_type"))
def _(t):
    return rounded(anomaly.anomaly_mad(t("ev"), ["event_type"], ["ts", "event_id"], "value")).select("event_id", "status", "score", "anomaly")


@R.query("anomaly_seasonal", _MAD.replace("{from}", "{ev}").replace("{part}", "event_type, dayofweek(ts), hour(ts)"))
def _(t):
    return rounded(anomaly.anomaly_seasonal(t("ev"), "event_type", "ts", ["ts", "event_id"], "value")).select("event_id", "status", "score", "anomaly")


@R.query("anomaly_lifetime", """with h as (select *, count(value) over a n, avg(value) over a mu, stddev_samp(value) over a sd, median(value) over w med, mad(value) over w md from {ev} window w as (partition by pipeline_id order by ts, event_id rows between 200 preceding and 1 preceding), a as (partition by pipeline_id order by ts, event_id rows between unbounded preceding and 1 preceding)),
s as (select *, case when n < 8 then 'cold_start' else 'scored' end status, case when n < 8 then 0.0 when md > 0 then abs(0.6745 * (value - med) / md) when sd > 0 then abs(value - mu) / sd else 0.0 end score from h)
select event_id, status, floor(score * 10000 + 0.001) / 10000 score, case when n < 8 then false when md > 0 or sd > 0 then score > 3.5 else value <> mu end anomaly from s""")
def _(t):
    return rounded(anomaly.anomaly_lifetime(t("ev"), ["pipeline_id"], ["ts", "event_id"], "value")).select("event_id", "status", "score", "anomaly")


@R.query("anomaly_latest", """with m as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from {ev}), h as (select user_id, count(*) n, avg(value) mu, stddev_samp(value) sd, median(value) med, mad(value) md from m where r between 2 and 200 group by 1),
s as (select user_id, value, n, mu, sd, md, case when md > 0 then abs(0.6745 * (value - med) / md) when sd > 0 then abs(value - mu) / sd else 0.0 end score from m join h using (user_id) where r = 1)
select user_id, value, floor(score * 10000 + 0.001) / 10000 score from s where n >= 8 and case when md > 0 or sd > 0 then score > 3.5 else value <> mu end""")
def _(t):
    return rounded(anomaly.anomaly_latest(t("ev"), ["user_id"], ["ts", "event_id"], "value"))


@R.query("seasonal_key", "select event_id, event_type || '|' || cast(dayofweek(ts) as varchar) || '-' || lpad(cast(hour(ts) as varchar), 2, '0') as season from {ev}")
def _(t):
    return t("ev").select("event_id", anomaly.seasonal_key(F.col("event_type"), F.col("ts")).alias("season"))


@R.query("mon_freshness", f"""select p.pipeline_id, cast(floor(epoch({_NOW})) - floor(epoch(last_sync_at)) as double) as "value", floor(epoch({_NOW})) - floor(epoch(last_sync_at)) > 3600 as breached from {{pipelines}} p join (select pipeline_id, arg_max(ts, seq) last_sync_at from {{event_log}} where event = 'sync_finished' and ts < {_NOW} group by 1) s on s.pipeline_id = p.pipeline_id""")
def _(t):
    value, breached = monitors.freshness(now(), F.col("last_sync_at"), F.lit(3600))
    return t("pipelines").select("pipeline_id").join(events.last_syncs(t("event_log").filter(F.col("ts") < now())), "pipeline_id", "left").select("pipeline_id", value.alias("value"), breached.alias("breached")).filter("value is not null")


@R.query("mon_volume", """select pipeline_id, round(case when mu > 0 then abs(c - mu) / mu else c end, 6) as "value", coalesce(mu > 0 and abs(c - mu) / mu > 0.5, false) breached from (select pipeline_id, case when pipeline_id = 4 then 0 else avg(rows_written) end mu, cast(arg_max(rows_written, seq) as double) c from {metrics} group by 1)""")
def _(t):
    rows = t("metrics").groupBy("pipeline_id").agg(F.avg("rows_written").alias("a"), F.max_by("rows_written", "seq").alias("c")).withColumn("mu", F.expr("case when pipeline_id = 4 then 0 else a end"))
    value, breached = monitors.volume(F.col("c"), F.col("mu"), F.lit(0.5))
    return rows.select("pipeline_id", F.round(value, 6).alias("value"), breached.alias("breached"))


@R.query("mon_null_rate", """with x as (select user_id, half, count(*) - count(value) nulls, count(*) n from {events_null} group by 1, 2)
select c.user_id, round(c.nulls / c.n, 6) as "value", c.nulls / c.n - b.nulls / b.n > 0.3 breached from x c join x b on b.user_id = c.user_id and b.half = 'base' where c.half = 'current'""")
def _(t):
    each = t("events_null").groupBy("user_id").pivot("half", ["base", "current"]).agg((F.count(F.lit(1)) - F.count("value")).alias("nulls"), F.count(F.lit(1)).alias("n")).filter("base_n > 0 and current_n > 0")
    value, breached = monitors.null_rate(F.col("current_nulls"), F.col("current_n"), F.col("base_nulls") / F.col("base_n"), F.lit(0.3))
    return each.select("user_id", F.round(value, 6).alias("value"), breached.alias("breached"))


@R.query("psi", """with t as (select *, n_base / sum(n_base) over () + 1e-6 b, n_cur / sum(n_cur) over () + 1e-6 c from {hist}) select round(sum((c - b) * ln(c / b)), 9) psi from t""")
def _(t):
    return monitors.psi(t("hist")).select(F.round("psi", 9).alias("psi"))


_DRIFT = """d as (select user_id % 20 as pipeline_id, least(cast(floor(value / 50) as bigint), 9) bucket, count(*) filter (half = 'base') n_base, count(*) filter (half = 'current') n_cur from {events_null} where value is not null group by 1, 2),
q as (select pipeline_id, (n_cur / sum(n_cur) over w + 1e-6) c, (n_base / sum(n_base) over w + 1e-6) b from d window w as (partition by pipeline_id)),
psi as (select pipeline_id, sum((c - b) * ln(c / b)) psi from q group by 1)"""


def drifts(t):
    hist = lambda half: profile.histogram(t("events_null").filter(F.col("half") == half), "value", 50.0, 9, F.expr("user_id % 20"))
    return monitors.psi(monitors.aligned(hist("base"), hist("current"), ("group", "bucket")), keys=("group",)).withColumnRenamed("group", "pipeline_id")


@R.query("mon_distribution", f"with {_DRIFT} select pipeline_id, round(psi, 6) as \"value\", psi > 0.1 breached from psi")
def _(t):
    return drifts(t).select("pipeline_id", F.round("psi", 6).alias("value"), (F.col("psi") > 0.1).alias("breached"))


@R.query("monitor_run", f"""with c as (select pipeline_id, stream, sync_id, seq, 100 + k row_count, k null_count from {{event_log}} where event = 'column_stats'),
st as (select pipeline_id, stream, arg_max(sync_id, seq) sync_id, arg_max(row_count, seq) row_count, arg_max(null_count, seq) null_count from c group by 1, 2),
sy as (select pipeline_id, arg_max(ts, seq) last_sync_at from {{event_log}} where event = 'sync_finished' group by 1), {_DRIFT},
m as (select pipeline_id * 10 + n as monitor_id, pipeline_id, 'public.s0' as stream, ['freshness', 'volume', 'null_rate', 'distribution'][n + 1] kind from {{pipelines}}, (select unnest(range(4)) n)),
e as (select m.*, st.*exclude(pipeline_id, stream), last_sync_at, psi, case kind when 'freshness' then floor(epoch({_NOW})) - floor(epoch(last_sync_at)) when 'volume' then abs(row_count - 150) / 150 when 'null_rate' then null_count / row_count else psi end v from m left join st on st.pipeline_id = m.pipeline_id and st.stream = m.stream left join sy on sy.pipeline_id = m.pipeline_id left join psi on psi.pipeline_id = m.pipeline_id)
select monitor_id, pipeline_id, case when kind in ('volume', 'null_rate') then sync_id else '' end sync_id, kind, round(v, 6) as "value", coalesce(case kind when 'freshness' then v > 3600 when 'volume' then v > 0.2 when 'null_rate' then v - 0.02 > 0.1 else v > 0.1 end, false) breached from e where v is not null""")
def _(t):
    stats = events.derive_column_stats(t("event_log")).filter("column_name = 'a'")
    latest = stats.groupBy("pipeline_id", "stream").agg(F.max_by(F.struct("sync_id", "row_count", "null_count"), "ts").alias("s")).select("pipeline_id", "stream", F.lit("a").alias("column_name"), "s.*")
    kinds = F.posexplode(F.array(*map(F.lit, ["freshness", "volume", "null_rate", "distribution"]))).alias("n", "kind")
    each = t("pipelines").select("pipeline_id", kinds).select((F.col("pipeline_id") * 10 + F.col("n")).alias("id"), "pipeline_id", F.lit("public.s0").alias("stream"), F.lit("a").alias("column_name"), "kind", F.lit(True).alias("enabled"), F.lit(3600.0).alias("threshold_seconds"), F.lit(0.2).alias("max_deviation"), F.lit(0.1).alias("max_increase"), F.lit(150.0).alias("mean"), F.lit(0.02).alias("null_rate"), F.lit(0.1).alias("max_psi"))
    drifted = drifts(t).select("pipeline_id", F.lit("public.s0").alias("stream"), F.lit("a").alias("column_name"), "psi")
    return monitors.monitor_run(each, latest, events.last_syncs(t("event_log")), now(), drifted).withColumn("value", F.round("value", 6))


@R.query("rules_list", "select id, r.name, coalesce(p.name, '') pipeline_name from {rules} r left join (select distinct user_id % 20 as pipeline_id, 'pipe' || cast(user_id % 5 as varchar) as name from {ev}) p on p.pipeline_id = r.pipeline_id")
def _(t):
    names = t("ev").select(F.expr("user_id % 20").alias("pipeline_id"), F.concat(F.lit("pipe"), F.expr("user_id % 5")).alias("name")).distinct()
    return reports.with_pipeline_name(t("rules"), names).select(F.col("id").cast("int").alias("id"), "name", "pipeline_name")


@R.query("monitors_list", "select i.incident_id, coalesce(p.name, '') pipeline_name from {incidents} i left join {pipelines} p on p.pipeline_id = i.pipeline_id")
def _(t):
    return reports.with_pipeline_name(t("incidents"), t("pipelines")).select("incident_id", "pipeline_name")
