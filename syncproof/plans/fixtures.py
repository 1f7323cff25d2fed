"""Sources, destinations, logs and event tables derived from the given tables by one SQL text, for Spark and for the oracle engine.

A query's oracle gets the fixtures that it names as common table expressions; its Spark side gets them as DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    """What the two engines write in different ways."""

    @staticmethod
    def at(micros: str) -> str:
        return f"timestamp_micros(cast({micros} as bigint))"

    @staticmethod
    def micros(ts: str) -> str:
        return f"unix_micros(cast({ts} as timestamp))"

    @staticmethod
    def field(json: str, name: str) -> str:
        return f"get_json_object({json}, '$.{name}')"

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(({a}) div ({b}))"


class Oracle:
    @staticmethod
    def at(micros: str) -> str:
        return f"make_timestamp(cast({micros} as bigint))"

    @staticmethod
    def micros(ts: str) -> str:
        return f"epoch_us({ts})"

    @staticmethod
    def field(json: str, name: str) -> str:
        return f"json_extract_string({json}, '$.{name}')"

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(({a}) // ({b}))"


BASE = 1_704_067_200_000_000  # 2024-01-01, in microseconds
NOW = BASE + 20 * 86_400_000_000 + 12 * 3_600_000_000  # 2024-01-21 12:00

FIXTURES: dict[str, Callable[[type], str]] = {
    "orders_dst": lambda e: """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice + case when o_orderkey % 101 = 0 then 1 else 0 end as o_totalprice, o_orderdate, o_orderpriority from {orders} where o_orderkey % 97 <> 0
union all
select o_orderkey + 10000000 as o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from {orders} where o_orderkey % 499 = 0""",
    "orders_log": lambda e: f"""
select o_orderkey, o_custkey, o_totalprice, 'r' as op, {e.at(str(BASE))} as ingested_at, o_orderkey * 10 as seq from {{orders}}
union all
select o_orderkey, o_custkey, o_totalprice + 1 as o_totalprice, 'u' as op, {e.at(f"{BASE} + 1000000")} as ingested_at, o_orderkey * 10 + 1 as seq from {{orders}} where o_orderkey % 5 = 0
union all
select o_orderkey, o_custkey, cast(null as double) as o_totalprice, 'd' as op, {e.at(f"{BASE} + 2000000")} as ingested_at, o_orderkey * 10 + 2 as seq from {{orders}} where o_orderkey % 11 = 0
union all
select o_orderkey + 10000000 as o_orderkey, o_custkey, o_totalprice, 'i' as op, {e.at(f"{BASE} + 3000000")} as ingested_at, o_orderkey * 10 + 3 as seq from {{orders}} where o_orderkey % 13 = 0""",
    "ev": lambda e: f"""
select event_id, {e.at(e.micros('ts'))} as ts, user_id, event_type, value, cast({e.field('props', 'k')} as bigint) as k, user_id % 20 as pipeline_id from {{events}}""",
    "events_null": lambda e: f"""
select event_id, user_id, event_type, case when event_id < {e.div('n', '2')} and event_id % 50 = 0 then null when event_id >= {e.div('n', '2')} and event_id % 3 = 0 then null else value end as value,
  case when event_id < {e.div('n', '2')} then 'base' else 'current' end as half from {{ev}}, (select max(event_id) + 1 as n from {{ev}}) as t""",
    "metrics": lambda e: """
select pipeline_id, concat('m', cast(event_id as string)) as sync_id, ts, cast(k * 10 as bigint) as rows_read, cast(floor(value) as bigint) as rows_written, k * 1000000 as bytes_written, cast(k as double) as duration_seconds, value, event_id as seq from {ev}""",
    "pipelines": lambda e: """
select distinct user_id % 25 as pipeline_id, concat('pipe', cast(user_id % 5 as string)) as name from {ev}""",
    "event_log": lambda e: """
select 1 as v, ts, case event_type when 'error' then 'sync_failed' when 'purchase' then 'sync_finished' when 'signup' then 'checksum_computed' when 'click' then 'column_mapping' else 'column_stats' end as event,
  concat('s', cast(user_id % 100 as string)) as sync_id, pipeline_id, concat('public.s', cast(event_id % 4 as string)) as stream,
  case event_type
    when 'error' then concat('{{"code":"', case when event_id % 2 = 0 then case k % 3 when 0 then 'connection_refused' when 1 then 'wal_level' else 'odd_code' end else '' end, '","message":"', case k % 5 when 0 then 'disk ' when 1 then 'old slot ' else 'slot ' end, cast(k as string), case k % 5 when 0 then ' is full on node ' else ' stalled at page ' end, cast(event_id % 7 as string), '","retryable":', case when k % 2 = 0 then 'true' else 'false' end, '}}')
    when 'purchase' then concat('{{"rows_read":', cast(k * 10 as string), ',"rows_written":', cast(k * 9 as string), ',"bytes_written":', cast(k * 1000 as string), ',"duration_seconds":', cast(cast(floor(value) as bigint) as string), '.5}}')
    when 'signup' then concat('{{"side":"', case when k % 2 = 0 then 'source' else 'destination' end, '","rows":', cast(100 + k % 3 as string), ',"checksum":"c', cast(k % 2 as string), '","match":', case when k % 5 = 0 then 'false' else 'true' end, '}}')
    when 'click' then concat('{{"source_column":"c', cast(k % 7 as string), '","source_type":"int4","dest_column":"d', cast(k % 7 as string), '","dest_type":"', case when k % 2 = 0 then 'int32' else 'int64' end, '"}}')
    else concat('{{"columns":[{{"column":"a","rows":', cast(100 + k as string), ',"nulls":', cast(k as string), ',"distinct":5,"min":"0","max":"9"}},{{"column":"b","rows":100,"nulls":', cast(k % 10 as string), ',"distinct":7,"min":"a","max":"z"}}]}}')
  end as payload, event_id as seq, event_type, k, value, user_id from {ev}""",
    "rules": lambda e: f"""
select * from (values
  (1, cast(null as bigint), '', 'failed', true, 'sync_failed', '', '', cast(null as string), 'critical', cast(null as bigint), '22:00', '06:00', 2),
  (2, cast(null as bigint), '', 'slow', true, 'sync_finished', 'duration_seconds', 'gt', '120', 'warning', cast(null as bigint), '', '', 1),
  (3, cast(null as bigint), '', 'mismatch', true, 'checksum_computed', 'match', 'is_false', cast(null as string), 'critical', cast(null as bigint), '', '', 3),
  (4, cast(null as bigint), '', 'off', false, 'sync_failed', '', '', cast(null as string), 'info', cast(null as bigint), '', '', 1),
  (5, 7, '', 'pipe seven', true, 'sync_failed', 'code', 'ne', '"connection_refused"', 'warning', cast(null as bigint), '', '', 1),
  (6, cast(null as bigint), 'public.s1', 'in maintenance', true, 'sync_failed', 'message', 'contains', '"page 3"', 'warning', {NOW}, '', '', 1),
  (7, cast(null as bigint), '', 'text is no number', true, 'checksum_computed', 'checksum', 'gt', '0', 'info', cast(null as bigint), '', '', 1),
  (8, cast(null as bigint), 'public.s2', 'any kind', true, '', 'rows', 'gte', '102', 'info', cast(null as bigint), '', '', 1)
) as t(id, pipeline_id, stream, name, enabled, event, field, op, value, severity, maintenance, quiet_start, quiet_end, n_channels)""",
    "failures": lambda e: f"""
select seq, ts, pipeline_id, stream, concat('c', cast(user_id % 3 as string)) as connector, {e.field('payload', 'code')} as code, {e.field('payload', 'message')} as message, {e.field('payload', 'retryable')} = 'true' as retryable from {{event_log}} where event = 'sync_failed'""",
    "diff_runs": lambda e: f"""
select pipeline_id, stream, sync_id, 'sync' as kind, cast({e.field('payload', 'rows')} as bigint) as source_rows, cast({e.field('payload', 'rows')} as bigint) - case when k % 5 = 0 then 1 else 0 end as dest_rows, k % 5 <> 0 as match, ts as created_at, seq from {{event_log}} where event = 'checksum_computed'""",
    "incidents": lambda e: """
select seq as incident_id, pipeline_id, case k % 4 when 0 then 'open' when 1 then 'acked' when 2 then 'snoozed' else 'resolved' end as status, cast(k % 3 as int) as step, case when k % 10 < 8 then k % 2 + 1 end as policy_id, ts as opened_at, ts as next_escalation_at, seq from {event_log} where event = 'sync_failed'""",
    "hist": lambda e: f"""
select least(cast(floor(value / 50) as bigint), 9) as bucket, count(case when event_id < {e.div('n', '2')} then 1 end) as n_base, count(case when event_id >= {e.div('n', '2')} then 1 end) as n_cur
from {{ev}}, (select max(event_id) + 1 as n from {{ev}}) as t group by 1""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name](Spark)
    return spark.sql(text, **{n: fixture(spark, sf_dir, n) for n in names_in(text)})


def names_in(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))]


def oracle(body: str) -> str:
    """body with the fixtures that it names in braces before it; its own `with` clause may follow."""
    done: dict[str, str] = {}

    def need(text: str) -> str:
        for n in names_in(text):
            if n not in TABLES and n not in done:
                sql = need(FIXTURES[n](Oracle))
                done.setdefault(n, sql)
        return text.format(**{n: n for n in names_in(text)})

    main = need(body).strip()
    first = [f"{n} as ({sql.strip()})" for n, sql in done.items()]
    for opening in ("with recursive ", "with "):
        if main.startswith(opening):
            return opening + ",\n".join([*first, main[len(opening) :]])
    return ("with " + ",\n".join(first) + "\n" if first else "") + main


class Registry:
    """Queries and their oracle SQL by name."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(lambda table: fixture(spark, sf_dir, table))
            if sql is not None:
                self.sql[name] = oracle(sql)
            return f

        return add
