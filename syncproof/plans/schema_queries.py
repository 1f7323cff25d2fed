"""Queries of schema operators: column rows derived from events, and documents in their JSON properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncproof.operators import schema
from syncproof.plans.fixtures import Registry

R = Registry()
#: (source, native type, lake type) as the oracle expects them.
SAMPLES = [
    ("postgres", "numeric(10,2)", "decimal"), ("postgres", "integer[]", "array"), ("postgres", "timestamp with time zone", "timestamp"), ("postgres", "hstore", "string"), ("postgres", "JSONB", "json"),
    ("mysql", "mediumint", "int32"), ("mysql", "year", "int32"), ("mysql", "double precision", "float64"), ("mysql", "longblob", "binary"), ("mysql", "enum", "string"),
    ("mssql", "money", "decimal"), ("mssql", "float", "float64"), ("mssql", "timestamp", "binary"), ("mssql", "datetimeoffset", "timestamp"), ("mssql", "xml", "string"),
    ("sqlite", "UNSIGNED BIG INT", "int64"), ("sqlite", "varchar(20)", "string"), ("sqlite", "DOUBLE", "float64"), ("sqlite", "date", "date"), ("sqlite", "", "string"), ("sqlite", "datetime", "timestamp"),
    ("clickhouse", "LowCardinality(Nullable(String))", "string"), ("clickhouse", "Nullable(UInt64)", "int64"), ("clickhouse", "DateTime64(3)", "timestamp"), ("clickhouse", "Array(Int32)", "json"), ("clickhouse", "Int128", "int64"), ("clickhouse", "Date32", "date"), ("clickhouse", "Decimal(9, 2)", "decimal"),
    ("cassandra", "varint", "int64"), ("cassandra", "frozen<list<int>>", "json"), ("cassandra", "timeuuid", "string"),
    ("elasticsearch", "scaled_float", "float64"), ("elasticsearch", "nested", "json"), ("elasticsearch", "keyword", "string"), ("mongodb", "decimal", "decimal"), ("dynamodb", "N", "decimal"),
]
_VALUES = ", ".join(f"({i}, '{s}', '{n}', '{x}')" for i, (s, n, x) in enumerate(SAMPLES))
_CASE = lambda names: "case event_id % {n} {w} end".format(n=len(names), w=" ".join(f"when {i} then '{x}'" for i, x in enumerate(names)))
NAMES = ["id", "updated_at", "created_at", "modified_at", "note", "_id"]
KINDS = ["int64", "timestamp", "string", "date", "int32"]


@R.query("type_map", f"select event_id, s source, n native_type, x lake_type from {{ev}} join (values {_VALUES}) v(i, s, n, x) on i = event_id % {len(SAMPLES)}")
def _(t):
    spark = t("ev").sparkSession
    samples = spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(SAMPLES)], "i long, source string, native_type string")
    rows = t("ev").join(F.broadcast(samples), F.col("event_id") % len(SAMPLES) == F.col("i")).select("event_id", "source", "native_type")
    return schema.type_map(rows)


@R.query("infer_schema_merge", """with f as (select 'k' field, case when event_id % 100 = 7 then 'string' else 'int64' end t from {ev} union all select 'n', 'int64' from {ev} union all select 'o', 'json' from {ev} union all select 's', 'string' from {ev} where event_id % 2 = 0 union all select 'b', 'bool' from {ev})
select field, case when count(distinct t) > 1 then 'string' else min(t) end as "type" from f group by 1""")
def _(t):
    document = F.expr("""concat('{"k":', case when event_id % 100 = 7 then concat('"', k, '"') else cast(k as string) end, ',"n":', user_id, ',"o":{"x":[1]},"b":true', case when event_id % 2 = 0 then ',"s":"t"' else ',"s":null' end, '}')""")
    return schema.infer_schema_merge(schema.json_types(t("ev").select(document.alias("d")), "d"))


@R.query("doc_flatten", """select event_id, '{{"k":' || cast(k as varchar) || ',"tags":["' || event_type || '","x"]}}' doc, cast(cast(value as decimal(18,2)) as varchar) amount, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') ts from {ev}""")
def _(t):
    return schema.doc_flatten(t("ev").select("event_id", F.struct("k", F.array("event_type", F.lit("x")).alias("tags")).alias("doc"), F.col("value").cast("decimal(18,2)").alias("amount"), "ts"))


@R.query("normalize_values", """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') ts, cast(cast(value as decimal(18,2)) as varchar) amount, event_type as raw, strftime(ts, '%Y-%m-%d') as "day" from {ev}""")
def _(t):
    return schema.normalize_values(t("ev").select("event_id", "ts", F.col("value").cast("decimal(18,2)").alias("amount"), F.encode("event_type", "UTF-8").alias("raw"), F.to_date("ts").alias("day")))


def columns(t):
    return t("ev").select(F.col("user_id").cast("string").alias("stream"), F.expr(_CASE(NAMES)).alias("name"), F.expr(_CASE(KINDS)).alias("lake_type"), F.expr("event_id % 6 = 0 and k < 3").alias("primary_key"))


_COLUMNS = f"c as (select cast(user_id as varchar) stream, {_CASE(NAMES)} as name, {_CASE(KINDS)} lake_type, event_id % 6 = 0 and k < 3 primary_key from {{ev}})"


@R.query("suggest_cursor", f"""with {_COLUMNS} select stream, coalesce(arg_min(name, case when lake_type = 'timestamp' then case name when 'updated_at' then 1 when 'modified_at' then 2 when 'created_at' then 4 end end), case when count(*) filter (primary_key) = 1 then max(name) filter (primary_key and lake_type in ('int32', 'int64')) end) cursor_field from c group by 1""")
def _(t):
    return schema.suggest_cursor(columns(t), "postgres")


@R.query("suggest_cursor_docs", f"""with {_COLUMNS} select stream, coalesce(arg_min(name, case when lake_type = 'timestamp' then case name when 'updated_at' then 2 when 'created_at' then 5 end end), max(name) filter (name = '_id')) cursor_field from c group by 1""")
def _(t):
    return schema.suggest_cursor(columns(t), "mongodb")


@R.query("catalog_validate", """with s as (select distinct 'st' || cast(user_id as varchar) stream, user_id % 3 m from {ev} where user_id % 7 <> 0), x as (select event_id, 'st' || cast(user_id as varchar) stream, user_id, case k % 3 when 0 then 'full_load' when 1 then 'incremental' else 'cdc' end as mode, case when k % 5 = 0 then '' when k % 5 = 1 then 'nope' else 'ts' end cur from {ev})
select x.stream, x.mode, case when s.stream is null then 'stream not in catalog' when (m = 0 and x.mode <> 'full_load') or (m = 1 and x.mode = 'cdc') then 'mode not supported' when x.mode = 'incremental' and cur = '' then 'cursor_field missing' else 'cursor_field not in schema' end error
from x left join s using (stream) where s.stream is null or (m = 0 and x.mode <> 'full_load') or (m = 1 and x.mode = 'cdc') or (x.mode = 'incremental' and cur in ('', 'nope'))""")
def _(t):
    stream = F.concat(F.lit("st"), "user_id").alias("stream")
    kinds = F.expr("case user_id % 3 when 0 then array('full_load') when 1 then array('full_load', 'incremental') else array('full_load', 'incremental', 'cdc') end").alias("modes")
    streams = t("ev").filter("user_id % 7 <> 0").select(stream, kinds).distinct()
    chosen = t("ev").select(stream, F.expr("case k % 3 when 0 then 'full_load' when 1 then 'incremental' else 'cdc' end").alias("mode"), F.expr("case when k % 5 = 0 then '' when k % 5 = 1 then 'nope' else 'ts' end").alias("cursor_field"))
    return schema.catalog_validate(chosen, streams, streams.select("stream", F.explode(F.array(F.lit("id"), F.lit("ts"))).alias("name")))


_V = "v1 as (select distinct 'st' || cast(user_id as varchar) stream, 'c' || cast(k % 10 as varchar) as name, 'long' t from {ev} where event_id % 2 = 0), v2 as (select distinct 'st' || cast(user_id as varchar) stream, 'c' || cast(k % 10 as varchar) as name, case when k % 10 = 3 then 'string' else 'long' end t from {ev} where event_id % 2 = 1)"


def versions(t):
    cols = lambda p, kind: t("ev").filter(p).select(F.concat(F.lit("st"), "user_id").alias("stream"), F.concat(F.lit("c"), F.expr("k % 10")).alias("name"), F.expr(kind).alias("type")).distinct()
    return cols("event_id % 2 = 0", "'long'"), cols("event_id % 2 = 1", "case when k % 10 = 3 then 'string' else 'long' end")


@R.query("schema_drift", f"""with {_V} select coalesce(v1.stream, v2.stream) stream, coalesce(v1.name, v2.name) as name, case when v1.t is null then 'added' when v2.t is null then 'dropped' else 'retyped' end as "change", v1.t from_type, v2.t to_type from v1 full join v2 on v1.stream = v2.stream and v1.name = v2.name where v1.t is distinct from v2.t""")
def _(t):
    return schema.schema_drift(*versions(t))


@R.query("column_mapping", f"""with {_V} select v1.stream, v1.name source_column, v1.t source_type, v2.name dest_column, v2.t dest_type from v1 join v2 on v1.stream = v2.stream and v1.name = v2.name""")
def _(t):
    return schema.column_mapping(*versions(t))


@R.query("select_columns", "select event_id, user_id, k from {ev}")
def _(t):
    return schema.select_columns(t("ev").select("event_id", "user_id", "event_type", "k"), ["event_id", "user_id"], ["event_id", "user_id", "event_type"], sync_new=True)


@R.query("sink_type_map", "select cast(event_id as integer) event_id, try_cast(event_type as double) event_type, cast(k as varchar) k, k > 0 flag from {ev}")
def _(t):
    return schema.sink_type_map(t("ev").select("event_id", "event_type", "k", F.col("k").alias("flag")), {"event_id": "int32", "event_type": "float64", "k": "string", "flag": "bool"})
