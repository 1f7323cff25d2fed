"""Queries of sources, sinks, logs and load modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncproof.operators import joins, load, log, versions
from syncproof.plans.fixtures import BASE, Registry
from syncproof.scratch import cut, new_path
from syncproof.sources import connect, files, sinks

R = Registry()
SEQ = ["ingested_at", "seq"]
_CURRENT = """with l as (select *, row_number() over (partition by o_orderkey order by ingested_at desc, seq desc) rn from {orders_log}) """


def at(micros: int):
    return F.timestamp_micros(F.lit(micros).cast("long"))


@R.query("current_state", _CURRENT + "select o_orderkey, o_custkey, o_totalprice, op from l where rn = 1 and op <> 'd'")
def _(t):
    return log.current_state(t("orders_log"), ["o_orderkey"], SEQ, "op").select("o_orderkey", "o_custkey", "o_totalprice", "op")


@R.query("read_table_log", _CURRENT + "select o_orderkey, o_custkey, o_totalprice, op from l where rn = 1 and op <> 'd'")
def _(t):
    rows = t("orders_log")
    path = new_path(rows.sparkSession)
    sinks.write_parquet(rows.filter("op = 'r'"), path, fresh=True)
    sinks.write_parquet(rows.filter("op <> 'r'"), path)
    return files.read_table_log(rows.sparkSession, path, None, ("o_orderkey",), tuple(SEQ), "op").select("o_orderkey", "o_custkey", "o_totalprice", "op")


@R.query("sink_parquet", "select o_orderkey, o_custkey, o_totalprice, op, seq from {orders_log}")
def _(t):
    rows = t("orders_log").select("o_orderkey", "o_custkey", "o_totalprice", "op", "seq")
    path = new_path(rows.sparkSession)
    sinks.write_parquet(rows.filter("seq % 2 = 0"), path, fresh=True)
    sinks.write_parquet(rows.filter("seq % 2 = 1"), path)
    return rows.sparkSession.read.parquet(path)


@R.query("sink_ndjson", "select event_id, event_type, case when event_id % 4 = 0 then null else value end as value from {ev}")
def _(t):
    rows = t("ev").select("event_id", "event_type", F.expr("case when event_id % 4 = 0 then null else value end").alias("value"))
    path = new_path(rows.sparkSession)
    sinks.write_ndjson(rows, path, fresh=True)
    return rows.sparkSession.read.schema("event_id long, event_type string, value double").json(path)


@R.query("sink_merge", _CURRENT + "select o_orderkey, o_custkey, o_totalprice, op from l where rn = 1 and op <> 'd'")
def _(t):
    rows = t("orders_log")
    path = new_path(rows.sparkSession)
    log.merge(rows.filter("op = 'r'"), rows.filter("op <> 'r'"), ["o_orderkey"], SEQ, "op").write.parquet(path)
    return rows.sparkSession.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice", "op")


@R.query("sink_merge_touched", _CURRENT + "select o_orderkey, o_custkey, o_totalprice from l where rn = 1 and op <> 'd'")
def _(t):
    """Three change batches over a bucketed table; the rows are those of its last version."""
    rows = t("orders_log")
    spark, path = rows.sparkSession, new_path(rows.sparkSession)
    first = rows.filter("op = 'r'").select("o_orderkey", "o_custkey", "o_totalprice")
    versions.create(first, path, ["o_orderkey"], 16)
    for kind in ("u", "d", "i"):
        versions.merge_touched(spark, path, first.schema, rows.filter(F.col("op") == kind), ["o_orderkey"], SEQ, "op")
    return versions.read(spark, path, first.schema)


@R.query("src_object_ndjson", """select event_id, event_type, '{{"k":' || cast(k as varchar) || ',"u":[' || cast(user_id as varchar) || ']}}' as props from {ev}""")
def _(t):
    rows = t("ev").select("event_id", "event_type", F.struct("k", F.array("user_id").alias("u")).alias("props"))
    path = new_path(rows.sparkSession)
    rows.write.json(path)
    return files.object_ndjson(rows.sparkSession, path, "event_id long, event_type string, props struct<k:long,u:array<long>>")


@R.query("src_object_csv", "select cast(c_custkey as varchar) c_custkey, c_name, cast(c_nationkey as varchar) c_nationkey, c_mktsegment from {customer}")
def _(t):
    rows = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = new_path(rows.sparkSession)
    rows.write.csv(path, header=True)
    return files.object_csv(rows.sparkSession, path)


@R.query("src_object_incremental", "select event_id, event_type from {ev}")
def _(t):
    rows = t("ev").select("event_id", "event_type")
    path = new_path(rows.sparkSession)
    rows.write.json(path)
    return files.object_incremental(rows.sparkSession, path, "event_id long, event_type string", "2020-01-01T00:00:00")[0]


@R.query("src_redis_kv", """with u as (select user_id, event_id % 4 m, list(k order by event_id) ks, list(distinct k order by k) st, max(k) mk, min(event_id) me from {ev} group by 1, 2)
select 'key:' || cast(user_id as varchar) || ':' || cast(m as varchar) as "key", ['string', 'list', 'set', 'hash'][m + 1] as "type",
case m when 0 then '"v' || cast(mk as varchar) || '"' when 1 then '[' || array_to_string(ks, ',') || ']' when 2 then '[' || array_to_string(st, ',') || ']' else '{{"max":"' || cast(mk as varchar) || '"}}' end as "value", case when mk % 2 = 0 then cast(mk as bigint) else -1 end as ttl from u""")
def _(t):
    g = t("ev").withColumn("m", F.expr("event_id % 4")).groupBy("user_id", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "k"))), lambda x: x["k"]).alias("l"), F.collect_set("k").alias("st"), F.max("k").alias("mk"))
    typed = g.select(F.concat(F.lit("key:"), "user_id", F.lit(":"), "m").alias("key"), F.get(F.array(*map(F.lit, ["string", "list", "set", "hash"])), F.col("m").cast("int")).alias("type"), F.concat(F.lit("v"), "mk").alias("s"), "l", "st", F.create_map(F.lit("max"), F.col("mk").cast("string")).alias("h"), F.expr("case when mk % 2 = 0 then mk end").alias("ttl"))
    gone = typed.select("key", F.lit("none").alias("type"), "s", "l", "st", "h", "ttl")
    return connect.redis_kv(typed.unionByName(gone))


_ENVELOPE = """select cast(user_id % 4 as int) as "partition", event_id as "offset", 'u' || cast(user_id as varchar) as "key",
case event_id % 3 when 0 then '{{"k":' || cast(k as varchar) || '}}' when 1 then '"plain ' || cast(k as varchar) || ' \\"text\\""' else null end as "value", strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as "timestamp",
case when event_id % 2 = 0 then '{{}}' else '{{"a":"' || cast(k as varchar) || '","b":"x"}}' end as headers from {ev}"""


def kafka_rows(t):
    """Events as a topic's messages, in Kafka's columns."""
    header = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value"))
    return t("ev").select(
        F.expr("cast(user_id % 4 as int)").alias("partition"), F.col("event_id").alias("offset"), F.encode(F.concat(F.lit("u"), "user_id"), "UTF-8").alias("key"),
        F.encode(F.expr("""case event_id % 3 when 0 then concat('{"k":', k, '}') when 1 then concat('plain ', k, ' "text"') else '' end"""), "UTF-8").alias("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("event_id") % 2 == 0, F.array().cast("array<struct<key:string,value:binary>>")).otherwise(F.array(header("a", F.lit("first")), header("b", F.lit("x")), header("a", F.col("k").cast("string")))).alias("headers"))


@R.query("kafka_envelope", _ENVELOPE)
def _(t):
    return connect.kafka_envelope(kafka_rows(t))


@R.query("src_kafka_bounded", _ENVELOPE)
def _(t):
    rows = kafka_rows(t)
    path = new_path(rows.sparkSession)
    rows.write.parquet(path)  # a topic kept in files
    return connect.kafka_bounded(rows.sparkSession, "localhost:9092", "events", source="parquet", path=path)


@R.query("src_docs", """select event_id, event_type, case when event_id % 4 = 0 then null else '{{"k":' || cast(k as varchar) || ',"u":[' || cast(user_id as varchar) || ']}}' end as props from {ev}""")
def _(t):
    props = F.expr("case when event_id % 4 = 0 then null else struct(k, array(user_id) as u) end").alias("props")
    rows = t("ev").select("event_id", "event_type", props)
    path = new_path(rows.sparkSession)
    rows.write.json(path)  # an export of a table of documents
    return connect.documents(rows.sparkSession, "dynamodb", "event_id long, event_type string, props struct<k:long,u:array<long>>", path=path)


@R.query("kafka_offset_increment", """with e as (select user_id % 40 p, min(event_id) f, max(event_id) + 1 e from {ev} where user_id % 40 < 35 group by 1), s as (select user_id % 40 p, max(case when event_id % 2 = 0 then event_id else -5 end) o from {ev} where user_id % 40 > 3 group by 1)
select coalesce(e.p, s.p) as "partition", case when e.e is not null then greatest(f, least(coalesce(o, f), e.e)) end as "start", coalesce(e.e, o) as "next" from e full join s on e.p = s.p""")
def _(t):
    p = F.expr("user_id % 40").alias("partition")
    ends = t("ev").filter("user_id % 40 < 35").groupBy(p).agg(F.min("event_id").alias("first"), (F.max("event_id") + 1).alias("end"))
    stored = t("ev").filter("user_id % 40 > 3").groupBy(p).agg(F.max(F.expr("case when event_id % 2 = 0 then event_id else -5 end").cast("long")).alias("offset"))
    return load.offset_increment(ends, stored)


@R.query("inject_metadata", """select o_orderkey, o_totalprice, substr(md5('o_orderkey' || chr(1) || '=' || cast(o_orderkey as varchar)), 1, 16) as _sys_id, 'r' as _sys_op, '2024-01-01 00:00:00.000000' as _sys_ingested_at from {orders}""")
def _(t):
    return log.inject_metadata(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "r", at(BASE)).withColumn("_sys_ingested_at", F.date_format("_sys_ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@R.query("data_columns", "select o_orderkey, o_totalprice from {orders}")
def _(t):
    from syncproof.functions.canonical import data_columns

    rows = log.inject_metadata(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "r", at(BASE))
    return rows.select(*data_columns(rows))


@R.query("id_range_filter", """select o_orderkey, substr(md5('o_orderkey' || chr(1) || '=' || cast(o_orderkey as varchar)), 1, 16) as _sys_id from {orders} where _sys_id >= '40' and _sys_id < 'c0'""")
def _(t):
    rows = log.inject_metadata(t("orders").select("o_orderkey"), ["o_orderkey"], "r", at(BASE)).select("o_orderkey", "_sys_id")
    return log.id_range_filter(rows, "40", "c0")


@R.query("chunk_plan", """with m as (select min(o_orderkey) a, max(o_orderkey) z from {orders}), l as (select unnest(range(a, z + 1, 500)) lo from m), n as (select lo, row_number() over (order by lo) i, count(*) over () c from l)
select cast(0 as bigint) chunk_no, cast(null as bigint) lo, a hi from m union all select i, lo, case when i < c then lo + 500 end from n""")
def _(t):
    return load.chunk_plan(t("orders"), "o_orderkey", 500)


@R.query("chunk_assign", """with m as (select min(o_orderkey) a, max(o_orderkey) z from {orders}), c as (select cast(0 as bigint) chunk_no union all select unnest(range(1, (z - a) // 500 + 2)) from m)
select chunk_no, (select count(*) from {orders}, m where (o_orderkey - a) // 500 + 1 = chunk_no) n_rows from c""")
def _(t):
    return load.chunk_assign(t("orders"), load.chunk_plan(t("orders"), "o_orderkey", 500), "o_orderkey")


_OVER = "cast((select count(*) from (select 1 from {from_} group by {by} having count(*) > 1000)) as int)"
_SPARSE = _OVER.format(from_="{lineitem} where l_orderkey % 10 > 0", by="cast(l_orderkey as hugeint) * l_orderkey * 1000003 - l_partkey * 7")


@R.query("equi_depth", f"""select 'sparse' kind, count(*) n_rows, {_SPARSE} too_large, 0 lost from {{lineitem}} union all select 'text', count(*), {_OVER.format(from_="{part}", by="p_name")}, 0 from {{part}} union all select 'pair', count(*), {_OVER.format(from_="{lineitem}", by="l_orderkey, l_linenumber")}, 0 from {{lineitem}}""")
def _(t):
    """Chunks of a sparse wide key with nulls, of a text key and of two columns: all rows, over twice the target only single keys that have as many, each row in one chunk."""
    lines = t("lineitem").selectExpr("case when l_orderkey % 10 > 0 then cast(l_orderkey as decimal(19,0)) * l_orderkey * 1000003 - l_partkey * 7 end k", "l_orderkey", "l_linenumber")
    out = None
    for kind, rows, keys in (("sparse", lines, ["k"]), ("text", t("part"), ["p_name"]), ("pair", lines, ["l_orderkey", "l_linenumber"])):
        plan = cut(load.equi_depth(rows, keys, 500))
        total = rows.count()
        one = plan.filter("chunk_no >= 0").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("whole"), F.count_if(F.col("n_rows") > 1000).cast("int").alias("too_large"))
        nulls = plan.filter("chunk_no < 0").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("nulls"))
        found = one.join(nulls).select(F.lit(kind).alias("kind"), (F.col("whole") + F.col("nulls")).alias("n_rows"), "too_large", (F.lit(total) - F.col("whole") - F.col("nulls")).cast("int").alias("lost"))
        out = found if out is None else out.unionByName(found)
    return out


@R.query("asof_join", """with p as (select user_id, epoch_us(ts) paid_at, max(event_id) paid_by from {ev} where event_type = 'purchase' group by all), e as (select event_id, user_id, epoch_us(ts) as at from {ev} where event_type <> 'purchase')
select e.event_id, e.user_id, p.paid_by, p.paid_at from e asof left join p on e.user_id = p.user_id and e.at >= p.paid_at""")
def _(t):
    ev = t("ev").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    paid = ev.filter("event_type = 'purchase'").groupBy("user_id", F.col("at").alias("paid_at")).agg(F.max("event_id").alias("paid_by"))
    return joins.asof_join(ev.filter("event_type <> 'purchase'").select("event_id", "user_id", "at"), paid, "at", "paid_at", ["user_id"]).select("event_id", "user_id", "paid_by", "paid_at")


@R.query("interval_join", """with i as (select event_id interval_id, user_id % 7 g, epoch_us(ts) lo, epoch_us(ts) + k * 60000000 hi from {ev} where event_type = 'error'), e as (select event_id, user_id % 7 g, epoch_us(ts) as at from {ev} where event_type = 'click')
select i.interval_id, count(*) n, sum(e.event_id) ids from i join e on e.g = i.g and e.at >= i.lo and e.at < i.hi group by 1""")
def _(t):
    ev = t("ev").select("event_id", "event_type", "k", F.expr("user_id % 7").alias("g"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    spans = ev.filter("event_type = 'error'").select(F.col("event_id").alias("interval_id"), "g", F.col("at").alias("lo"), (F.col("at") + F.col("k") * 60_000_000).alias("hi"))
    met = joins.interval_join(ev.filter("event_type = 'click'").select("event_id", "g", "at"), spans, "at", "lo", "hi", ["g"], width=60_000_000, salts=4)
    return met.groupBy("interval_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@R.query("chunk_remaining", """with m as (select min(o_orderkey) a, max(o_orderkey) z from {orders}), c as (select cast(0 as bigint) chunk_no union all select unnest(range(1, (z - a) // 500 + 2)) from m) select chunk_no from c where chunk_no % 2 = 1""")
def _(t):
    plan = load.chunk_plan(t("orders"), "o_orderkey", 500)
    return load.chunk_remaining(plan, plan.filter("chunk_no % 2 = 0")).select("chunk_no")


@R.query("full_load", "select o_orderkey, o_totalprice, 'r' as _sys_op from {orders}")
def _(t):
    rows = t("orders").select("o_orderkey", "o_totalprice")
    path, ledger = new_path(rows.sparkSession), new_path(rows.sparkSession)
    load.full_load(rows, "o_orderkey", path, ledger, at(BASE), step=50_000)
    load.full_load(rows, "o_orderkey", path, ledger, at(BASE), step=50_000)  # finds nothing left to do
    return rows.sparkSession.read.parquet(path).select("o_orderkey", "o_totalprice", "_sys_op")


@R.query("max_cursor", "select strftime(max(o_orderdate), '%Y-%m-%d') as \"cursor\" from {orders}")
def _(t):
    return load.max_cursor(t("orders"), "o_orderdate").select(F.date_format("cursor", "yyyy-MM-dd").alias("cursor"))


@R.query("incremental_load", "select o_orderkey, o_totalprice from {orders} where o_orderdate > timestamp '1998-01-01'")
def _(t):
    return load.incremental(t("orders"), "o_orderdate", "1998-01-01").select("o_orderkey", "o_totalprice")


@R.query("incremental_ledger", "select event_id, user_id from {ev}")
def _(t):
    rows = t("ev").select("event_id", "user_id", "ts")
    path, ledger = new_path(rows.sparkSession), new_path(rows.sparkSession)
    load.incremental_load(rows.filter("ts < timestamp'2024-01-15'"), ["event_id"], "event_id", path, ledger, at(BASE))
    load.incremental_load(rows, ["event_id"], "event_id", path, ledger, at(BASE))
    return rows.sparkSession.read.parquet(path).select("event_id", "user_id")


@R.query("cdc_apply", """select event_id, 'public.s' || cast(event_id % 4 as varchar) as stream, case event_type when 'click' then 'u' when 'error' then 'd' else 'i' end as _sys_op from {ev} where event_id % 4 < 2""")
def _(t):
    changes = t("ev").select("event_id", F.concat(F.lit("public.s"), F.expr("event_id % 4")).alias("stream"), F.expr("case event_type when 'click' then 'update' when 'error' then 'delete' when 'view' then 'insert' else 'other' end").alias("kind"))
    chosen = changes.sparkSession.createDataFrame([("public.s0",), ("public.s1",)], "stream string")
    return log.cdc_apply(changes, chosen).select("event_id", "stream", "_sys_op")


@R.query("cdc_images", """select event_id, case event_type when 'click' then 'update' when 'error' then 'delete' else 'insert' end as kind, case when event_type = 'error' then k else k + 1 end as k from {ev} where event_type <> 'signup'""")
def _(t):
    image = lambda c: F.struct(F.expr(c).alias("k"))
    changes = t("ev").select("event_id", F.expr("case event_type when 'click' then 'u' when 'error' then 'd' when 'signup' then 'drop' else 'c' end").alias("op"), image("k").alias("before"), image("k + 1").alias("after"))
    return log.cdc_images(changes).select("event_id", "kind", "data.k")


@R.query("cdc_unavailable_patch", """with x as (select event_id, user_id, case when k % 5 = 0 then '__same__' when k % 7 = 0 then null else 'v' || cast(k as varchar) end big from {ev}),
g as (select *, count(case when big is distinct from '__same__' then 1 end) over (partition by user_id order by event_id) grp from x)
select event_id, max(case when big is distinct from '__same__' then big end) over (partition by user_id, grp) big from g""")
def _(t):
    rows = t("ev").select("event_id", "user_id", F.expr("case when k % 5 = 0 then '__same__' when k % 7 = 0 then null else concat('v', k) end").alias("big"))
    return log.cdc_unavailable_patch(rows, ["big"], "__same__", ["user_id"], ["event_id"]).select("event_id", "big")


@R.query("bounded_position", """select event_id from {ev} where 'bin.' || lpad(cast(event_id // 100 as varchar), 6, '0') || lpad(cast(event_id % 100 as varchar), 3, '0') > 'bin.000010050' and 'bin.' || lpad(cast(event_id // 100 as varchar), 6, '0') || lpad(cast(event_id % 100 as varchar), 3, '0') <= 'bin.000060007'""")
def _(t):
    rows = t("ev").select("event_id", F.concat(F.lit("bin."), F.lpad(F.expr("cast(event_id div 100 as string)"), 6, "0")).alias("file"), F.expr("event_id % 100").alias("pos"))
    return log.bounded_position(rows, ("bin.000010", 50), ("bin.000060", 7)).select("event_id")


@R.query("cdc_converge", _CURRENT + "select o_orderkey, o_totalprice from l where rn = 1 and op <> 'd'")
def _(t):
    rows = t("orders_log")
    changes = rows.filter("op <> 'r'").select("o_orderkey", "o_totalprice", "op", "ingested_at", "seq")
    return log.cdc_converge(rows.filter("op = 'r'"), changes, keys=["o_orderkey"], order=SEQ, op="op").select("o_orderkey", "o_totalprice")


@R.query("backfill_range", """select o_orderkey, case when o_orderkey >= 1000 and o_orderkey < 3000 then s.o_totalprice else coalesce(d.o_totalprice, s.o_totalprice) end as o_totalprice from {orders_dst} d full join {orders} s using (o_orderkey)
where d.o_orderkey is not null or (o_orderkey >= 1000 and o_orderkey < 3000)""")
def _(t):
    repaired = load.backfill_range(t("orders"), "o_orderkey", 1000, 3000, at(BASE + 10_000_000))
    landed = log.inject_metadata(t("orders_dst"), ["o_orderkey"], "r", at(BASE))
    return log.current_state(landed.unionByName(repaired), order=["_sys_ingested_at", "_sys_op"]).select("o_orderkey", "o_totalprice")


@R.query("backfill_since", "select o_orderkey, o_totalprice, 'u' as _sys_op from {orders} where o_orderdate > timestamp '1999-06-01'")
def _(t):
    return load.backfill_since(t("orders"), "o_orderdate", "1999-06-01", ["o_orderkey"], at(BASE)).select("o_orderkey", "o_totalprice", "_sys_op")


@R.query("backfill_window", "select o_orderkey, o_totalprice, 'u' as _sys_op from {orders} where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1998-02-01'")
def _(t):
    return load.backfill_window(t("orders"), "o_orderdate", "1998-01-01", "1998-02-01", ["o_orderkey"], at(BASE)).select("o_orderkey", "o_totalprice", "_sys_op")
