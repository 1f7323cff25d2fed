"""Queries of digests and differences: orders as the source, orders_dst as a damaged copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncproof.functions import canonical as C
from syncproof.operators import diff, digest, tree
from syncproof.plans.fixtures import Registry
from syncproof.scratch import cut, new_path
from syncproof.sources.sinks import write_result, write_verified

R = Registry()
KEY = ["o_orderkey"]
MD5 = {"method": "md5", "double_scale": 2}

_CANON = " || chr(2) || ".join(f"'{c}' || chr(1) || coalesce('=' || {t}, '-')" for c, t in [
    ("o_custkey", "cast(o_custkey as varchar)"),
    ("o_orderdate", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')"),
    ("o_orderkey", "cast(o_orderkey as varchar)"),
    ("o_orderpriority", "o_orderpriority"),
    ("o_orderstatus", "o_orderstatus"),
    ("o_totalprice", "cast(cast(o_totalprice as decimal(38,2)) as varchar)"),
])
_HASH = f"cast('0x' || substr(md5({_CANON}), 1, 15) as bigint)"
_ID = "substr(md5('o_orderkey' || chr(1) || coalesce('=' || cast(o_orderkey as varchar), '-')), 1, 16)"
_SUM = lambda h: f"cast(coalesce(sum({h}), 0) % 18446744073709551616 as varchar)"
_BOTH = f"""with s as (select {_ID} id, {_HASH} h, o_orderkey from {{orders}}), d as (select {_ID} id, {_HASH} h, o_orderkey from {{orders_dst}}),
b as (select coalesce(s.id, d.id) id, s.h sh, d.h dh, coalesce(s.o_orderkey, d.o_orderkey) k, case when s.h is null then 'missing_in_source' when d.h is null then 'missing_in_destination' when s.h <> d.h then 'changed' else 'same' end kind from s full join d on s.id = d.id)
"""


def both(t):
    return diff.compared(t("orders"), t("orders_dst"), KEY, **MD5)


@R.query("record_id", f"select o_orderkey, {_ID} as record_id from {{orders}}")
def _(t):
    return t("orders").select("o_orderkey", C.record_id(t("orders"), KEY).alias("record_id"))


@R.query("row_digest", f"select o_orderkey, {_HASH} as row_hash from {{orders}}")
def _(t):
    return t("orders").select("o_orderkey", C.row_hash(t("orders"), **MD5).alias("row_hash"))


@R.query("table_digest", f"select count(*) n_rows, {_SUM(_HASH)} checksum from {{orders}}")
def _(t):
    return digest.table_digest(t("orders"), **MD5)


@R.query("digest_compare", f"""with a as (select count(*) n, {_SUM(_HASH)} c from {{orders}}), b as (select count(*) n, {_SUM(_HASH)} c from {{orders_dst}})
select a.n source_rows, a.c source_checksum, b.n dest_rows, b.c dest_checksum, a.n = b.n and a.c = b.c as "match" from a, b""")
def _(t):
    return digest.digest_compare(digest.table_digest(t("orders"), **MD5), digest.table_digest(t("orders_dst"), **MD5))


@R.query("digest_by_group", f"select o_orderkey // 500 as \"range\", count(*) n_rows, {_SUM(_HASH)} checksum from {{orders}} group by 1")
def _(t):
    return digest.digest_by_group(t("orders"), F.floor(F.col("o_orderkey") / 500), **MD5)


@R.query("verify_stream", _BOTH + f"""select count(*) filter (kind <> 'same') = 0 as "match", count(sh) source_rows, count(dh) dest_rows, {_SUM('sh')} source_checksum, {_SUM('dh')} dest_checksum,
count(*) filter (kind = 'missing_in_destination') missing_in_destination, count(*) filter (kind = 'missing_in_source') missing_in_source, count(*) filter (kind = 'changed') changed from b""")
def verify(t):
    return diff.verify_stream(both(t))


#: lineitem by order, whose ids repeat, against a copy with rows doubled, dropped and changed.
_REPEATS = """with s as (select l_orderkey k, cast(l_quantity as bigint) q, l_returnflag f from {lineitem}),
d as (select k, q, f from s where k % 7 <> 0 union all select k, q, f from s where k % 11 = 0 union all select k, q + 1, f from s where k % 7 = 0 and q % 3 <> 0 union all select k, 0, 'X' from s where k % 13 = 0),
x as (select k, count(*) n from (select * from s except all select * from d) group by k), y as (select k, count(*) n from (select * from d except all select * from s) group by k),
b as (select coalesce(x.k, y.k) k, coalesce(x.n, 0) a, coalesce(y.n, 0) b from x full join y on x.k = y.k)
"""


def repeats(t):
    s = t("lineitem").selectExpr("l_orderkey k", "cast(l_quantity as bigint) q", "l_returnflag f")
    d = s.filter("k % 7 <> 0").unionAll(s.filter("k % 11 = 0")).unionAll(s.filter("k % 7 = 0 and q % 3 <> 0").selectExpr("k", "q + 1", "f")).unionAll(s.filter("k % 13 = 0").selectExpr("k", "cast(0 as bigint)", "'X'"))
    return s, d


@R.query("verify_repeats", _REPEATS + """select count(*) = 0 as "match", (select count(*) from s) source_rows, (select count(*) from d) dest_rows, cast(sum(a - least(a, b)) as bigint) missing_in_destination, cast(sum(b - least(a, b)) as bigint) missing_in_source, cast(sum(least(a, b)) as bigint) changed from b""")
def _(t):
    return diff.verify_stream(diff.compared(*repeats(t), ["k"])).drop("source_checksum", "dest_checksum")


@R.query("diff_repeats", _REPEATS + """select k, 'changed' kind, least(a, b) n from b where least(a, b) > 0 union all select k, 'missing_in_destination', a - least(a, b) from b where a > b union all select k, 'missing_in_source', b - least(a, b) from b where b > a""")
def _(t):
    return diff.diff_rows(diff.compared(*repeats(t), ["k"])).select("key.k", "kind", "n")


@R.query("diff_rows", _BOTH + "select id, kind, k as o_orderkey from b where kind <> 'same'")
def _(t):
    return diff.diff_rows(both(t)).select("id", "kind", F.col("key.o_orderkey").alias("o_orderkey"))


@R.query("diff_by_prefix", _BOTH + "select id, kind, k as o_orderkey from b where kind <> 'same'")
def _(t):
    return diff.diff_by_prefix(t("orders"), t("orders_dst"), KEY, **MD5).select("id", "kind", F.col("key.o_orderkey").alias("o_orderkey"))


@R.query("diff_columns", """with j as (select s.*, d.o_totalprice dp, d.o_custkey dc, d.o_orderstatus ds, d.o_orderdate dd, d.o_orderpriority dr from {orders} s join {orders_dst} d using (o_orderkey))
select "column", n from (select 'o_totalprice' "column", count(*) filter (o_totalprice is distinct from dp) n from j union all select 'o_custkey', count(*) filter (o_custkey is distinct from dc) from j
union all select 'o_orderstatus', count(*) filter (o_orderstatus is distinct from ds) from j union all select 'o_orderdate', count(*) filter (o_orderdate is distinct from dd) from j union all select 'o_orderpriority', count(*) filter (o_orderpriority is distinct from dr) from j) where n > 0""")
def _(t):
    return diff.diff_columns(t("orders"), t("orders_dst"), KEY)


@R.query("diff_ranges", _BOTH.replace("with s as", "with recursive s as") + """, r as (select id, kind, row_number() over (order by id) - 1 rk from b), n as (select count(*) n from r),
t(lo, hi) as (select 0, n from n union all select x.lo, x.hi from t, lateral (select t.lo as lo, (t.lo + t.hi) // 2 as hi union all select (t.lo + t.hi) // 2, t.hi) x where t.hi - t.lo > 100),
l as (select lo, hi from t where hi - lo <= 100)
select min(id) range_min, max(id) range_max, count(*) filter (kind <> 'same') n from r join l on rk >= lo and rk < hi group by lo having count(*) filter (kind <> 'same') > 0""")
def _(t):
    return diff.diff_ranges(both(t))


@R.query("diff_samples", _BOTH + "select id, kind, cast(k as varchar) pk from b where kind <> 'same' order by id limit 20")
def _(t):
    return diff.diff_samples(both(t), KEY)


_CHANGED = f"with x as (select {_ID} id, {_HASH} h from {{orders_dst}})"


def changed_tree(t, spark):
    """The stored tree of orders after the changes that make it orders_dst."""
    path = new_path(spark)
    tree.store(tree.build(t("orders"), KEY, 3, **MD5), path)
    both = [digest.with_row_digest(t(n), KEY, **MD5).select("id", "hash") for n in ("orders", "orders_dst")]
    old, new = both[0].join(both[1], ["id", "hash"], "left_anti"), both[1].join(both[0], ["id", "hash"], "left_anti")
    return tree.apply_changes(tree.load(spark, path), old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1))), 3)


@R.query("digest_tree", _CHANGED + " select cast(l as int) as level, substr(id, 1, l) prefix, count(*) n_rows, cast(sum(h) % 18446744073709551616 as varchar) checksum from x, range(1, 4) z(l) group by 1, 2")
def _(t):
    return changed_tree(t, t("orders").sparkSession).select("level", "prefix", "n_rows", F.col("checksum").cast("string").alias("checksum"))


@R.query("diff_by_tree", _BOTH + "select id, kind, k as o_orderkey from b where kind <> 'same'")
def _(t):
    spark = t("orders").sparkSession
    a, b = new_path(spark), new_path(spark)
    tree.store(tree.build(t("orders"), KEY, 3, **MD5), a)
    tree.store(changed_tree(t, spark), b)
    return tree.diff_by_tree(t("orders"), t("orders_dst"), tree.load(spark, a), tree.load(spark, b), KEY, 3, **MD5).select("id", "kind", F.col("key.o_orderkey").alias("o_orderkey"))


@R.query("write_verified", f"select count(*) source_rows, count(*) dest_rows, {_SUM(_HASH)} source_checksum, {_SUM(_HASH)} dest_checksum, true as \"match\", count(*) - count(o_orderkey) key_nulls from {{orders}}")
def _(t):
    rows = t("orders")
    return write_verified(rows, new_path(rows.sparkSession), **MD5).withColumn("key_nulls", F.col("nulls")["o_orderkey"]).drop("nulls")


@R.query("id_union", f"select {_ID} id from {{orders}} union select {_ID} from {{orders_dst}}")
def _(t):
    ids = lambda n: t(n).select(C.record_id(t(n), KEY).alias("id"))
    return diff.id_union(ids("orders"), ids("orders_dst"))


@R.query("diff_findings", _BOTH + """select min(id) range_min, max(id) range_max, count(*) n, array_to_string(list(cast(k as varchar) order by id)[1:20], ',') sample_pks from b where kind <> 'same' group by substr(id, 1, 2)""")
def _(t):
    return diff.diff_findings(both(t), KEY).withColumn("sample_pks", F.array_join("sample_pks", ","))


@R.query("write_result", f"select count(*) n_rows, {_SUM(_HASH)} checksum from {{orders}}")
def _(t):
    return write_result(cut(t("orders")), "md5", 2)


@R.query("diff_cells", """with s as (select o_orderkey, unnest(['o_custkey', 'o_orderpriority', 'o_orderstatus', 'o_totalprice']) "column", unnest([cast(o_custkey as varchar), o_orderpriority, o_orderstatus, cast(cast(o_totalprice as decimal(38,2)) as varchar)]) v from {orders}),
d as (select o_orderkey, unnest(['o_custkey', 'o_orderpriority', 'o_orderstatus', 'o_totalprice']) "column", unnest([cast(o_custkey as varchar), o_orderpriority, o_orderstatus, cast(cast(o_totalprice as decimal(38,2)) as varchar)]) v from {orders_dst})
select o_orderkey, "column", s.v source_value, d.v dest_value from s join d using (o_orderkey, "column") where s.v is distinct from d.v""")
def _(t):
    cells = lambda n: diff.values_as_text(t(n).drop("o_orderdate"), KEY, 2)
    s, d = cells("orders").withColumnRenamed("value", "source_value"), cells("orders_dst").withColumnRenamed("value", "dest_value")
    return s.join(d, [*KEY, "column"]).filter(~F.col("source_value").eqNullSafe(F.col("dest_value")))
