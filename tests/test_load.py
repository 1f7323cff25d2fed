import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from syncproof.operators import diff, load, log
from syncproof.sources import connect, files, sinks



def now():
    return F.lit(datetime(2024, 1, 1)).cast("timestamp")


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="syncproof-test-")


def table(spark, ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, val string")


def plan(df):
    return [(r.chunk_no, r.lo, r.hi) for r in df.orderBy("chunk_no").collect()]


def test_chunk_plan(spark):
    assert plan(load.chunk_plan(table(spark, range(1, 8)), "id", 3)) == [(0, None, 1), (1, 1, 4), (2, 4, 7), (3, 7, None)]
    assert plan(load.chunk_plan(table(spark, []).limit(0), "id", 3)) == [(0, None, None)]


def test_chunk_step():
    assert load.chunk_step(1000, 10) == 50_000
    assert load.chunk_step(1000, 10, target_mb=1) == 1000
    assert load.chunk_step(1_000_000, 1_000_000, target_mb=1) == 4096


def test_resume_loads_each_row_once(spark, folder):
    rows = table(spark, range(1, 7))
    path, ledger = f"{folder}/out", f"{folder}/ledger"
    load.chunk_plan(rows, "id", 2).coalesce(1).write.parquet(f"{ledger}/plan")
    spark.createDataFrame([(0,), (1,)], "chunk_no long").write.parquet(f"{ledger}/done")  # died after the second chunk
    log.inject_metadata(rows.filter("id < 3"), ["id"], "r", now()).write.parquet(path)
    done = load.full_load(rows, "id", path, ledger, now(), step=2)
    assert done.count() == 2
    got = spark.read.parquet(path)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 5, 6]
    assert load.full_load(rows, "id", path, ledger, now(), step=2).count() == 0
    assert spark.read.parquet(path).count() == 6


def test_incremental(spark, folder):
    rows = spark.createDataFrame([(i, i * 10) for i in range(1, 7)], "id long, at long")
    args = (["id"], "at", f"{folder}/out", f"{folder}/ledger", now())
    assert load.incremental_load(rows.filter("id <= 4"), *args) == "40"
    assert load.incremental_load(rows, *args) == "60"
    assert load.incremental_load(rows, *args) == "60"
    assert spark.read.parquet(f"{folder}/out").count() == 6


def test_null_and_equal_cursors_are_not_read_again(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, 11)], "id long, at long")
    assert [r.id for r in load.incremental(rows, "at", 10).collect()] == [4]
    assert sorted(r.id for r in load.incremental(rows, "at", 10, inclusive=True).collect()) == [1, 2, 4]
    assert load.incremental(rows, "at").count() == 4


def test_offsets(spark):
    ends = spark.createDataFrame([(0, 5, 10), (1, 0, 4), (2, 3, 9)], "partition int, first long, end long")
    stored = spark.createDataFrame([(0, 2), (1, 99), (7, 5)], "partition int, offset long")
    got = {r.partition: (r.start, r.next) for r in load.offset_increment(ends, stored).collect()}
    assert got == {0: (5, 10), 1: (4, 4), 2: (3, 9), 7: (None, 5)}


def test_changes_over_a_snapshot(spark):
    snapshot = log.inject_metadata(table(spark, [1, 2, 3]), ["id"], "r", now()).withColumn("_sys_seq", F.lit(0))
    changes = spark.createDataFrame([(4, "v4", "insert", 1), (1, "v1b", "update", 2), (2, None, "delete", 3)], "id long, val string, kind string, n int")
    coded = log.cdc_apply(changes.withColumn("stream", F.lit("s")), spark.createDataFrame([("s",)], "stream string"))
    replay = log.inject_metadata(coded.select("id", "val", "_sys_op", "n"), ["id"], F.col("_sys_op"), now()).withColumnRenamed("n", "_sys_seq")
    both = snapshot.unionByName(replay, allowMissingColumns=True)
    assert {r._sys_op: r.n for r in both.groupBy("_sys_op").agg(F.count("*").alias("n")).collect()} == {"r": 3, "i": 1, "u": 1, "d": 1}
    assert sorted((r.id, r.val) for r in log.cdc_converge(snapshot, replay).collect()) == [(1, "v1b"), (3, "v3"), (4, "v4")]


def test_latest_wins_and_deletes_drop(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0, 0, 100000), "r", 1, 0), ("a", datetime(2024, 1, 1, 0, 0, 0, 120000), "u", 2, 1), ("b", datetime(2024, 1, 1), "r", 1, 2), ("b", datetime(2024, 1, 1), "d", None, 3)], "_sys_id string, _sys_ingested_at timestamp, _sys_op string, v long, _sys_seq long")
    assert [(r._sys_id, r.v) for r in log.current_state(rows).collect()] == [("a", 2)]


def test_merge(spark):
    target = table(spark, [1, 2, 3])
    updates = spark.createDataFrame([(2, "x", "u", 1), (3, None, "d", 2), (9, "n", "i", 3), (2, "y", "u", 4)], "id long, val string, _sys_op string, seq long")
    assert sorted((r.id, r.val) for r in log.merge(target, updates, ["id"], ["seq"]).collect()) == [(1, "v1"), (2, "y"), (9, "n")]


def test_backfill_repairs(spark):
    source = table(spark, [1, 2, 3])
    landed = log.inject_metadata(source.withColumn("val", F.when(F.col("id") == 2, "bad").otherwise(F.col("val"))), ["id"], "r", now()).withColumn("_sys_seq", F.lit(0))
    fixed = load.backfill_range(source, "id", 2, 3, now()).withColumn("_sys_seq", F.lit(1))
    assert not diff.verify_stream(diff.compared(source, log.current_state(landed), ["id"])).first().match
    assert diff.verify_stream(diff.compared(source, log.current_state(landed.unionByName(fixed)), ["id"])).first().match


def test_jdbc_ranges_and_whole(spark):
    url, props = "jdbc:derby:memory:syncproof;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    table(spark, range(1, 11)).write.mode("overwrite").jdbc(url, "widgets", properties=props)
    got = connect.jdbc_ranges(spark, url, "widgets", '"id"', [(None, 3), (3, 5), (5, None)], **props)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(r.id for r in got.collect()) == list(range(1, 11))
    assert connect.jdbc_full(spark, url, "widgets", **props).count() == 10


def test_csv_short_record_fails(spark, folder):
    from pathlib import Path

    Path(folder, "a.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        files.object_csv(spark, folder).collect()


def test_torn_line_is_dropped(spark, folder):
    from pathlib import Path

    Path(folder, "a.json").write_text('{"_sys_id":"a","_sys_ingested_at":"2024-01-01T00:00:00Z","_sys_op":"r","_sys_seq":1}\n{"_sys_id":"b","_sys_ing')
    got = files.read_table_log(spark, folder, "_sys_id string, _sys_ingested_at timestamp, _sys_op string, _sys_seq long")
    assert [r._sys_id for r in got.collect()] == ["a"]


def test_object_watermark(spark, folder):
    from pathlib import Path

    Path(folder, "a.json").write_text('{"id":1}\n')
    rows, mark = files.object_incremental(spark, folder, "id long")
    assert rows.count() == 1 and mark.first().watermark is not None
    assert files.object_incremental(spark, folder, "id long", "2999-01-01T00:00:00")[0].count() == 0


def test_sinks_read_back(spark, folder):
    rows = spark.createDataFrame([(1, None, "a"), (2, 2.5, "b")], "id long, x double, t string")
    sinks.write_parquet(rows, f"{folder}/p", fresh=True)
    sinks.write_ndjson(rows, f"{folder}/n", fresh=True)
    p, n = spark.read.parquet(f"{folder}/p"), spark.read.schema(rows.schema).json(f"{folder}/n")
    assert sinks.write_result(p).first() == sinks.write_result(n).first() == sinks.write_result(rows).first()
    assert '"x":null' in "".join(r.value for r in spark.read.text(f"{folder}/n").collect())
    updates = spark.createDataFrame([(2, 9.0, "c", 2, "u")], "id long, x double, t string, seq int, _sys_op string")
    sinks.write_merged(rows.withColumns({"seq": F.lit(1), "_sys_op": F.lit("r")}), updates, f"{folder}/m", ["id"], ["seq"])
    assert sorted((r.id, r.t) for r in spark.read.parquet(f"{folder}/m").collect()) == [(1, "a"), (2, "c")]


def test_a_load_that_dies_goes_on_after_its_last_range(spark, folder, monkeypatch):
    source, calls, real = table(spark, range(1, 101)), [], load.inject_metadata

    def dying(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("dead")
        return real(*args)

    monkeypatch.setattr(load, "inject_metadata", dying)
    with pytest.raises(RuntimeError, match="dead"):
        load.full_load(source, "id", f"{folder}/out", f"{folder}/ledger", now(), step=10, commits=5)
    assert 0 < spark.read.parquet(f"{folder}/out").count() < 100
    load.full_load(source, "id", f"{folder}/out", f"{folder}/ledger", now(), step=10, commits=5)
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(1, 101))
    assert load.full_load(source, "id", f"{folder}/out", f"{folder}/ledger", now()).count() == 0


def test_a_change_group_without_changes_copies_once(spark, folder):
    changes = spark.createDataFrame([(2, "new", "u", 7)], "id long, val string, op string, at long")
    args = (["id"], "at", f"{folder}/out", f"{folder}/ledger", now())
    assert load.cdc_group(table(spark, [1, 2]), changes.limit(0), *args) is None
    assert load.cdc_group(table(spark, [1, 2]), changes, *args) == 7
    assert load.cdc_group(table(spark, [1, 2]), changes, *args) == 7
    rows = spark.read.parquet(f"{folder}/out")
    assert rows.count() == 3 and sorted((r.id, r.val) for r in log.current_state(rows, ["id"], ["_sys_seq"]).collect()) == [(1, "v1"), (2, "new")]


@pytest.mark.parametrize("at", ["aside", "moved"])
def test_a_load_that_dies_between_write_and_ledger(spark, folder, monkeypatch, at):
    """A range lies aside, or in the table already, but is not entered: no row comes twice, and the load is verified."""
    source = table(spark, range(1, 101)).unionByName(spark.createDataFrame([(None, "no key"), (None, "nor here")], "id long, val string"))
    real, calls = load._Files.take_in, []

    def dying(self, *args):
        calls.append(args)
        if at == "moved":
            real(self, *args)
        if len(calls) == 2:
            raise RuntimeError("dead")
        if at == "aside":
            real(self, *args)

    monkeypatch.setattr(load._Files, "take_in", dying)
    args = (source, "id", f"{folder}/out", f"{folder}/ledger", now())
    with pytest.raises(RuntimeError, match="dead"):
        load.full_load(*args, step=10, commits=5, parallel=1)
    monkeypatch.undo()
    r = load.load_verified(*args, ["id", "val"], step=10, commits=3, keys=["id"]).first()
    assert (r.source_rows, r.dest_rows, r.match) == (102, 102, True)
    assert load.full_load(*args).count() == 0 and spark.read.parquet(f"{folder}/out").count() == 102


def test_sparse_keys(spark, folder):
    for ids in ([1, 10**18], [-9 * 10**18, 9 * 10**18], [-9 * 10**18, 0, 5, 9 * 10**18]):
        rows = table(spark, ids)
        for step in (50_000, 10**18):
            chunks = load.chunk_plan(rows, "id", step)
            got = {r.chunk_no: r.n_rows for r in load.chunk_assign(rows, chunks, "id").collect()}
            assert sum(got.values()) == len(ids)
            found = plan(chunks)
            assert found[0][1] is None and found[-1][2] is None and [x[2] for x in found[:-1]] == [x[1] for x in found[1:]]
            want = {no: sum((lo is None or i >= lo) and (hi is None or i < hi) for i in ids) for no, lo, hi in found}
            assert got == want
    path = f"{folder}/out"
    load.full_load(table(spark, [1, 10**18]), "id", path, f"{folder}/ledger", now())
    assert spark.read.parquet(path).count() == 2


def test_chunk_width_by_target_size(spark, folder):
    load.full_load(table(spark, range(0, 20_000, 2)), "id", f"{folder}/out", f"{folder}/ledger", now(), target_mb=1)
    assert spark.read.parquet(f"{folder}/ledger/plan").count() == 4 and spark.read.parquet(f"{folder}/out").count() == 10_000


def test_equal_depth_chunks_cover_and_reach_the_scan(spark, folder):
    rows = spark.createDataFrame([(i % 50, f"k{i * 7919 % 1000:04}", i) for i in range(3000)] + [(None, "x", -1), (3, None, -2)], "a long, b string, v long")
    rows.write.parquet(f"{folder}/t")
    rows = spark.read.parquet(f"{folder}/t")
    chunks = load.equi_depth(rows, ["a", "b"], 200).collect()
    seen = []
    for c in chunks:
        if c.chunk_no < 0:
            assert c.n_rows == 2
            continue
        part = load.chunk_rows(rows, c)
        got = [r.v for r in part.collect()]
        assert len(got) == c.n_rows <= 400
        seen += got
    assert sorted(seen) == list(range(3000)) and len(chunks) > 8
    plan_text = load.chunk_rows(rows, [c for c in chunks if c.lo is not None][0])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(a," in plan_text
    with pytest.raises(ValueError):
        load.chunk_rows(rows, [c for c in chunks if c.chunk_no < 0][0])
    assert load.equi_depth(rows.limit(0), ["b"], 10).count() == 0


def test_a_key_of_many_rows_is_a_chunk_of_its_own(spark):
    sizes = {0: 30, 1: 500, 2: 90, 3: 99, 4: 101, 5: 250, 6: 99, 7: 1}
    rows = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "k long")
    chunks = load.equi_depth(rows, ["k"], 100).orderBy("chunk_no").collect()
    members = [[k for k in sizes if (c.lo is None or k >= c.lo.k) and (c.hi is None or k < c.hi.k)] for c in chunks]
    assert sum(members, []) == list(sizes) and [c.n_rows for c in chunks] == [sum(sizes[k] for k in m) for m in members]
    assert all(len(m) == 1 for m in members if any(sizes[k] > 100 for k in m)) and all(c.n_rows < 200 or len(m) == 1 for c, m in zip(chunks, members, strict=True))


def test_asof_against_loops(spark):
    import random

    from syncproof.operators.joins import asof_join

    rng = random.Random(5)
    left = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([*range(60), None])) for i in range(400)]
    right = [(rng.choice([1, 1, 2, 3, None]), rng.choice([*range(0, 60, 3), None]), f"r{i}") for i in range(60)]
    l, r = spark.createDataFrame(left, "i long, k long, at long"), spark.createDataFrame(right, "k long, seen long, name string")  # noqa: E741
    for by, tolerance in ((["k"], None), (["k"], 4), ([], None)):
        got = {x.i: (x.seen, x.name) for x in asof_join(l, r if by else r.drop("k"), "at", "seen", by, tolerance).collect()}
        want = {}
        for i, k, at in left:
            ok = [(s, n) for rk, s, n in right if (not by or rk == k) and s is not None and at is not None and s <= at]
            best = max(ok, default=(None, None))
            want[i] = best if best[0] is not None and (tolerance is None or at - best[0] <= tolerance) else (None, None)
        assert got == want
    assert {x.seen for x in asof_join(l, r.limit(0), "at", "seen", ["k"]).collect()} == {None}


def test_intervals_against_loops(spark):
    import random

    from syncproof.operators.joins import interval_join

    rng = random.Random(6)
    points = [(i, rng.choice([1, 1, 2]), rng.choice([*range(-50, 200), None])) for i in range(300)]
    spans = [(100 + j, rng.choice([1, 2]), lo, rng.choice([lo - 1, lo, lo + 1, lo + 7, lo + 64, lo + 65, lo + 10**12, None])) for j in range(80) for lo in [rng.randint(-60, 200)]]
    p, s = spark.createDataFrame(points, "i long, k long, at long"), spark.createDataFrame(spans, "j long, k long, lo long, hi long")
    want = sorted((i, j) for i, k, at in points for j, k2, lo, hi in spans if k == k2 and at is not None and hi is not None and lo <= at < hi)
    for width, salts in ((1, 1), (8, 3)):
        assert sorted((r.i, r.j) for r in interval_join(p, s, "at", "lo", "hi", ["k"], width, salts).collect()) == want
    assert interval_join(p, s.limit(0), "at", "lo", "hi", ["k"]).count() == 0
