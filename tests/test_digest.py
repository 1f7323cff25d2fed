import pytest
from pyspark.sql import functions as F

from syncproof.functions.canonical import record_id, row_hash
from syncproof.operators import diff, digest


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, None if i % 7 == 0 else i * 1.5, f"t{i % 3}") for i in range(500)], "id long, x double, t string")


def sums(df):
    return tuple(digest.table_digest(df).first())


def test_order_and_partitions_do_not_matter(rows):
    assert sums(rows) == sums(rows.orderBy(F.rand(3))) == sums(rows.repartition(13)) == sums(rows.select("t", "x", "id"))


@pytest.mark.parametrize("change", [
    lambda d: d.withColumn("x", F.when(F.col("id") == 5, 0.0).otherwise(F.col("x"))),
    lambda d: d.union(d.filter("id = 5")),
    lambda d: d.filter("id <> 5"),
    lambda d: d.withColumnRenamed("t", "u"),
])
def test_any_change_shows(rows, change):
    assert sums(rows) != sums(change(rows))


def test_a_null_that_moves_shows(spark):
    a = spark.createDataFrame([(None, 1)], "a int, b int")
    b = spark.createDataFrame([(1, None)], "a int, b int")
    assert sums(a) != sums(b)
    text = spark.createDataFrame([("null",)], "a string")
    assert sums(text) != sums(spark.createDataFrame([(None,)], "a string"))


def test_repeated_rows_do_not_cancel(spark):
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,), (1,), (1,)], "a int")
    assert sums(one)[1] != sums(two)[1]


def test_metadata_is_left_out(rows):
    assert sums(rows) == sums(rows.withColumn("_sys_op", F.lit("r")))


def test_fnv1a(spark):
    df = spark.createDataFrame([("",), ("a",), (None,)], "t string")
    from syncproof.functions.canonical import fnv1a

    got = [r[0] for r in df.select(fnv1a(F.col("t"))).collect()]
    assert [None if g is None else g % (1 << 64) for g in got] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, None]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert sums(empty) == (0, "0")
    assert diff.verify_stream(diff.compared(empty, empty, ["a"])).first().match


def test_known_damage(spark):
    import __spark_entry__ as entry

    r = entry.queries()["verify_stream"](spark, "/root/testdata/sf0.01").first()
    assert (r.source_rows, r.dest_rows, r.missing_in_destination, r.missing_in_source, r.changed) == (15000, 14876, 155, 31, 147)


def test_dropped_and_corrupted_rows(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    assert diff.verify_stream(diff.compared(s, s, ["id"])).first().match
    for damaged, kind in ((s.filter("id <> 2"), "missing_in_destination"), (s.withColumn("v", F.when(F.col("id") == 2, "x").otherwise(F.col("v"))), "changed")):
        both = diff.compared(s, damaged, ["id"])
        assert [(r.kind, r.key.id) for r in diff.diff_rows(both).collect()] == [(kind, 2)]
        assert [(r.kind, r.key.id) for r in diff.diff_by_prefix(s, damaged, ["id"]).collect()] == [(kind, 2)]
        assert [r.pk for r in diff.diff_samples(both, ["id"]).collect()] == ["2"]
        assert [r.sample_pks for r in diff.diff_findings(both, ["id"]).collect()] == [["2"]]


def test_keys_of_several_columns(spark):
    s = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "p long, q long, v string")
    both = diff.compared(s, s.filter("q = 1"), ["p", "q"])
    assert [r.pk for r in diff.diff_samples(both, ["p", "q"]).collect()] == ["[1, 2]"]


def test_tables_without_key_keep_repeats_apart(spark):
    s = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    one = lambda d: diff.numbered(d, []).select("v", "occurrence")
    both = diff.compared(one(s), one(s.distinct()), ["v", "occurrence"])
    assert [r.kind for r in diff.diff_rows(both).collect()] == ["missing_in_destination"]


def test_ranges_follow_bisection(spark):
    n = 1000
    s = spark.createDataFrame([(i,) for i in range(n)], "id long")
    bad = {17, 18, 500, 999}
    both = diff.compared(s, s.filter(~F.col("id").isin(*bad)), ["id"])
    ids = sorted((r.rid, r.id) for r in s.select("id", record_id(s, ["id"]).alias("rid")).collect())
    leaves, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 100:
            todo += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        elif any(k in bad for _, k in ids[lo:hi]):
            leaves.append((ids[lo][0], ids[hi - 1][0]))
    assert sorted((r.range_min, r.range_max) for r in diff.diff_ranges(both).collect()) == sorted(leaves)


def test_row_hash_methods_differ(rows):
    a, b = (rows.select(row_hash(rows, method=m).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0] for m in ("xxhash64", "md5"))
    assert a != b


@pytest.mark.parametrize("source, dest, want", [
    ([(1, "x")], [(1, "x"), (1, "x")], (False, 1, 2, 0, 1, 0)),
    ([(1, "x"), (1, "y"), (2, "z")], [(1, "x"), (1, "y"), (2, "z")], (True, 3, 3, 0, 0, 0)),
    ([(1, "x"), (1, "x"), (1, "y")], [(1, "x"), (1, "z")], (False, 3, 2, 1, 0, 1)),
    ([(None, "x"), (None, "x")], [(None, "x")], (False, 2, 1, 1, 0, 0)),
    ([], [(1, "x")], (False, 0, 1, 0, 1, 0)),
])
def test_repeated_ids_count_as_multisets(spark, source, dest, want):
    s, d = (spark.createDataFrame(rows, "id long, v string") for rows in (source, dest))
    r = diff.verify_stream(diff.compared(s, d, ["id"])).first()
    assert (r.match, r.source_rows, r.dest_rows, r.missing_in_destination, r.missing_in_source, r.changed) == want
    assert (r.source_checksum, r.dest_checksum) == (sums(s)[1], sums(d)[1])
    listed = lambda df: sorted((x.kind, x.n, x.key.id) for x in df.collect())
    assert listed(diff.diff_rows(diff.compared(s, d, ["id"]))) == listed(diff.diff_by_prefix(s, d, ["id"]))
    assert {x.column: x.n for x in diff.diff_columns(s, d, ["id"]).collect()} == ({"v": want[5]} if want[5] else {})


def test_every_combination_of_counts(spark):
    """Copies of two rows of one id, from none to two, on both sides, against EXCEPT ALL."""
    import itertools

    for a, b, c, e in itertools.product((0, 2), (0, 1), (1, 2), (0, 2)):
        s = spark.createDataFrame([(1, "x")] * a + [(1, "y")] * b, "id long, v string")
        d = spark.createDataFrame([(1, "x")] * c + [(1, "y")] * e, "id long, v string")
        more, less = s.exceptAll(d).count(), d.exceptAll(s).count()
        r = diff.verify_stream(diff.compared(s, d, ["id"])).first()
        assert (r.changed, r.missing_in_destination, r.missing_in_source) == (min(more, less), max(more - less, 0), max(less - more, 0))
