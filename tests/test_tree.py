import tempfile

from pyspark.sql import functions as F

from syncproof.operators import diff, tree
from syncproof.operators.digest import with_row_digest


def as_set(df):
    return {tuple(r) for r in df.select("level", "prefix", "n_rows", "checksum").collect()}


def test_changes_lead_to_the_tree_built_afresh(spark):
    a = spark.createDataFrame([(i, f"v{i}") for i in range(3000)] + [(5, "again"), (5, "again")], "id long, v string")
    b = a.filter("id % 500 <> 7").withColumn("v", F.when(F.col("id") % 700 == 3, "other").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(9999, "new")], "id long, v string"))
    rows = lambda t: with_row_digest(t, ["id"]).select("id", "hash")
    changes = rows(a).exceptAll(rows(b)).withColumn("sign", F.lit(-1)).unionByName(rows(b).exceptAll(rows(a)).withColumn("sign", F.lit(1)))
    before, after = tree.build(a, ["id"]), tree.build(b, ["id"])
    assert as_set(tree.apply_changes(before, changes)) == as_set(after) != as_set(before)
    assert {(r.level, r.n) for r in after.groupBy("level").agg(F.sum("n_rows").alias("n")).collect()} == {(level, b.count()) for level in range(1, 5)}


def test_only_unlike_nodes_are_read(spark):
    a = spark.createDataFrame([(i, f"v{i}") for i in range(3000)], "id long, v string")
    b = a.withColumn("v", F.when(F.col("id") == 1234, "x").otherwise(F.col("v")))
    folder = tempfile.mkdtemp(prefix="syncproof-test-")
    tree.store(tree.build(a, ["id"], 3), f"{folder}/a")
    tree.store(tree.build(b, ["id"], 3), f"{folder}/b")
    x, y = tree.load(spark, f"{folder}/a"), tree.load(spark, f"{folder}/b")
    bad = tree.unlike(x, y, 3)
    (found,) = diff.diff_rows(diff.compared(a, b, ["id"])).collect()
    assert bad == [found.id[:3]]
    plan = tree.level_of(x, 3, [bad[0][:2]])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [In(prefix" in plan
    assert len(tree.level_of(x, 3, [bad[0][:2]]).inputFiles()) > 0
    got = tree.diff_by_tree(a, b, x, y, ["id"], 3).collect()
    assert [(r.kind, r.n, r.key.id) for r in got] == [("changed", 1, 1234)]
    assert tree.unlike(x, x, 3) == [] and tree.diff_by_tree(a, a, x, x, ["id"], 3).count() == 0


def test_many_unlike_nodes_stop_the_descent(spark):
    a = spark.createDataFrame([(i, "a") for i in range(500)], "id long, v string")
    b = a.withColumn("v", F.lit("b"))
    x, y = tree.build(a, ["id"], 3), tree.build(b, ["id"], 3)
    assert len(tree.unlike(x, y, 3, most=10)) == 16
    assert tree.diff_by_tree(a, b, x, y, ["id"], 3).count() == 500
