import os
import tempfile

import pytest
from pyspark.sql import functions as F

from syncproof.operators import log, versions

SCHEMA = "id long, part string, v string"
KEYS = ["id", "part"]


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="syncproof-test-") + "/table"


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def updates(spark, data):
    return spark.createDataFrame(data, f"{SCHEMA}, op string, seq long")


def merged(spark, path, data):
    return versions.merge_touched(spark, path, SCHEMA, updates(spark, data), KEYS, ["seq"], "op")


def test_only_touched_files_are_rewritten(spark, path):
    table = spark.createDataFrame([(i, None if i % 10 == 0 else "p", f"v{i}") for i in range(1000)] + [(None, None, "none")], SCHEMA)
    assert versions.create(table, path, KEYS, buckets=32) == 0
    before, old = files(path), versions.read(spark, path, SCHEMA)
    was = rows(old)
    assert was == rows(table) and len(before) == 32
    data = [(3, "p", "new", "u", 1), (3, "p", "newer", "u", 2), (20, None, None, "d", 3), (5000, "p", "added", "i", 4), (None, None, "known", "u", 5), (6000, "p", "gone again", "i", 6), (6000, "p", None, "d", 7)]
    assert merged(spark, path, data) == 1
    after = files(path)
    touched = {r[0] for r in updates(spark, data).select(versions.bucket_of(KEYS, 32)).distinct().collect()}
    assert before.items() <= after.items() and len(after) - len(before) == len(touched) < 7
    want = {(r[0], r[1]): r for r in was} | {(3, "p"): (3, "p", "newer"), (5000, "p"): (5000, "p", "added"), (None, None): (None, None, "known")}
    del want[(20, None)]
    assert rows(versions.read(spark, path, SCHEMA)) == sorted(want.values(), key=repr)
    assert rows(old) == was == rows(versions.read(spark, path, SCHEMA, 0))  # a reader of the version before sees no change
    assert merged(spark, path, []) == 1 and files(path) == after
    assert versions.vacuum(spark, path) == len(touched)
    assert versions.versions(spark, path) == [1] and rows(versions.read(spark, path, SCHEMA)) == sorted(want.values(), key=repr)


def test_of_two_writers_one_commits(spark, path, monkeypatch):
    versions.create(spark.createDataFrame([(1, "p", "a")], SCHEMA), path, KEYS, 4)
    real = versions.versions
    assert merged(spark, path, [(1, "p", "first", "u", 1)]) == 1
    monkeypatch.setattr(versions, "versions", lambda *a: real(*a)[:1])  # a writer that began before the other's commit
    with pytest.raises(RuntimeError, match="another merge"):
        merged(spark, path, [(1, "p", "second", "u", 2)])
    monkeypatch.undo()
    assert rows(versions.read(spark, path, SCHEMA)) == [(1, "p", "first")]


def test_a_death_before_the_commit_is_not_seen(spark, path, monkeypatch):
    versions.create(spark.createDataFrame([(1, "p", "a"), (2, "p", "b")], SCHEMA), path, KEYS, 4)

    def die(*a):
        raise OSError("dead")

    monkeypatch.setattr(versions, "_commit", die)
    with pytest.raises(OSError):
        merged(spark, path, [(1, "p", "x", "u", 1)])
    monkeypatch.undo()
    assert rows(versions.read(spark, path, SCHEMA)) == [(1, "p", "a"), (2, "p", "b")]
    assert merged(spark, path, [(1, "p", None, "d", 1), (2, "p", None, "d", 1)]) == 1
    assert rows(versions.read(spark, path, SCHEMA)) == []
    assert merged(spark, path, [(7, None, "c", "i", 1)]) == 2 and rows(versions.read(spark, path, SCHEMA)) == [(7, None, "c")]


def test_as_the_plain_merge(spark, path):
    base = spark.range(500).select("id", F.lit("p").alias("part"), F.lit("0").alias("v"))
    versions.create(base, path, KEYS, 8)
    change = spark.range(300, 700).select("id", F.lit("p").alias("part"), F.lit("1").alias("v"), F.when(F.col("id") % 7 == 0, "d").otherwise("u").alias("op"), F.col("id").alias("seq"))
    versions.merge_touched(spark, path, SCHEMA, change, KEYS, ["seq"], "op")
    assert rows(versions.read(spark, path, SCHEMA)) == rows(log.merge(base, change, KEYS, ["seq"], "op"))
