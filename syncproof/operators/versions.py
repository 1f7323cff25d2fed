"""Tables of plain Parquet files with upserts that rewrite only the files they touch.

Rows are dealt to a fixed number of buckets by a hash of their keys, a folder a bucket. A version is a manifest, one row a bucket at most, of the
folders that hold it, in one file. A merge reads and rewrites the buckets that its updates fall into and writes a manifest in which all others keep their
folders; renaming it to its number makes it the current version in one step, which only one of two writers of the same number can do. Files never
change, so whoever reads an older version goes on reading it. Of a merge that dies before the rename nothing is seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syncproof.functions.canonical import OP

BUCKET = "_bucket"
MANIFEST = "bucket int, folder string, buckets int"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, ascending."""
    where, fs = _files(spark, f"{path}/versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()) if fs.exists(where) else []


def manifest(spark: SparkSession, path: str, version: int) -> list:
    """Rows (bucket, folder, buckets) of a version: one a bucket at most, and one of a null folder that holds the number of buckets."""
    return spark.read.schema(MANIFEST).json(f"{path}/versions/{version}").collect()


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> int:
    """Writes rows of unique keys as version 0. About as many buckets as the table has files' worth of data."""
    return _commit(rows.sparkSession, path, 0, [(None, None, buckets), *_write(rows, path, keys, buckets)])


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """A version, by default the current one."""
    return _read(spark, path, schema, [r for r in manifest(spark, path, versions(spark, path)[-1] if version is None else version) if r.folder])


def merge_touched(spark: SparkSession, path: str, schema, updates: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = OP) -> int:
    """The current version with the latest update of each key put in and keys whose latest op is `d` taken out; gives the new version's number.

    Null keys meet null keys. Without updates the version stays. If another writer commits the same number first, this fails and nothing of it is seen.
    """
    now = versions(spark, path)[-1]
    known = manifest(spark, path, now)
    buckets = next(r.buckets for r in known if r.folder is None)
    row = F.struct(*[F.col(f"`{c}`") for c in updates.columns])
    latest = updates.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(row, F.struct(*order)).alias("_u")).select("_u.*")
    touched = {r[0] for r in updates.select(bucket_of(keys, buckets)).distinct().collect()}  # `buckets` at most
    if not touched:
        return now
    old = _read(spark, path, schema, [r for r in known if r.folder and r.bucket in touched]).alias("old")
    gone = latest.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)])
    kept = old.join(gone, [F.col(f"old.`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)], "left_anti")
    whole = kept.unionByName(latest.filter(F.col(op).isNull() | (F.col(op) != "d")).select(*[F.col(f"`{c}`") for c in old.columns]))
    same = [tuple(r) for r in known if r.folder is None or r.bucket not in touched]
    return _commit(spark, path, now + 1, [*same, *_write(whole, path, keys, buckets)])


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Forgets all but the last `keep` versions and removes the folders that none of these names; gives their number. No merge may run meanwhile."""
    known = versions(spark, path)
    for v in known[: max(0, len(known) - keep)]:
        where, fs = _files(spark, f"{path}/versions/{v}")
        fs.delete(where, False)
    used = {r.folder for v in known[-keep:] for r in manifest(spark, path, v)}
    where, fs = _files(spark, f"{path}/data")
    n = 0
    for load in fs.listStatus(where):
        for s in fs.listStatus(load.getPath()):
            name = f"{load.getPath().getName()}/{s.getPath().getName()}"
            if s.isDirectory() and name not in used:
                n += fs.delete(s.getPath(), True)
    return n


def _read(spark: SparkSession, path: str, schema, rows: list) -> DataFrame:
    folders = [f"{path}/data/{r.folder}" for r in rows]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> list[tuple]:
    """Writes rows into a folder of their own for each bucket that has some."""
    load = uuid.uuid4().hex
    rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/data/{load}")
    where, fs = _files(rows.sparkSession, f"{path}/data/{load}")
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return [(int(n.split("=")[1]), f"{load}/{n}", buckets) for n in sorted(names)]


def _commit(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> int:
    draft = f"{path}/drafts/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(draft)
    folder, fs = _files(spark, draft)
    (source,) = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    target, _ = _files(spark, f"{path}/versions/{version}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):  # a file: a distributed file system never renames it onto another
        raise RuntimeError(f"version {version} of {path} was written by another merge")
    return version


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
