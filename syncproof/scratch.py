"""Tables written into the folder that driver and executors share, to end a lineage or to read a copy back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_bases: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and all runs in this process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="syncproof-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses; it is removed when the program ends."""
    base = f"{shared_dir(spark)}/syncproof-{spark.sparkContext.applicationId}"
    if base not in _bases:
        _bases[base] = spark
        atexit.register(_remove, base)
    return f"{base}/{uuid.uuid4().hex}"


def cut(df: DataFrame, free_shuffles: bool = False) -> DataFrame:
    """df, written as Parquet and read back: its lineage ends there and survives lost executors.

    With free_shuffles its shuffle files go when the write has ended (they are of no use then), not when the driver next collects
    garbage. Spark takes that from a session setting, which stands during the write alone; of other queries that end meanwhile it
    changes no result.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession)
    before = spark.conf.get(FREE, None)
    if free_shuffles:
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free_shuffles:
            spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def free(written: DataFrame) -> None:
    """Removes what cut() wrote for a table that nothing will read again; other tables are left alone."""
    path = getattr(written, "written_at", None)
    if path:
        jvm = written.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(written.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(base: str) -> None:
    try:
        spark = _bases[base]
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM is gone already: the folder stays for the cluster's own clean-up
        pass
