"""File sources: objects of JSON lines and CSV, event logs and destination logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.operators.events import parse_events
from syncproof.operators.log import current_state
from syncproof.operators.schema import doc_flatten


def object_ndjson(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a path, nested values as JSON text. Blank lines are skipped; a broken line fails the read."""
    return doc_flatten(spark.read.schema(schema).json(path, mode="FAILFAST"))


def object_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every value is a string, a short record fails the read."""
    return spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")


def object_incremental(spark: SparkSession, path: str, schema: T.StructType | str, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, watermark) of JSON-line objects modified after `since` (ISO time); the watermark is the newest modification time. Empty objects do not count."""
    reader = spark.read.schema(schema)
    df = (reader.option("modifiedAfter", since) if since else reader).json(path)
    files = df.select("*", F.col("_metadata.file_modification_time").alias("_modified"), F.col("_metadata.file_size").alias("_size")).filter("_size > 0")
    return files.drop("_modified", "_size"), files.agg(F.max("_modified").alias("watermark"))


def read_table_log(spark: SparkSession, path: str, schema: T.StructType | None = None, keys: tuple[str, ...] = ("_sys_id",), order: tuple[str, ...] = ("_sys_ingested_at", "_sys_seq"), op: str = "_sys_op") -> DataFrame:
    """The current state of a destination of Parquet part files, or of JSON lines where a schema is given (a torn last line is dropped)."""
    log = spark.read.parquet(path) if schema is None else spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return current_state(log, keys, order, op)


def events_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of an event log of JSON lines."""
    return parse_events(spark.read.text(path))
