"""Sinks: Parquet and JSON-line tables, merged versions, and the result that is taken from the table as it can be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from syncproof.functions.canonical import data_columns, row_hash
from syncproof.operators.digest import checksum, digest_compare, table_digest
from syncproof.operators.log import current_state


def write_parquet(df: DataFrame, path: str, fresh: bool = False) -> None:
    """Appends part files that never change; only a fresh load truncates."""
    df.write.mode("overwrite" if fresh else "append").parquet(path)


def write_ndjson(df: DataFrame, path: str, fresh: bool = False) -> None:
    """One JSON line a row, keys sorted, NULLs written."""
    df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode("overwrite" if fresh else "append").option("ignoreNullFields", "false").json(path)


def write_merged(target: DataFrame, updates: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """target and updates (append logs) as one current version in a new folder: for tables of plain files, which have no MERGE."""
    current_state(target.unionByName(updates, allowMissingColumns=True), list(keys), list(order)).write.mode("errorifexists").parquet(path)


def write_result(written: DataFrame, method: str = "xxhash64", double_scale: int | None = None) -> DataFrame:
    """(n_rows, checksum) of the re-read table: a fault of encoding shows, as it would not in the rows before they were written."""
    return table_digest(written, method=method, double_scale=double_scale)


def observed_digest(df: DataFrame, name: str, columns: Sequence[str] | None = None, method: str = "xxhash64", double_scale: int | None = None) -> tuple[DataFrame, Observation]:
    """df, and what it will have counted when it has been written once: n_rows, checksum and nulls of each column, without a scan of their own."""
    seen = Observation(name)
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{i}") for i, c in enumerate(columns or data_columns(df))]
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), checksum(row_hash(df, columns, method, double_scale)).alias("checksum"), *nulls), seen


def write_verified(df: DataFrame, path: str, columns: Sequence[str] | None = None, **settings) -> DataFrame:
    """Writes df to a new folder and gives one row: rows, checksums and match of what went by and of the re-read table, and the nulls of each column.

    The source is scanned once, by the write itself.
    """
    names = list(columns or data_columns(df))
    watched, seen = observed_digest(df, "write_verified", names, **settings)
    watched.write.mode("errorifexists").parquet(path)
    got, spark = seen.get, df.sparkSession
    source = spark.createDataFrame([(got["n_rows"], got["checksum"])], "n_rows long, checksum string")
    nulls = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(got[f"nulls_{i}"]).cast("long"))])
    return digest_compare(source, table_digest(spark.read.schema(df.schema).parquet(path), names, **settings)).withColumn("nulls", nulls)
