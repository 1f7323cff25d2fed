"""Order-independent digests of rows and tables, and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncproof.functions.canonical import ID, canonical, data_columns, record_id, row_hash

WRAP = 1 << 64


def checksum(h: Column) -> Column:
    """Sum of hashes modulo 2^64 as text. A sum, not an exclusive or, so that repeated rows count; decimal, so that it cannot overflow."""
    total = F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.pmod(total, F.lit(str(WRAP)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string")


def with_row_digest(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None, method: str = "xxhash64", double_scale: int | None = None) -> DataFrame:
    """(id, hash, key: struct of the key columns): what a comparison needs of each row, and no more."""
    h = row_hash(df, columns, method, double_scale)
    return df.select((F.col(ID) if ID in df.columns else record_id(df, keys, double_scale)).alias("id"), h.alias("hash"), *([F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key")] if keys else []))


def table_digest(df: DataFrame, columns: Sequence[str] | None = None, method: str = "xxhash64", double_scale: int | None = None) -> DataFrame:
    """One row: n_rows, checksum."""
    h = row_hash(df, columns, method, double_scale)
    return df.agg(F.count("*").alias("n_rows"), checksum(h).alias("checksum"))


def digest_by_group(df: DataFrame, group: Column, columns: Sequence[str] | None = None, method: str = "xxhash64", double_scale: int | None = None) -> DataFrame:
    """(range, n_rows, checksum) for each value of group, for instance a chunk's number or the first digits of the id."""
    h = row_hash(df, columns, method, double_scale)
    return df.groupBy(group.alias("range")).agg(F.count("*").alias("n_rows"), checksum(h).alias("checksum"))


def digest_compare(source: DataFrame, destination: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Digests of both sides (n_rows, checksum and the columns `by`) -> one row for each key with match."""
    s = source.select(*by, F.col("n_rows").alias("source_rows"), F.col("checksum").alias("source_checksum"))
    d = destination.select(*by, F.col("n_rows").alias("dest_rows"), F.col("checksum").alias("dest_checksum"))
    both = s.join(d, list(by), "full_outer") if by else s.join(d)  # without keys: one row each
    return both.withColumn("match", F.col("source_rows").eqNullSafe(F.col("dest_rows")) & F.col("source_checksum").eqNullSafe(F.col("dest_checksum")))


__all__ = ["canonical", "checksum", "data_columns", "digest_by_group", "digest_compare", "row_hash", "table_digest", "with_row_digest"]
