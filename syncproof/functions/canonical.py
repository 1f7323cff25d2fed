"""Canonical text and hashes of rows: the one place where values become text for digests, ids and comparisons.

Columns go by name order, each as name, chr(1), then `=` and its text, or `-` for NULL, all joined by chr(2): a NULL that
moves between columns changes the text, and so does a value that moves.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = "_sys_"
ID, INGESTED, OP, CHANGED = "_sys_id", "_sys_ingested_at", "_sys_op", "_sys_change_ts"


def data_columns(df: DataFrame) -> list[str]:
    """The columns that are not metadata, in schema order."""
    return [c for c in df.columns if not c.startswith(META)]


def as_text(df: DataFrame, name: str, double_scale: int | None = None) -> Column:
    """One text for a value, whichever table format it was read from. double_scale rounds floating numbers to so many places."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c.cast(T.DecimalType(38, double_scale)) if double_scale is not None else c).cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def canonical(df: DataFrame, columns: Sequence[str] | None = None, double_scale: int | None = None) -> Column:
    names = sorted(data_columns(df) if columns is None else columns)
    each = [F.concat(F.lit(n + chr(1)), F.coalesce(F.concat(F.lit("="), as_text(df, n, double_scale)), F.lit("-"))) for n in names]
    return F.concat_ws(chr(2), *each)


def md5_hash(text: Column) -> Column:
    """The first 60 bits of MD5 as a long: the form that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, method: str = "xxhash64", double_scale: int | None = None) -> Column:
    """A 64-bit hash of the canonical text: `xxhash64` in production, `md5` where another engine must agree, `fnv1a` for FNV-1a."""
    text = canonical(df, columns, double_scale)
    return {"xxhash64": F.xxhash64, "md5": md5_hash, "fnv1a": fnv1a}[method](text)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of UTF-8 text, as a signed long (an Arrow UDF: for parity checks, not for hot paths)."""
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> int | None:
            if t is None:
                return None
            h = 0xCBF29CE484222325
            for b in t.encode():
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            return h - (1 << 64) if h >> 63 else h

        return texts.map(one)

    return hashed(text)


def record_id(df: DataFrame, keys: Sequence[str] = (), double_scale: int | None = None) -> Column:
    """16 hex digits of the key columns' canonical text, or of all data columns' where there is no key."""
    return F.substring(F.md5(canonical(df, list(keys) or None, double_scale)), 1, 16)
