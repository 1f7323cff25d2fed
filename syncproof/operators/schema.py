"""Schemas as rows: native types, inferred and merged types, flat documents, cursors, catalogs and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Native type names by source and the lake types that they become (fixed values). Names not listed are strings.
EXACT = {
    "postgres": {
        "bool": ["boolean", "bool"],
        "int32": ["smallint", "int2", "integer", "int", "int4", "smallserial", "serial"],
        "int64": ["bigint", "int8", "bigserial"],
        "float32": ["real", "float4"],
        "float64": ["double precision", "float8"],
        "decimal": ["numeric", "decimal", "money"],
        "date": ["date"],
        "timestamp": ["timestamp without time zone", "timestamp with time zone", "timestamp", "timestamptz"],
        "json": ["json", "jsonb"],
        "binary": ["bytea"],
    },
    "mysql": {
        "int32": ["tinyint", "smallint", "mediumint", "int", "integer", "year"],
        "int64": ["bigint"],
        "bool": ["bit", "bool", "boolean"],
        "decimal": ["decimal", "numeric", "dec", "fixed"],
        "float32": ["float"],
        "float64": ["double", "double precision", "real"],
        "date": ["date"],
        "timestamp": ["datetime", "timestamp"],
        "json": ["json"],
        "binary": ["binary", "varbinary", "blob", "tinyblob", "mediumblob", "longblob"],
    },
    "mssql": {
        "int32": ["tinyint", "smallint", "int"],
        "int64": ["bigint"],
        "bool": ["bit"],
        "decimal": ["decimal", "numeric", "money", "smallmoney"],
        "float32": ["real"],
        "float64": ["float"],
        "date": ["date"],
        "timestamp": ["datetime", "datetime2", "smalldatetime", "datetimeoffset", "time"],
        "binary": ["binary", "varbinary", "image", "rowversion", "timestamp"],
    },
    "cassandra": {
        "int32": ["tinyint", "smallint", "int"],
        "int64": ["bigint", "counter", "varint"],
        "bool": ["boolean"],
        "float32": ["float"],
        "float64": ["double"],
        "decimal": ["decimal"],
        "date": ["date"],
        "timestamp": ["timestamp", "time"],
        "binary": ["blob"],
    },
    "elasticsearch": {
        "int32": ["byte", "short", "integer"],
        "int64": ["long", "unsigned_long"],
        "float32": ["float", "half_float"],
        "float64": ["double", "scaled_float"],
        "bool": ["boolean"],
        "timestamp": ["date", "date_nanos"],
        "json": ["object", "nested", "flattened"],
    },
    "mongodb": {
        "int32": ["int"],
        "int64": ["long"],
        "float64": ["double"],
        "bool": ["bool"],
        "timestamp": ["date"],
        "decimal": ["decimal"],
        "binary": ["binData"],
        "json": ["object", "array"],
    },
    "dynamodb": {
        "decimal": ["N"],
        "binary": ["B"],
        "bool": ["BOOL"],
        "json": ["M", "L", "SS", "NS", "BS"],
    },
}
#: Rules of sources whose types are told by a part of their name, in order (fixed values).
CONTAINS_SQLITE = [("INT", "int64"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "float64"), ("FLOA", "float64"), ("DOUB", "float64"), ("BOOL", "bool"), ("DECIMAL", "decimal"), ("NUMERIC", "decimal"), ("=DATE", "date"), ("TIMESTAMP", "timestamp"), ("DATETIME", "timestamp"), ("TIME", "timestamp"), ("JSON", "json")]
PREFIX_CLICKHOUSE = [("Int8", "int32"), ("Int16", "int32"), ("Int32", "int32"), ("UInt8", "int32"), ("UInt16", "int32"), ("UInt32", "int32"), ("Int64", "int64"), ("UInt64", "int64"), ("Int128", "int64"), ("UInt128", "int64"), ("Float32", "float32"), ("Float64", "float64"), ("Decimal", "decimal"), ("=Bool", "bool"), ("=Boolean", "bool"), ("=Date", "date"), ("=Date32", "date"), ("DateTime", "timestamp"), ("Array(", "json"), ("Map(", "json"), ("Tuple(", "json"), ("=JSON", "json")]
#: Cursor names by preference and the types that they may have (fixed values).
CURSORS = {
    "postgres": (["updated_at", "modified_at", "last_modified", "created_at"], ["timestamp"], "integer_key"),
    "sqlite": (["updated_at", "modified_at", "last_modified", "created_at"], ["timestamp", "date"], "integer_key"),
    "mongodb": (["updatedAt", "updated_at", "modifiedAt", "createdAt", "created_at"], ["timestamp"], "_id"),
    "elasticsearch": (["updated_at", "modified_at", "@timestamp", "created_at", "timestamp"], ["timestamp"], None),
}
STORAGE = {"bool": "boolean", "int32": "int", "int64": "long", "float32": "float", "float64": "double", "decimal": "decimal(38,18)", "string": "string", "binary": "binary", "date": "date", "timestamp": "timestamp", "json": "string", "array": "string"}


def type_names(spark: SparkSession) -> DataFrame:
    """(source, native, lake) of the sources whose type names are matched whole."""
    rows = [(s, n, lake) for s, kinds in EXACT.items() for lake, names in kinds.items() for n in names]
    return spark.createDataFrame(rows, "source string, native string, lake string")


def first_rule(rules: list[tuple[str, str]], hit) -> Column:
    """A `when` chain of the rules in order; `=NAME` asks for the whole name."""
    out = F
    for name, lake in rules:
        out = out.when(hit(name), lake)
    return out.otherwise("string")


def type_map(columns: DataFrame) -> DataFrame:
    """columns with (source, native_type) -> lake_type; unknown types are strings."""
    t = F.trim("native_type")
    bare = F.trim(F.regexp_replace(F.lower(t), r"\(.*$", ""))
    plain = F.when(F.col("source") == "postgres", bare).when(F.col("source").isin("mysql", "mssql", "cassandra"), F.lower(t)).otherwise(t)
    upper = F.upper(t)
    unwrapped = F.aggregate(F.sequence(F.lit(1), F.lit(8)), t, lambda a, _: F.regexp_replace(a, r"^(?:Nullable|LowCardinality)\((.*)\)$", "$1"))
    sqlite = first_rule(CONTAINS_SQLITE, lambda n: upper == n[1:] if n[0] == "=" else F.contains(upper, F.lit(n)))
    clickhouse = first_rule(PREFIX_CLICKHOUSE, lambda n: unwrapped == n[1:] if n[0] == "=" else F.startswith(unwrapped, F.lit(n)))
    known = F.broadcast(type_names(columns.sparkSession).withColumnsRenamed({"source": "_s", "native": "_n"}))
    met = columns.join(known, (F.col("source") == F.col("_s")) & (plain == F.col("_n")), "left")
    lake = (
        F.when((F.col("source") == "postgres") & bare.endswith("[]"), "array")
        .when(F.col("source") == "sqlite", sqlite)
        .when(F.col("source") == "clickhouse", clickhouse)
        .when((F.col("source") == "cassandra") & F.lower(t).rlike("^(list|set|map|tuple|frozen)<"), "json")
        .otherwise(F.coalesce("lake", F.lit("string")))
    )
    return met.select(*columns.columns, lake.alias("lake_type"))


def json_types(docs: DataFrame, document: str) -> DataFrame:
    """(field, type) of every top-level field of JSON documents."""
    fields = docs.select(F.explode(F.from_json(document, "map<string,variant>")).alias("field", "v"))
    kind = F.schema_of_variant("v")
    lake = F.when(kind == "BOOLEAN", "bool").when(kind.isin("BIGINT", "TINYINT", "SMALLINT", "INT"), "int64").when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float64").when(kind == "STRING", "string").when(kind == "VOID", None).otherwise("json")
    return fields.select("field", lake.alias("type")).filter(F.col("type").isNotNull())


def infer_schema_merge(typed: DataFrame) -> DataFrame:
    """(field, type) rows of all documents merged: a field with more than one type is a string. By field name."""
    return typed.groupBy("field").agg(F.count_distinct("type").alias("n"), F.min("type").alias("t")).select("field", F.when(F.col("n") > 1, "string").otherwise(F.col("t")).alias("type"))


def doc_flatten(df: DataFrame) -> DataFrame:
    """Top-level fields as columns; nested ones as JSON text, decimals, dates and binaries as text."""
    def flat(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c).alias(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.DateType)):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(f.name)
        return F.base64(c).alias(f.name) if isinstance(f.dataType, T.BinaryType) else c

    return df.select(*[flat(f) for f in df.schema])


def normalize_values(df: DataFrame) -> DataFrame:
    """Canonical values of one form whatever the source: decimals and intervals as text, times in UTC as text, bytes as text unless they are no UTF-8."""
    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.DayTimeIntervalType, T.DateType)):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, T.BinaryType):
            return F.coalesce(F.try_validate_utf8(c.cast("string")), F.base64(c)).alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema])


def suggest_cursor(columns: DataFrame, source: str = "postgres") -> DataFrame:
    """(stream, cursor_field): columns (stream, name, lake_type, primary_key) -> the preferred cursor of each stream, if it has any."""
    names, kinds, fallback = CURSORS[source]
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    named = (rank > 0) & F.col("lake_type").isin(*kinds)
    picked = columns.groupBy("stream").agg(
        F.min_by("name", F.when(named, rank)).alias("by_name"),
        F.count_if("primary_key").alias("keys"),
        F.max(F.when(F.col("primary_key") & F.col("lake_type").isin("int32", "int64"), F.col("name"))).alias("key"),
        F.max(F.when(F.col("name") == "_id", F.col("name"))).alias("id"),
    )
    spare = {"integer_key": F.when(F.col("keys") == 1, F.col("key")), "_id": F.col("id"), None: F.lit(None).cast("string")}[fallback]
    return picked.select("stream", F.coalesce("by_name", spare).alias("cursor_field"))


def catalog_validate(selected: DataFrame, streams: DataFrame, columns: DataFrame) -> DataFrame:
    """(stream, error) of selections (stream, mode, cursor_field) that the catalog does not allow: the first fault of each.

    streams: (stream, modes array); columns: (stream, name).
    """
    there = columns.select(F.col("stream").alias("_cs"), F.col("name").alias("_cn")).distinct().withColumn("_has", F.lit(True))
    met = selected.join(streams.select("stream", "modes"), "stream", "left").join(there, (F.col("stream") == F.col("_cs")) & (F.col("cursor_field") == F.col("_cn")), "left")
    error = (
        F.when(F.col("modes").isNull(), "stream not in catalog")
        .when(~F.array_contains("modes", F.col("mode")), "mode not supported")
        .when((F.col("mode") == "incremental") & (F.coalesce("cursor_field", F.lit("")) == ""), "cursor_field missing")
        .when((F.col("mode") == "incremental") & F.col("_has").isNull(), "cursor_field not in schema")
    )
    return met.select("stream", "mode", error.alias("error")).filter(F.col("error").isNotNull())


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(stream, name, change, from_type, to_type): columns added, dropped or retyped between two sets of (stream, name, type) rows."""
    met = before.withColumnRenamed("type", "from_type").join(after.withColumnRenamed("type", "to_type"), ["stream", "name"], "full_outer")
    change = F.when(F.col("from_type").isNull(), "added").when(F.col("to_type").isNull(), "dropped").when(F.col("from_type") != F.col("to_type"), "retyped")
    return met.withColumn("change", change).filter(F.col("change").isNotNull()).select("stream", "name", "change", "from_type", "to_type")


def schema_rows(df: DataFrame, stream: str) -> list[tuple[str, str, str]]:
    """(stream, name, type) of a table's columns."""
    return [(stream, f.name, f.dataType.simpleString()) for f in df.schema]


def column_mapping(source: DataFrame, destination: DataFrame) -> DataFrame:
    """(stream, source_column, source_type, dest_column, dest_type) of columns that meet by name, from (stream, name, type) rows."""
    d = destination.select("stream", F.col("name").alias("dest_column"), F.col("type").alias("dest_type"))
    return source.select("stream", F.col("name").alias("source_column"), F.col("type").alias("source_type")).join(d, ["stream"]).filter(F.col("source_column") == F.col("dest_column"))


def select_columns(df: DataFrame, columns: Sequence[str], known: Sequence[str] | None = None, sync_new: bool = False) -> DataFrame:
    """The chosen columns; with sync_new also those that were not known when they were chosen."""
    new = [c for c in df.columns if known is not None and c not in known] if sync_new else []
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in columns or c in new])


def sink_type_map(df: DataFrame, lake_types: dict[str, str]) -> DataFrame:
    """df with every listed column in its lake type's storage type; values that cannot be cast become NULL."""
    return df.select(*[F.col(f"`{c}`").try_cast(STORAGE[lake_types[c]]).alias(c) if c in lake_types else F.col(f"`{c}`") for c in df.columns])
