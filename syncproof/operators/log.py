"""Append logs: rows with metadata, change rows, and the current state read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncproof.functions.canonical import CHANGED, ID, INGESTED, OP, data_columns, record_id
from syncproof.functions.joins import bounded

OPS = {"insert": "i", "update": "u", "delete": "d", "read": "r"}


def inject_metadata(df: DataFrame, keys: Sequence[str], op: str | Column, ingested_at: Column, change_ts: Column | None = None) -> DataFrame:
    """df with record id, ingestion time and op, and the change's time if there is one."""
    extra = {ID: record_id(df, keys), INGESTED: ingested_at, OP: F.lit(op) if isinstance(op, str) else op}
    return df.withColumns(extra | ({CHANGED: change_ts} if change_ts is not None else {}))


def current_state(log: DataFrame, keys: Sequence[str] = (ID,), order: Sequence[str] = (INGESTED, "_sys_seq"), op: str = OP) -> DataFrame:
    """The latest row of each id by order; ids whose latest op is `d` are gone.

    max_by combines on the map side, so an id with a third of all changes does not meet in one task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    latest = log.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(row, F.struct(*order)).alias("latest"))
    return latest.select("latest.*").filter(F.col(op) != "d")


def id_range_filter(df: DataFrame, low: str | None, high: str | None, id_column: str = ID) -> DataFrame:
    """Rows of low <= id < high; None is unbounded."""
    for bound in ([F.col(id_column) >= low] if low is not None else []) + ([F.col(id_column) < high] if high is not None else []):
        df = df.filter(bound)
    return df


def cdc_images(changes: DataFrame, op: str = "op", before: str = "before", after: str = "after") -> DataFrame:
    """The image that counts: of deletes the row before, of all other row operations the row after. Drops and renames are left out."""
    kept = changes.filter(F.col(op).isin("c", "r", "u", "d", "i"))
    image = F.when(F.col(op) == "d", F.col(before)).otherwise(F.col(after))
    kind = F.when(F.col(op) == "d", "delete").when(F.col(op) == "u", "update").otherwise("insert")
    return kept.select(*[c for c in changes.columns if c not in (op, before, after)], kind.alias("kind"), image.alias("data"))


def cdc_apply(changes: DataFrame, selected: DataFrame, kind: str = "kind", stream: str = "stream") -> DataFrame:
    """Change rows of the selected streams as log rows: op by kind, an unknown kind counts as an insert."""
    code = F.coalesce(*[F.when(F.col(kind) == k, v) for k, v in OPS.items()], F.lit("i"))
    return changes.join(bounded(selected.select(stream)), stream, "left_semi").withColumn(OP, code)


def cdc_unavailable_patch(log: DataFrame, columns: Sequence[str], sentinel: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Replaces the sentinel, which says that a large value did not change, by the value the row had before. Real NULLs stay."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.last(F.when(F.col(c).isNull() | (F.col(c) != sentinel), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(w)["v"]
    return log.withColumns({c: known(c) for c in columns})


def bounded_position(changes: DataFrame, start: tuple[str, int], target: tuple[str, int], file: str = "file", pos: str = "pos") -> DataFrame:
    """Changes after start up to target; positions compare by file name, then by number. None if the target is not past the start."""
    at = F.struct(F.col(file).alias("f"), F.col(pos).cast("long").alias("p"))
    as_struct = lambda x: F.struct(F.lit(x[0]).alias("f"), F.lit(x[1]).cast("long").alias("p"))
    return changes.filter((at > as_struct(start)) & (at <= as_struct(target)))


def cdc_converge(snapshot: DataFrame, changes: DataFrame, **settings) -> DataFrame:
    """The current state of a snapshot and the changes replayed over it; they meet by record id."""
    return current_state(snapshot.unionByName(changes, allowMissingColumns=True), **settings)


def merge(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = OP) -> DataFrame:
    """target with the updates' latest rows by key put in, and deleted keys taken out: what an upsert leaves.

    Only the keys that have updates are looked up; all other rows of the target pass by.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in updates.columns])
    latest = updates.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("u")).select("u.*")
    kept = target.join(latest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest.filter(F.col(op) != "d").select(*target.columns))


__all__ = ["bounded_position", "cdc_apply", "cdc_converge", "cdc_images", "cdc_unavailable_patch", "current_state", "data_columns", "id_range_filter", "inject_metadata", "merge"]
