"""Shared helpers of the corpus operators: tables, lineage cuts and document mappers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.scratch import cut, shared_dir

__all__ = ["ascii_lower", "cut", "map_documents", "shared_dir", "slices", "table"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """A-Z to a-z, all else untouched."""
    return F.translate(c, UPPER, LOWER)


def map_documents(docs: DataFrame, make: Callable[[], Callable], fields: list[T.StructField], text: str = "text", rows: bool = False) -> DataFrame:
    """docs as one struct column `doc` (so any column names may occur), plus fields computed from whole texts.

    make() is called once in each task and returns f(texts: list[bytes | None]) -> list of value lists, one for
    each field; texts come as UTF-8 bytes in slices of bounded size. With rows, f also gets the documents' Arrow struct array.
    """
    out = T.StructType([T.StructField("doc", docs.schema), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(0).field(text).cast(pa.binary()).to_pylist()
                got = f(texts, part.column(0)) if rows else f(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, type=t) for v, t in zip(got, kinds, strict=True)]], names=names)

    kinds, names = [arrow_type(x.dataType) for x in fields], ["doc", *[x.name for x in fields]]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).mapInArrow(run, out)


def slices(batch: pa.RecordBatch, text: str, rows: int = 256, nbytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no slice has more than so many rows or, but for a single text, bytes."""
    import pyarrow.compute as pc

    field = batch.column(batch.schema.names.index(text)) if text in batch.schema.names else batch.column(0).field(text)
    sizes = pc.fill_null(pc.binary_length(field.cast(pa.binary())), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > nbytes or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
