"""Column profiles, numeric sketches, baselines and run totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.functions.canonical import as_text, data_columns
from syncproof.scratch import cut

DISTINCT_CAP = 10_000


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, double_scale: int | None = None) -> DataFrame:
    """(column, n_rows, nulls, distinct, min, max) of each data column; min and max by text order, distinct up to 10 000.

    One aggregation without a shuffle of rows gives all of it with sketches of the distinct counts (relative error 5 %). With
    exact, values are counted one by one in the columns whose sketch is near the cap or below; the others are beyond it.
    """
    names = list(columns or data_columns(df))
    text = {c: as_text(df, c, double_scale) for c in names}
    wide = df.agg(F.count("*").alias("n"), *[x for i, c in enumerate(names) for x in (F.count(f"`{c}`").alias(f"v{i}"), F.min(text[c]).alias(f"a{i}"), F.max(text[c]).alias(f"z{i}"), F.approx_count_distinct(text[c]).alias(f"d{i}"))])
    if exact:
        wide = cut(wide)
        sketched = wide.first()
        few = [c for i, c in enumerate(names) if sketched[f"d{i}"] < 1.5 * DISTINCT_CAP]
    each = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"v{i}")).alias("nulls"), F.least(F.col(f"d{i}"), F.lit(DISTINCT_CAP)).cast("long").alias("distinct"), F.col(f"a{i}").alias("min"), F.col(f"z{i}").alias("max")) for i, c in enumerate(names)]
    stats = wide.select(F.inline(F.array(*each)))
    if not exact or not few:
        return stats
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text[c].alias("v")) for c in few])).alias("x")).select("x.*").filter("v is not null")
    counts = pairs.select("column", "v").distinct().groupBy("column").agg(F.least(F.count("*"), F.lit(DISTINCT_CAP)).alias("counted"))
    exactly = F.when(F.col("column").isin(few), F.coalesce("counted", F.lit(0))).otherwise(F.col("distinct")).cast("long")
    return stats.join(F.broadcast(counts), "column", "left").select("column", "n_rows", "nulls", exactly.alias("distinct"), "min", "max")  # a row a column


def histogram(df: DataFrame, value: str, width: float, last: int, group: Column | None = None) -> DataFrame:
    """(bucket, n) or (group, bucket, n): values in buckets of one width from 0; the last bucket has no end. NULLs are left out."""
    b = F.greatest(F.least(F.floor(F.col(value) / width), F.lit(last)), F.lit(0)).cast("long").alias("bucket")
    keys = [b] if group is None else [group.alias("group"), b]
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))


def baseline_snapshot(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], alpha: float = 0.3, recent: int = 200) -> DataFrame:
    """(keys, sample_count, mean, stddev, median, mad, ewma): ewma over the newest `recent` values, oldest first."""
    from pyspark.sql import Window

    v = F.col(value)
    first = df.groupBy(*keys).agg(F.count(v).alias("sample_count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"), F.percentile(v, 0.5).alias("median"))
    mad = df.join(first.select(*keys, "median"), list(keys)).groupBy(*keys).agg(F.percentile(F.abs(v - F.col("median")), 0.5).alias("mad"))
    newest = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter(F.col("_r") <= recent)
    series = newest.groupBy(*keys).agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("_r", v.alias("v")))), lambda x: x["v"])).alias("s"))
    ewma = F.aggregate(F.slice("s", 2, recent), F.get("s", F.lit(0)), lambda a, x: a * (1 - alpha) + x * alpha)
    return first.join(mad, list(keys)).join(series.select(*keys, ewma.alias("ewma")), list(keys))


def sync_totals(runs: DataFrame, keys: Sequence[str] = ("sync_id",)) -> DataFrame:
    return runs.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("rows_read", "rows_written", "bytes_written", "duration_seconds")])


def sketch_profile(df: DataFrame, columns: Sequence[str] | None = None, log_k: int = 12, kll_k: int = 200) -> DataFrame:
    """(column, n_rows, nulls, distinct_sketch, quantile_sketch) by one aggregation; sketches are binary and can be merged over loads.

    Distinct counts are within about 1.04 / sqrt(2 ** log_k) (1.6 % at 12) of the truth, ranks within about 1.65 % at a kll_k of 200. Columns that
    are no numbers have no quantile sketch.
    """
    names = list(columns or data_columns(df))
    numeric = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in names}
    empty = F.lit(None).cast("binary")
    aggs = [x for i, c in enumerate(names) for x in (F.count(f"`{c}`").alias(f"v{i}"), F.hll_sketch_agg(as_text(df, c), log_k).alias(f"h{i}"), (F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), kll_k) if numeric[c] else F.max(empty)).alias(f"q{i}"))]
    each = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"v{i}")).alias("nulls"), F.col(f"h{i}").alias("distinct_sketch"), F.when(F.col(f"v{i}") > 0, F.col(f"q{i}")).alias("quantile_sketch")) for i, c in enumerate(names)]
    return df.agg(F.count("*").alias("n"), *aggs).select(F.inline(F.array(*each)))


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stored profiles of many loads as one for each column (and `by`), without the rows that they came from."""
    return profiles.groupBy(*by, "column").agg(F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("distinct_sketch", True).alias("distinct_sketch"), F.when(F.count("quantile_sketch") > 0, F.kll_merge_agg_double("quantile_sketch")).alias("quantile_sketch"))


def read_profile(profiles: DataFrame, at: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """profiles with `distinct` and `quantiles` (null for columns that are no numbers or have no values) in place of the sketches."""
    ranks = F.array(*map(F.lit, at))
    return profiles.withColumn("distinct", F.hll_sketch_estimate("distinct_sketch")).withColumn("quantiles", F.when(F.col("quantile_sketch").isNotNull(), F.kll_sketch_get_quantile_double("quantile_sketch", ranks))).drop("distinct_sketch", "quantile_sketch")


def drift(base: DataFrame, current: DataFrame, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """(column, psi): population stability of two merged profiles, on the base's quantile edges. No row is read again."""
    b = base.filter("quantile_sketch is not null").select("column", F.col("quantile_sketch").alias("b"))
    met = b.join(current.filter("quantile_sketch is not null").select("column", F.col("quantile_sketch").alias("c")), "column")
    cuts = F.array_distinct(F.kll_sketch_get_quantile_double("b", F.array(*[F.lit(i / bins) for i in range(1, bins)])))
    edges = {r.column: r.edges for r in met.select("column", cuts.alias("edges")).collect()}  # a row a column; ranks are asked of plain values only

    def shares(sketch: str) -> Column:
        asked = F
        for c, values in edges.items():
            asked = asked.when(F.col("column") == c, F.kll_sketch_get_rank_double(sketch, F.array(*map(F.lit, values))))
        return F.concat(F.array(F.lit(0.0)), asked, F.array(F.lit(1.0)))

    if not edges:
        return met.select("column", F.lit(0.0).alias("psi"))
    ranked = met.select("column", shares("b").alias("rb"), shares("c").alias("rc"))
    part = lambda r, i: F.greatest(F.get(r, i + 1) - F.get(r, i), F.lit(floor))
    terms = F.transform(F.sequence(F.lit(0), F.size("rb") - 2), lambda i: (part("rc", i) - part("rb", i)) * F.log(part("rc", i) / part("rb", i)))
    return ranked.select("column", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("psi"))
