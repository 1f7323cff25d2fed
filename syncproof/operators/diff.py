"""Row differences between a source and a destination: classes, columns, ranges, samples and findings.

The wide rows never meet: both sides are reduced to (id, hash, key) first, and for the difference of columns only
rows whose hashes differ are read again. Rows are counted as multisets: ids may repeat on either side, equal rows cancel one by one,
and of what is left of an id a source row and a destination row are one change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncproof.functions.canonical import as_text, data_columns
from syncproof.functions.joins import bounded
from syncproof.operators.digest import checksum, with_row_digest
from syncproof.scratch import cut

MISSING_IN_DESTINATION, MISSING_IN_SOURCE, CHANGED, SAME = "missing_in_destination", "missing_in_source", "changed", "same"


def numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For tables without a key: an occurrence number that keeps repeated rows apart."""
    from pyspark.sql import Window

    cols = data_columns(df) if not keys else list(keys)
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*cols).orderBy(F.lit(1))))


def compared(source: DataFrame, destination: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, method: str = "xxhash64", double_scale: int | None = None) -> DataFrame:
    """(id, kind, n, source_sum, dest_sum, key columns): how many rows of an id are of which kind; sums are those of the sides' hashes."""
    return meet(with_row_digest(source, keys, columns, method, double_scale), with_row_digest(destination, keys, columns, method, double_scale))


def meet(source: DataFrame, destination: DataFrame) -> DataFrame:
    """compared() of rows reduced to (id, hash, key). Copies are counted before ids meet, so an id may hold any share of the rows."""
    by = [c for c in source.columns if c != "hash"]
    side = lambda df, s, d: df.select(*by, "hash", F.lit(s).cast("long").alias("s"), F.lit(d).cast("long").alias("d"))
    counted = side(source, 1, 0).unionByName(side(destination, 0, 1)).groupBy(*by, "hash").agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    times = lambda n: F.col("hash").cast("decimal(20,0)") * n.cast("decimal(18,0)")
    both, more, less = F.least("s", "d"), F.greatest(F.col("s") - F.col("d"), F.lit(0)), F.greatest(F.col("d") - F.col("s"), F.lit(0))
    wide = "decimal(38,0)"
    equal = counted.filter(both > 0).select(*by, F.lit(SAME).alias("kind"), both.alias("n"), times(both).cast(wide).alias("source_sum"), times(both).cast(wide).alias("dest_sum"))
    left = counted.filter("s <> d").groupBy(*by).agg(F.sum(more).alias("s"), F.sum(less).alias("d"), F.sum(times(more)).cast(wide).alias("source_sum"), F.sum(times(less)).cast(wide).alias("dest_sum"))
    kind = lambda name, n: F.struct(F.lit(name).alias("kind"), n.alias("n"))
    kinds = F.filter(F.array(kind(CHANGED, both), kind(MISSING_IN_DESTINATION, F.col("s") - both), kind(MISSING_IN_SOURCE, F.col("d") - both)), lambda k: k["n"] > 0)
    unlike = left.select(*by, "source_sum", "dest_sum", F.posexplode(kinds).alias("at", "k"))
    once = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    return equal.unionByName(unlike.select(*by, "k.kind", "k.n", once("source_sum"), once("dest_sum")))


def diff_rows(both: DataFrame) -> DataFrame:
    """The rows of compared() that differ."""
    return both.filter(F.col("kind") != SAME)


def verify_stream(both: DataFrame) -> DataFrame:
    """One row: match, rows and checksums of both sides, and how many rows of each class."""
    n = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    return both.agg(
        (F.count_if(F.col("kind") != SAME) == 0).alias("match"),
        n(SAME, CHANGED, MISSING_IN_DESTINATION).alias("source_rows"),
        n(SAME, CHANGED, MISSING_IN_SOURCE).alias("dest_rows"),
        checksum(F.col("source_sum")).alias("source_checksum"),
        checksum(F.col("dest_sum")).alias("dest_checksum"),
        *[n(k).alias(k) for k in (MISSING_IN_DESTINATION, MISSING_IN_SOURCE, CHANGED)],
    )


def diff_by_prefix(source: DataFrame, destination: DataFrame, keys: Sequence[str], digits: int = 3, **settings) -> DataFrame:
    """diff_rows for large, mostly equal tables: digests of id prefixes first, then only rows of prefixes that differ."""
    s, d = with_row_digest(source, keys, **settings), with_row_digest(destination, keys, **settings)
    prefix = F.substring("id", 1, digits)
    sums = lambda x, n: x.groupBy(prefix.alias("p")).agg(F.count("*").alias(f"{n}_n"), checksum(F.col("hash")).alias(f"{n}_c"))
    bad = sums(s, "s").join(sums(d, "d"), "p", "full_outer").filter(~(F.col("s_n").eqNullSafe(F.col("d_n")) & F.col("s_c").eqNullSafe(F.col("d_c")))).select("p")
    bad = F.broadcast(bad)  # 16 ** digits rows at most
    s, d = (x.join(bad, prefix == F.col("p"), "left_semi") for x in (s, d))
    return diff_rows(meet(s, d)).select("id", "kind", "n", "key")


def diff_columns(source: DataFrame, destination: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n): in how many changed rows a column's values differ; NULL keys meet.

    Keys meet with two hashes of their rows first; the wide rows of unlike ones alone are read again. Of these, equal rows of a key cancel
    one by one, and the rest are paired in the order of their hashes.
    """
    from pyspark.sql import Window

    names = [c for c in (columns or data_columns(source)) if c not in keys]
    k = [f"_k{i}" for i in range(len(keys))]
    key = [F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)]
    h = [F.xxhash64(F.lit(j), *[F.col(f"`{c}`") for c in names]).alias(f"_h{j}") for j in (0, 1)]
    counts = lambda df, n: df.select(*key, *h, F.lit(n).alias("n"))
    unlike = counts(source, 1).unionByName(counts(destination, -1)).groupBy(*k, "_h0", "_h1").agg(F.sum("n").alias("n")).filter("n <> 0")
    bad = bounded(cut(unlike.select(*[F.col(c).alias(f"u{c}") for c in k]).distinct()))
    met = lambda x, y: [F.col(f"{x}{c}").eqNullSafe(F.col(f"{y}{c}")) for c in k]

    def rows(df: DataFrame, n: str) -> DataFrame:
        """The rows of unlike keys, copies of one row numbered."""
        wide = df.select(*key, *h, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).join(bad, met("", "u"), "left_semi")
        copy = F.row_number().over(Window.partitionBy(*k, "_h0", "_h1").orderBy(F.lit(1)))
        return wide.select(*[F.col(c).alias(f"{n}{c}") for c in k], F.struct("_h0", "_h1", copy.alias("copy")).alias(f"{n}h"), F.col("row").alias(n))

    s, d = cut(rows(source, "s")), cut(rows(destination, "d"))
    rest = lambda x, y, n, m: x.join(y, [*met(n, m), F.col(f"{n}h") == F.col(f"{m}h")], "left_anti").withColumn(f"{n}at", F.row_number().over(Window.partitionBy(*[f"{n}{c}" for c in k]).orderBy(f"{n}h")))
    pairs = rest(s, d, "s", "d").join(rest(d, s, "d", "s"), [*met("s", "d"), F.col("sat") == F.col("dat")])
    found = F.array_compact(F.array(*[F.when(~F.col(f"s.`{c}`").eqNullSafe(F.col(f"d.`{c}`")), F.lit(c)) for c in names]))
    return pairs.select(F.explode(found).alias("column")).groupBy("column").agg(F.count("*").alias("n"))


def id_union(source: DataFrame, destination: DataFrame, id_column: str = "id") -> DataFrame:
    return source.select(id_column).union(destination.select(id_column)).distinct()


def leaf(rank: Column, n: Column, threshold: int = 100) -> Column:
    """The leaf [lo, hi) that bisection of n sorted rows, down to threshold, puts the row of that rank (from 0) in."""
    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("long")
        split = at["hi"] - at["lo"] > threshold
        return F.when(~split, at).otherwise(F.struct(F.when(rank < middle, at["lo"]).otherwise(middle).alias("lo"), F.when(rank < middle, middle).otherwise(at["hi"]).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0).cast("long").alias("lo"), n.cast("long").alias("hi")), halve)


def diff_ranges(both: DataFrame, threshold: int = 100, digits: int = 3) -> DataFrame:
    """(range_min, range_max, n): leaves of the bisected id union that hold differing ids, with their first and last id.

    The comparison is written once. Only ids of prefixes near a differing one are ranked: a leaf has at most `threshold` ids.
    """
    from pyspark.sql import Window

    ids = cut(both.groupBy("id").agg(F.max(F.col("kind") != SAME).alias("bad")))
    p = F.substring("id", 1, digits)
    prefixes = ids.groupBy(p.alias("p")).agg(F.count("*").alias("c"), F.max("bad").alias("bad"))  # 16 ** digits rows at most
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("p").rowsBetween(1, Window.unboundedFollowing)
    spans = prefixes.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    ends, starts = F.max(F.when(F.col("bad"), F.col("before") + F.col("c"))).over(before), F.min(F.when(F.col("bad"), F.col("before"))).over(after)
    near = spans.filter("bad").unionByName(spans.withColumn("e", ends).withColumn("s", starts).filter(~F.col("bad") & (F.coalesce(F.col("before") < F.col("e") + threshold, F.lit(False)) | F.coalesce(F.col("before") + F.col("c") > F.col("s") - threshold, F.lit(False)))).drop("e", "s"))
    some = ids.withColumn("p", p).join(F.broadcast(near.select("p", "before", "n")), "p")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1
    leaves = some.withColumn("leaf", leaf(rank, F.col("n"), threshold)["lo"])
    return leaves.groupBy("leaf").agg(F.min("id").alias("range_min"), F.max("id").alias("range_max"), F.count_if("bad").alias("n")).filter("n > 0").drop("leaf")


def display_key(key: Sequence[str], df_key: str = "key") -> Column:
    """A key's value as text; keys of several columns as a list."""
    parts = [F.col(f"{df_key}.`{k}`").cast("string") for k in key]
    return parts[0] if len(parts) == 1 else F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def diff_samples(both: DataFrame, keys: Sequence[str], most: int = 20) -> DataFrame:
    """(id, kind, pk): the first mismatches in id order."""
    return diff_rows(both).select("id", "kind", display_key(keys).alias("pk")).orderBy("id").limit(most)


def diff_findings(both: DataFrame, keys: Sequence[str], digits: int = 2, most: int = 20) -> DataFrame:
    """(range_min, range_max, n, sample_pks) by id prefix. Samples are drawn while aggregating: at most `most` a group are kept."""
    from pyspark.sql import Window

    bad = diff_rows(both).select("id", F.col("n").alias("rows"), display_key(keys).alias("pk"), F.substring("id", 1, digits).alias("p"), F.substring("id", 1, digits + 2).alias("q"))
    # ranked in subranges first, so that no task sorts a whole range of a badly damaged table
    near = bad.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("id"))).filter(F.col("r") <= most)
    samples = near.groupBy("p").agg(F.slice(F.array_sort(F.collect_list(F.struct("id", "pk"))), 1, most).alias("s"))
    spans = bad.groupBy("p").agg(F.min("id").alias("range_min"), F.max("id").alias("range_max"), F.sum("rows").alias("n"))
    return spans.join(samples, "p").select("range_min", "range_max", "n", F.transform("s", lambda x: x["pk"]).alias("sample_pks"))


def values_as_text(df: DataFrame, keys: Sequence[str], double_scale: int | None = None) -> DataFrame:
    """(keys, column, value) of every data column, for cell by cell comparison."""
    names = [c for c in data_columns(df) if c not in keys]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_text(df, c, double_scale).alias("value")) for c in names]))
    return df.select(*keys, cells.alias("cell")).select(*keys, "cell.*")
