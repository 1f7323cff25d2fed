"""A stored 16-way tree of digests by id prefix, kept up to date by changes and compared from the top down.

A node is (level, prefix, n_rows, checksum): count and sum of row hashes modulo 2^64 of the ids that start with the prefix. Sums add and subtract, so
a batch of changes moves only the nodes on its ids' paths. Levels and first digits are folders, rows are in the order of prefixes: a comparison
reads level 1 of both trees, then only nodes under unlike ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncproof.operators.diff import diff_rows, meet
from syncproof.operators.digest import WRAP, with_row_digest

NODE = "level int, head string, prefix string, n_rows long, checksum decimal(20,0)"


def wrapped(total: Column) -> Column:
    return F.pmod(total.cast("decimal(38,0)"), F.lit(str(WRAP)).cast("decimal(38,0)")).cast("decimal(20,0)")


def nodes(rows: DataFrame, depth: int = 4, sign: Column | None = None) -> DataFrame:
    """Nodes of all levels of rows (id, hash); sign, 1 or -1, adds or takes away. Leaves are aggregated first, upper levels from them."""
    s = F.lit(1) if sign is None else sign
    leaves = rows.groupBy(F.substring("id", 1, depth).alias("leaf")).agg(F.sum(s).alias("n"), F.sum(F.col("hash").cast("decimal(20,0)") * s).alias("c"))
    each = leaves.select("n", "c", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level"), "leaf").withColumn("prefix", F.expr("substring(leaf, 1, level)"))
    return _summed(each, F.col("n"), F.col("c"))


def _summed(each: DataFrame, n: Column, c: Column) -> DataFrame:
    sums = each.groupBy("level", "prefix").agg(F.sum(n).alias("n"), F.sum(c.cast("decimal(38,0)")).alias("c"))
    return sums.select("level", F.substring("prefix", 1, 2).alias("head"), "prefix", F.col("n").cast("long").alias("n_rows"), wrapped(F.col("c")).alias("checksum"))


def build(table: DataFrame, keys: Sequence[str], depth: int = 4, **settings) -> DataFrame:
    """The tree of a table as it is."""
    return nodes(with_row_digest(table, keys, **settings), depth)


def apply_changes(tree: DataFrame, changes: DataFrame, depth: int = 4) -> DataFrame:
    """The tree after changes (id, hash, sign): a row's old hash with -1, its new one with 1. Nodes left without rows go."""
    moved = nodes(changes, depth, F.col("sign"))
    both = tree.select("level", "prefix", "n_rows", "checksum").unionByName(moved.select("level", "prefix", "n_rows", "checksum"))
    return _summed(both, F.col("n_rows"), F.col("checksum")).filter("n_rows <> 0 or checksum <> 0")


def store(tree: DataFrame, path: str) -> None:
    """Writes a tree in the order in which it is read; 16 ** depth rows and their parents at most."""
    tree.repartition("level", "head").sortWithinPartitions("level", "head", "prefix").write.partitionBy("level", "head").mode("errorifexists").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(path)


def level_of(tree: DataFrame, level: int, under: Sequence[str] | None) -> DataFrame:
    """Nodes of one level, of those parents only: plain predicates on folders and prefixes, which reach the scan."""
    at = tree.filter(F.col("level") == level)
    if under is None:
        return at
    if level > 2:
        at = at.filter(F.col("head").isin(sorted({p[:2] for p in under})))
    children = [p + d for p in under for d in "0123456789abcdef"]
    return at.filter(F.col("prefix").isin(children))


def unlike(a: DataFrame, b: DataFrame, depth: int = 4, most: int = 256) -> list[str]:
    """Prefixes of the unlike nodes of the deepest level that need be looked at: leaves, or the level above which over `most` nodes are unlike."""
    under: list[str] | None = None
    for level in range(1, depth + 1):
        side = lambda t, n: level_of(t, level, under).select("prefix", F.col("n_rows").alias(f"{n}n"), F.col("checksum").alias(f"{n}c"))  # noqa: E731, B023
        met = side(a, "a").join(side(b, "b"), "prefix", "full_outer").filter(~(F.col("an").eqNullSafe(F.col("bn")) & F.col("ac").eqNullSafe(F.col("bc"))))
        found = sorted(r.prefix for r in met.select("prefix").limit(16 * most + 1).collect())  # 16 children of `most` nodes at most
        under = found
        if len(found) > most or not found:
            break
    return under or []


def diff_by_tree(source: DataFrame, destination: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str], depth: int = 4, **settings) -> DataFrame:
    """diff_rows() of two tables by their stored trees: only rows under unlike nodes are compared."""
    bad = unlike(a, b, depth)
    sides = [with_row_digest(t, keys, **settings) for t in (source, destination)]
    if not bad:
        return diff_rows(meet(*[x.limit(0) for x in sides])).select("id", "kind", "n", "key")
    cut_at = len(bad[0])
    chosen = [x.filter(F.substring("id", 1, cut_at).isin(bad)) for x in sides]
    return diff_rows(meet(*chosen)).select("id", "kind", "n", "key")
