"""Connected components of an undirected graph as Spark jobs: alternating large-star and small-star steps.

Each round points every node's larger neighbours, then all its smaller ones, at the smallest node it sees, until the
edges are stars. Nothing is collected but two numbers a round; each round's edges are written to the shared folder.
The least neighbours are broadcast while there are few edges (counted each round), so that a hub's edges stay where they
are; beyond that they are written, so that both sides of the join are plain shuffles and a hub's share can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncproof.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, max_broadcast_rows: int = 500_000) -> DataFrame:
    """(node, component): component is the smallest node that can be reached. Nodes without edges to others do not occur.

    Defined cases: null ends and loops are dropped; repeated edges count once; no edges give no rows.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = _state(now)
    for _ in range(max_rounds if before[0] else 0):
        few = before[0] <= max_broadcast_rows
        side = F.broadcast if few else cut
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if few else cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = cut(small)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
