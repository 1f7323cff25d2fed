"""Verified links among the members of postings, in passes that leave no pair of a posting out.

First, in each posting two members drawn by member and key are paired with all others (linear, so that large families
become one component at once). Where a posting still holds several components, its other pairs across them are tried as well:
one by one up to `dense` members; in larger postings by blocks of some hundred members, whose sets are compared all at once
in numpy, so that no row is made for a pair. So no similar pair that shares a posting is lost.

Defined cases: no postings give no links; a member that stands in no posting with another has no link.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncproof.llm.common import cut
from syncproof.llm.components import components
from syncproof.llm.sets import common_values, distinct, similar_pairs, with_texts

Shingles = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, else to be shuffled, whatever size Spark takes it for; df must be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def drawn(postings: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """(id, key), no row twice -> (id, key, lo, hi: two ids drawn from the posting), for the postings of several ids."""
    draw = F.col("id").bitwiseXOR(F.col("key"))
    ends = postings.groupBy("key").agg(F.min(draw).alias("lo"), F.max(draw).alias("hi")).filter("lo <> hi")
    ends = cut(ends.select("key", *[F.col(c).bitwiseXOR(F.col("key")).alias(c) for c in ("lo", "hi")]))
    return cut(postings.join(bounded(ends, max_broadcast_rows), "key").select("id", "key", "lo", "hi"))


def drawn_pairs(members: DataFrame) -> DataFrame:
    """(a, b): the drawn ids of each posting with all its others."""
    each = members.select("id", F.explode(F.array("lo", "hi")).alias("other")).filter("id <> other")
    return each.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def unsettled(members: DataFrame, roots: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """members of the postings that hold several components, with root and n: the posting's size."""
    rooted = members.join(bounded(roots, max_broadcast_rows), F.col("id") == F.col("node"), "left").select("id", "key", "lo", "hi", F.coalesce("component", "id").alias("root"))
    sizes = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most and n > 3")
    return rooted.join(bounded(cut(sizes.select("key", "n")), max_broadcast_rows), "key")


def across(several: DataFrame) -> DataFrame:
    """(a, b): the pairs of a posting across its components, without those of the drawn ids."""
    rest = several.filter("id <> lo and id <> hi")
    x, y = (rest.select("key", F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
    return x.join(y, "key").filter("a < b and root_a <> root_b").select("a", "b").distinct()


def in_blocks(several: DataFrame, texts: DataFrame, shingles: Shingles, similar: float, members: int = 256, chars: int = 1 << 22) -> DataFrame:
    """(a, b): links that connect what is similar across the components of each posting, found in pairs of blocks of so many members and characters."""
    long = cut(several.select("key", "id", "root", "n").join(texts, "id"))
    sizes = long.groupBy("key").agg(F.sum(F.length("content")).alias("chars"))
    blocks = F.ceil(F.greatest(F.col("n") / members, F.col("chars") / chars)).cast("int")
    dealt = long.join(F.broadcast(sizes) if sizes.count() < 100_000 else sizes, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = each.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "root", "content")

    def compare(group: pa.Table) -> pa.Table:
        own, ids, roots = (group.column(c).to_numpy() for c in ("own", "id", "root"))
        lo, hi = (group.column(c)[0].as_py() for c in ("lo", "hi"))
        x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        found = []
        if len(np.unique(roots)) > 1:
            common, sizes = common_values(*distinct(*shingles(group.column("content").combine_chunks())), x, y)
            near = common >= similar * (sizes[x][:, None] + sizes[y] - common)
            p, q = np.nonzero(near & (roots[x][:, None] != roots[y]))
            found = forest(x[p], y[q], roots)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return met.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")


def forest(p: np.ndarray, q: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (p[i], q[i]) so many as connect their members' components."""
    boss: dict[int, int] = {}

    def find(r: int) -> int:
        while (up := boss.get(r, r)) != r:
            boss[r] = boss.get(up, up)
            r = up
        return r

    out = []
    for i, j in zip(p.tolist(), q.tolist(), strict=True):
        if (a := find(int(roots[i]))) != (b := find(int(roots[j]))):
            boss[a] = b
            out.append((i, j))
    return out


def links(members: DataFrame, texts: DataFrame, shingles: Shingles, similar: float, max_broadcast_rows: int = 1_000_000, dense: int = 64) -> DataFrame:
    """(a, b): verified links; enough of them to connect all similar ids that share a posting.

    members: drawn()'s. texts: (id, content) of them. shingles: texts to (hashes of their elements end to end, counts).
    """
    verify = lambda pairs: similar_pairs(with_texts(pairs, texts), shingles, similar)
    found = cut(verify(drawn_pairs(members)))
    several = cut(unsettled(members, components(found), max_broadcast_rows))
    large = several.filter(F.col("n") > dense)
    rest = verify(across(several.filter(F.col("n") <= dense)))
    return found.unionByName(cut(rest if large.isEmpty() else rest.unionByName(in_blocks(large, texts, shingles, similar))))
