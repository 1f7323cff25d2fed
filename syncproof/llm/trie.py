"""A trie of conversation prefixes by Spark SQL's ROLLUP over positional turn-id columns.

Turns get 128-bit ids that hold their place, so the exclusive or of a prefix's ids names the prefix. Conversations are
laid out in blocks of `width` turn-id columns; a block is keyed by the node in which the block before it ended. One
GROUP BY block, node, ROLLUP(t0, t1, ...) aggregates the prefixes of all lengths and blocks together, and grouping_id tells a
row's depth. Long conversations are further blocks, not further rounds.

A second ROLLUP sums over subtrees. Each node belongs to its smallest member, so a conversation owns the end of its path,
and q, the characters before that end, are those it shares with smaller ones. For a node of n members, whose own
smallest one has the least q, the (n_convs - 1) * characters of all nodes below and at it add up to sum(q) - min(q) - (n - 1) *
(characters before the node), so that sums over conversations take the place of sums over descendants.

Defined cases: rows of null conv_id belong to no conversation and are left out; null roles and texts count as empty; turns of equal
number follow by role and text, null turns come first; rows repeated whole are turns of their own; a conversation may be turnless only by being
rebuilt. Conversations and texts of any length are worked whole; other columns are not read. No conversations give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syncproof.llm.common import cut, table
from syncproof.llm.ranks import numbered_within
from syncproof.llm.skew import join_hot

STEP = "a:long, b:long, chars:long"


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, turn_digest, chars): a conversation's turns at 0, 1, 2, ...; role and text as one digest."""
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.filter(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), who.alias("who"), F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256)).alias("turn_digest"), F.length(said).cast("long").alias("chars"), said.alias("said")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("who"), F.col("said")]
    numbered = numbered_within(rows, "conv_id", order, "at")
    return numbered.select("conv_id", F.col("at").cast("long").alias("at"), "turn_digest", "chars")


def conversations_of(steps: DataFrame) -> DataFrame:
    return steps.groupBy("conv_id").agg(F.count("*").alias("n"))


def rebuilt(steps: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, steps) in which the first h turns of each c come from c - c % every, h = crc32(c) % most."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = conversations_of(steps).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = cut(own.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n"))
    first = steps.filter((F.col("at") < most - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.filter("taken > 0").select("conv_id", "base", "h").join(first, "base").filter("at < h").select("conv_id", "at", "turn_digest", "chars")
    rest = join_hot(steps.filter(F.col("at") >= h), convs.select("conv_id", "h", "taken"), ["conv_id"]).select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "turn_digest", "chars")
    return convs.select("conv_id"), lent.unionByName(rest)


def named(steps: DataFrame) -> DataFrame:
    """(conv_id, at, a, b, chars): a and b are the turn's 128-bit id at its place."""
    return steps.select("conv_id", "at", F.xxhash64("turn_digest", "at").alias("a"), F.xxhash64("at", "turn_digest").alias("b"), "chars")


def ends(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, chars): the node in which each conversation ends."""
    sums = steps.groupBy("conv_id").agg(F.count("*").alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("chars").alias("chars"))
    none = F.lit(0).cast("long")
    return convs.join(sums, "conv_id", "left").select("conv_id", *[F.coalesce(c, none).alias(c) for c in ("depth", "a", "b", "chars")])


def blocks(last: DataFrame, steps: DataFrame, width: int, run: int = 1024) -> DataFrame:
    """(conv_id, block, a, b, chars, t0, t1, ...): a, b and chars sum up what lies before the block; t are turn ids, null past the end.

    Sums are carried within runs of `run` blocks and over runs, so that no task reads the blocks of one endless conversation.
    """
    parts = ("a", "b", "chars")
    total = {"a": F.bit_xor, "b": F.bit_xor, "chars": F.sum}
    add = {"a": lambda x, y: x.bitwiseXOR(y), "b": lambda x, y: x.bitwiseXOR(y), "chars": lambda x, y: x + y}
    packed = F.transform(F.sort_array(F.collect_list(F.struct("at", *parts))), lambda s: F.struct(*[s[c].alias(c) for c in parts]))
    laid = cut(steps.groupBy("conv_id", F.expr(f"at div {width}").alias("block")).agg(packed.alias("t"), *[total[c](c).alias(c) for c in parts]).withColumn("run", F.expr(f"block div {run}")))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = laid.groupBy("conv_id", "run").agg(*[total[c](c).alias(c) for c in parts])
    runs = runs.select("conv_id", "run", *[F.coalesce(total[c](c).over(before("conv_id").orderBy("run")), F.lit(0)).alias(f"run_{c}") for c in parts]).filter("run > 0")
    within = laid.select("conv_id", "run", "block", "t", *[F.coalesce(total[c](c).over(before("conv_id", "run").orderBy("block")), F.lit(0)).alias(c) for c in parts])
    carried = within.join(runs, ["conv_id", "run"], "left").select("conv_id", "block", "t", *[add[c](F.col(c), F.coalesce(f"run_{c}", F.lit(0))).alias(c) for c in parts])
    bare = last.filter("depth = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.array().cast(f"array<struct<{STEP}>>").alias("t"), *[F.lit(0).cast("long").alias(c) for c in parts])
    return carried.unionByName(bare).select("conv_id", "block", *parts, *[F.get("t", F.lit(i)).alias(f"t{i}") for i in range(width)])


def rolled(laid: DataFrame, width: int, measures: str) -> DataFrame:
    """One row for each node: depth, key (a, b), the parent's key, chars_before, last_chars and the measures over its members."""
    t = [f"t{i}" for i in range(width)]
    groups = laid.sparkSession.sql(f"select block, a, b, chars, {', '.join(t)}, {width} - bit_count(grouping_id()) level, {measures} from {{laid}} group by block, a, b, chars, rollup({', '.join(t)})", laid=laid)
    filled = sum((F.col(c).isNotNull().cast("int") for c in t), F.lit(0))
    part = lambda c: [F.coalesce(F.col(f"{x}.{c}"), F.lit(0)) for x in t]
    last = lambda c: F.coalesce(*[F.col(f"{x}.{c}") for x in reversed(t)], F.lit(0))

    def xor(c: str) -> Column:
        out = F.col(c)
        for x in part(c):
            out = out.bitwiseXOR(x)
        return out

    out = groups.filter((F.col("level") == filled) & ((F.col("level") > 0) | (F.col("block") == 0)))
    kept = [c for c in groups.columns if c not in {"block", "a", "b", "chars", "level", *t}]
    return out.select(
        (F.col("block") * width + F.col("level")).alias("depth"), xor("a").alias("node_a"), xor("b").alias("node_b"), xor("a").bitwiseXOR(last("a")).alias("parent_a"), xor("b").bitwiseXOR(last("b")).alias("parent_b"),
        (F.col("chars") + sum(part("chars"), F.lit(0)) - last("chars")).alias("chars_before"), last("chars").alias("last_chars"), *kept,
    )


def trie(last: DataFrame, steps: DataFrame, width: int = 8) -> DataFrame:
    """(depth, node_a, node_b, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of every distinct prefix."""
    key, up = ["depth", "node_a", "node_b"], ["depth", "parent_a", "parent_b"]
    laid = cut(blocks(last, steps, width))
    nodes = cut(rolled(laid, width, "count(*) n_convs, min(conv_id) conv_id"))
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children")).select((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("node_a"), F.col("parent_b").alias("node_b"), "n_children")
    nodes = cut(nodes.join(children, key, "left").fillna(0, ["n_children"]))
    owned = nodes.groupBy("conv_id").agg(F.sum(F.when(F.col("depth") > 0, F.col("last_chars")).otherwise(0)).alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    shares = cut(last.select("conv_id", F.col("chars").alias("total")).join(owned, "conv_id", "left").select("conv_id", (F.col("total") - F.coalesce("own", F.lit(0))).alias("q"), F.coalesce("leaves", F.lit(0)).alias("leaves")))
    sums = rolled(join_hot(laid, shares, ["conv_id"]), width, "sum(q) q, min(q) least_q, sum(leaves) n_leaves").select(*key, "q", "least_q", "n_leaves")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node_a").alias("parent_a"), F.col("node_b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    found = join_hot(nodes, parents, up).join(sums, key)
    saved = F.col("q") - F.col("least_q") - (F.col("n_convs") - 1) * F.col("chars_before")
    return found.select(*key, "conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"))


def joined_ids(last: DataFrame, piece_chars: int = 1 << 20) -> DataFrame:
    """(depth, a, b, first, piece): the decimal conv_ids that end in each node, ascending and comma-joined, in pieces of bounded size.

    Rows are dealt by ranges of (node, conv_id), so that the copies of one conversation are spread.
    """
    n, order = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["depth", "a", "b", "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, done = None, [], 0, []
        for batch in batches:
            for *now, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != key or held >= piece_chars:
                    if ids:
                        done.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids, held = now, [], 0
                ids.append(conv)
                held += 20
                if len(done) >= 2000 or (done and len(done[-1][4]) > 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                    done = []
        if ids:
            done.append((*key, ids[0], ",".join(map(str, ids))))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
    return last.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, "depth long, a long, b long, first long, piece string")


def end_digests(last: DataFrame, piece_chars: int = 1 << 20) -> DataFrame:
    """(depth, node_a, node_b, ends_sha256): SHA-256 of the joined ids. A digest reads its bytes in order, so a node's
    pieces (one for some 50,000 ids) go through one task, one at a time."""
    key = ["depth", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for *k, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k == now:
                    state.update(b"," + piece.encode())
                    continue
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = k, hashlib.sha256(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, state.hexdigest()), schema, strict=True)], schema=schema)

    schema = pa.schema([("depth", pa.int64()), ("node_a", pa.int64()), ("node_b", pa.int64()), ("ends_sha256", pa.string())])
    pieces = joined_ids(last, piece_chars).repartition(*key).sortWithinPartitions(*key, "first").select(*key, "piece")
    return pieces.mapInArrow(run, "depth long, node_a long, node_b long, ends_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, steps = rebuilt(cut(turns(table(spark, sf_dir, "conversations"))))
    steps = cut(named(steps))
    last = cut(ends(convs, steps))
    found = trie(last, steps).join(end_digests(last), ["depth", "node_a", "node_b"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


SQL = r"""
with o as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 k from conversations where conv_id is not null),
l as (select conv_id, list(struct_pack(r := r, x := x) order by k) w from o group by conv_id),
h as (select conv_id, w, conv_id - conv_id % 100 base, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: case when y >= 0 then xor(x, y) when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end), 4294967295) % 6 h from l),
c as (select h.conv_id, list_concat(coalesce(b.w[1:h.h], []), coalesce(h.w[h.h + 1:], [])) p from h left join l b on b.conv_id = h.base),
m as (select conv_id, d, p[1:d] p from (select conv_id, p, unnest(range(0, len(p) + 1)) d from c)),
n as (select p, d, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * case when d = 0 then 0 else length(p[d].x) end saved from m group by p, d),
k as (select p[1:d - 1] p, count(*) n from n where d > 0 group by 1),
t as (select n.*, coalesce(k.n, 0) n_children from n left join k using (p)),
s as (select u.p, sum(case when v.n_children = 0 then 1 else 0 end) n_leaves, sum(v.saved) saved_tokens from t v, lateral (select unnest(range(0, v.d + 1)) j) q, t u where u.d = q.j and u.p = v.p[1:q.j] group by 1),
e as (select p, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) e from c group by p)
select t.conv_id, cast(t.d as bigint) depth, case when t.d > 0 then b.conv_id end parent_conv_id, t.n_convs, t.n_children, cast(s.n_leaves as bigint) n_leaves, cast(s.saved_tokens as bigint) saved_tokens, coalesce(e.e, sha256('')) ends_sha256
from t join s using (p) left join e using (p) left join t b on t.d > 0 and b.p = t.p[1:t.d - 1]
"""
