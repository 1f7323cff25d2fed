"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a byte-position inverted index with count filtering.

Fingerprints that differ in at most 3 of 64 bits share at least 5 of their 8 positional bytes. Postings of single
bytes would hold N/256 fingerprints each, so postings here are keyed by four positional bytes: the 14 byte sets of the
Steiner system S(3,4,8), of which every pair with at most 3 unlike bytes shares at least one. Within a posting the
shared positional bytes of each pair are tallied, pairs below 5 dropped, and the others verified bit by bit.

A posting of more than `dense` fingerprints (near copies by the thousand) is keyed anew by four of the eight pieces
of its other bytes, nibbles first, then bit pairs; at that depth a posting holds 256 at most, so no group is
unbounded and no link is lost. From each posting only a spanning forest of its links goes on.

Defined cases: no words (null, empty, blank): fingerprint zero, linked like any other; copies share a fingerprint and so a
component; a component's id is its smallest doc_id (null only if all its ids are null); extra columns are kept in `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.llm.common import cut, map_documents, table
from syncproof.llm.components import components
from syncproof.llm.linking import bounded


def quadruples() -> list[tuple[int, ...]]:
    """The 14 blocks of S(3,4,8): the 4-subsets of the corners of a cube whose numbers xor to zero."""
    return [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def fingerprints(width: int = 3, seed: int = 42):
    """Of UTF-8 texts: a bit is 1 if it is set in over half the XXH64 hashes of the width-word shingles, repeats included."""
    def make():
        hashed, join = xxhash.xxh64_intdigest, b" ".join

        def run(texts: list[bytes | None]) -> list[list]:
            out = []
            for text in texts:
                words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
                shingles = map(join, zip(*[words[i:] for i in range(width)], strict=False)) if len(words) > width else [join(words)] if words else []
                h = np.fromiter((hashed(s, seed) for s in shingles), np.uint64)
                out.append(majority(h))
            return [out]

        return run

    return make


def majority(h: np.ndarray, block: int = 4096) -> int:
    """As a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), block):
        counts += np.unpackbits(h[i : i + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, text: str = "text") -> DataFrame:
    """(doc struct, fingerprint long)."""
    return map_documents(docs, fingerprints(width, seed), [T.StructField("fingerprint", T.LongType())], text)


def links(fps: DataFrame, most_bits: int = 3, dense: int = 512) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fingerprint) that differ in at most most_bits (3) bits; enough of them to connect all that do."""
    if most_bits > 3:
        raise ValueError("the byte sets hold for at most 3 differing bits")
    rows = fps.select("fingerprint").distinct().select("fingerprint", F.lit(0).cast("long").alias("key"), F.array(*[F.lit(s) for s in range(0, 64, 8)]).alias("free"))
    found = None
    for bits in (8, 4, 2):
        posted = rows.select("fingerprint", F.explode(_postings(bits)).alias("p")).select("fingerprint", "p.key", "p.free")
        sizes = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        sized = cut(posted.join(sizes.hint("merge"), "key"))  # Spark does not see that the entries are 14 times the rows, and would broadcast them
        whole = (F.col("n") <= dense) | F.lit(bits == 2)  # in the last, 256 at most share a key
        pairs = sized.filter(whole).groupBy("key").agg(F.collect_list("fingerprint").alias("members")).select("members").mapInArrow(_forests(most_bits), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        rows = sized.filter(~whole).select("fingerprint", "key", "free")
        if bits == 2 or rows.isEmpty():
            break
    return found.distinct()


def _postings(bits: int) -> Column:
    """Of a row (fingerprint, key, free: shifts of its 8 pieces of so many bits): an entry for each set of four pieces; its free pieces are the halves of the other four."""
    out = []
    for i, q in enumerate(quadruples()):
        held = [F.expr(f"shiftrightunsigned(fingerprint, free[{k}]) & {(1 << bits) - 1}") for k in q]
        free = [x for k in range(8) if k not in q for x in (F.expr(f"free[{k}]"), F.expr(f"free[{k}] + {bits // 2}"))]
        out.append(F.struct(F.xxhash64("key", F.lit(i), *held).alias("key"), F.array(*free).alias("free")))
    return F.array(*out)


def _forests(most_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                for x, y in forest(np.array(members, np.int64), most_bits):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def forest(members: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among members: shared positional bytes are tallied, then bits counted."""
    m = np.unique(members)
    as_bytes = m.view(np.uint8).reshape(-1, 8)
    boss = list(range(len(m)))

    def find(i: int) -> int:
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i

    out = []
    for i in range(1, len(m)):
        tally = (as_bytes[:i] == as_bytes[i]).sum(axis=1)
        near = np.flatnonzero(tally >= 8 - most_bits)
        near = near[np.bitwise_count((m[near] ^ m[i]).view(np.uint64)) <= most_bits]
        for j in near:
            if (p := find(int(j))) != (q := find(i)):
                boss[q] = p
                out.append((int(m[j]), int(m[i])))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc struct, fingerprint long, root: a fingerprint of the component, component_id): component_id is the smallest doc_id reachable over links."""
    out = _classed(cut(with_fingerprints(docs, text=text)), doc_id, max_broadcast_rows)
    return out.withColumn("root", F.coalesce("root", "fingerprint"))


def _classed(found: DataFrame, doc_id: str, max_broadcast_rows: int) -> DataFrame:
    """found (doc, fingerprint) with root and component_id; root is null where a fingerprint is held once and has no link.

    Documents become one row a fingerprint before anything is joined, and only fingerprints of several documents or of links go on,
    so that neither a text with many copies nor a large component brings its documents together.
    """
    each = cut(found.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(F.col(f"doc.`{doc_id}`")).alias("least")))
    roots = bounded(components(links(each)), max_broadcast_rows)
    several = each.join(roots, each["fingerprint"] == roots["node"], "left").filter("component is not null or n > 1")
    several = cut(several.select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root")))
    ids = cut(several.groupBy("root").agg(F.min("least").alias("component_id")))
    judged = cut(several.select("fingerprint", "root").join(bounded(ids, max_broadcast_rows), "root").select("fingerprint", "root", "component_id"))
    joined = found.join(bounded(judged, max_broadcast_rows), "fingerprint", "left")
    return joined.select("doc", "fingerprint", "root", F.when(F.col("root").isNull(), F.col(f"doc.`{doc_id}`")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id, of several texts with that id the one of the smallest hash.

    Texts stay where they are: the ids to drop are broadcast up to a counted bound, and joined by shuffle beyond it.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = with_fingerprints(slim).select(F.struct("doc.doc_id", F.xxhash64("doc.text").alias("h")).alias("doc"), "fingerprint")
    each = cut(_classed(cut(found), "doc_id", max_broadcast_rows).filter("root is not null").groupBy("root", "doc.doc_id", "doc.h").agg(F.count("*").alias("copies")))
    first = cut(each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("h"))).alias("first")))
    judged = each.join(bounded(first, max_broadcast_rows), "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")))
    gone = cut(judged.filter(~F.col("stays") | (F.col("copies") > 1)).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"), "stays"))
    n, repeated = gone.agg(F.count("*"), F.count_if("stays")).first()
    side = F.broadcast(gone) if n <= max_broadcast_rows else gone
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    on = F.col(f"doc.`{doc_id}`").eqNullSafe(F.col("gone_id")) & (F.xxhash64(f"doc.`{text}`") == F.col("gone_h"))
    kept = rows.join(side, on, "left_anti")
    if repeated:  # rows repeated with id and text: one of them stays
        again = rows.join(side.filter("stays"), on).groupBy("gone_id", "gone_h").agg(F.first("doc").alias("doc")).select("doc")
        kept = kept.unionByName(again)
    return kept.select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
