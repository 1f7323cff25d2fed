"""Document fingerprints by MinHash: signatures of word shingles under many affine permutations, compared place by place.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; shingles are five words (fewer words: the whole sequence; none: an own
value). A fingerprint is one 16-bit number for each of 128 permutations, as 512 hex digits; likeness is the share of
equal places, an estimate of the Jaccard similarity of the shingle sets. Bands of the places are then joined in Spark, the
Jaccard similarity of the joined pairs is verified, and each document gets the class that its links and copies make.

Defined cases: null text counts as empty; equal texts have equal fingerprints; two texts without words are alike (1.0);
rows of equal doc_id follow each other by a hash of the text; a table of one row is its own next document; an empty one gives
no rows; texts of any length are worked whole; a null doc_id is last, and a class of null ids alone has a null class_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.llm.common import cut, map_documents, table
from syncproof.llm.components import components
from syncproof.llm.linking import bounded, drawn, links
from syncproof.llm.minhash import mixed, permutations, signatures
from syncproof.llm.sets import spread

SHINGLE, PLACES, SIMILAR, SEED = 5, 128, 0.8, 4


class WordHashes(dict):
    """word -> 32-bit hash; starts anew when it has grown large, so that a task's memory is bounded."""

    hashed = staticmethod(xxhash.xxh32_intdigest)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = self.hashed(word)
        return h


def shingle_hashes(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    """At least one 32-bit value; repeats are kept."""
    if not words:
        return np.zeros(1, np.uint32)
    ids = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
    width = min(width, len(ids))
    h = np.full(len(ids) - width + 1, 0x51ED270B, np.uint32)
    for j in range(width):
        h = h * np.uint32(0x01000193) + ids[j : j + len(h)]
        h ^= h >> np.uint32(15)
    return mixed(h)


def signatures_of(texts: list[bytes], width: int, a: np.ndarray, b: np.ndarray, known: WordHashes, block: int = 1 << 14) -> np.ndarray:
    out, held, total = [np.empty((0, len(a)), np.uint32)], [], 0
    for i, text in enumerate(texts):
        held.append(shingle_hashes(text.lower().split(), width, known))
        total += len(held[-1])
        if total >= block or i == len(texts) - 1:
            ends = np.cumsum([len(h) for h in held])
            out.append(signatures(np.concatenate(held), np.concatenate(([0], ends[:-1])), a, b))
            held, total = [], 0
    return np.concatenate(out)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=-1)


# --- each document, its edited text and the next document ---------------------------------------------------------


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """docs (doc_id, text) range-partitioned and sorted by descending doc_id, with the partition's number."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("mark")]
    return keyed(docs, "doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(*order)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, mark: two hashes of the text, text)."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(1), whole).alias("mark"), whole.alias("text"))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_with_next(docs: DataFrame, width: int = SHINGLE, places: int = PLACES, seed: int = SEED) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Texts are shuffled once, into ranges of descending doc_id; a range's neighbours are then met within its task. Only
    the last row of each range lacks its next document: these rows (one a range) wait for the first text of the
    range after, which is joined to them.
    """
    return _shown(_signed(docs, width, places, seed).drop("h", "mark"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.lower(F.hex(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType) and f.name != "doc_id" else f.name for f in rows.schema])


def _signed(docs: DataFrame, width: int, places: int, seed: int) -> DataFrame:
    """fingerprint_with_next() in binary, with h and mark: two hashes of the text."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    key = [("doc_id", kind), ("h", T.LongType()), ("mark", T.LongType())]
    fields = [*key, ("n_chars", T.LongType()), ("edited_sha256", T.BinaryType()), ("fingerprint", T.BinaryType()), ("edited_fingerprint", T.BinaryType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
    edge = [("range_no", T.IntegerType()), ("first_text", T.StringType()), ("last_text", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in [*fields, *edge]])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        judge = _judge(width, places, seed)
        waiting = None  # the row that has not met its next document
        first, number = None, TaskContext.get().partitionId()
        for batch in batches:
            for part in _pieces(batch):
                keys, texts = list(zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)), part.column(3).to_pylist()
                if first is None:
                    first = texts[0]
                if waiting:
                    keys, texts = [waiting[0], *keys], [waiting[1], *texts]
                if len(keys) > 1:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, [*k, *row, None, None, None], strict=True)) for k, row in zip(keys, judge(texts[:-1], texts[1:]), strict=False)], schema=arrow)
                waiting = keys[-1], texts[-1]
        if waiting:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, waiting[0], strict=False)) | {"range_no": number, "first_text": first, "last_text": waiting[1]}], schema=arrow)

    done = cut(with_next(docs).mapInArrow(run, schema), free_shuffles=True)
    edges = done.filter("range_no is not null")
    numbers = sorted(r.range_no for r in edges.select("range_no").collect())  # one for each range, whatever the rows
    after = spark.createDataFrame([(a, b) for a, b in zip(numbers, [*numbers[1:], *numbers[:1]], strict=True)], "range_no int, next_no int")
    firsts = edges.select(F.col("range_no").alias("next_no"), F.col("first_text").alias("following"))
    names = [n for n, _ in key]
    met = edges.select("range_no", *names, "last_text").join(F.broadcast(after), "range_no").join(firsts, "next_no").select(*names, "last_text", "following")
    tail = pa.schema([arrow.field(n) for n, _ in fields])

    def run_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(width, places, seed)
        for batch in batches:
            for i in range(batch.num_rows):
                *k, x, y = (batch.column(c)[i].as_py() for c in range(5))
                yield pa.RecordBatch.from_pylist([dict(zip(tail.names, [*k, *judge([x], [y])[0]], strict=True))], schema=tail)

    return done.filter("range_no is null").select(*[n for n, _ in fields]).unionByName(met.mapInArrow(run_edges, T.StructType([T.StructField(n, t) for n, t in fields])))


def _judge(width: int, places: int, seed: int):
    """f(texts, next texts) -> rows without doc_id."""
    a, b = permutations(places, seed)
    known = WordHashes()

    def judge(texts: list[str], following: list[str]) -> list[list]:
        changed = [edited(x, y) for x, y in zip(texts, following, strict=True)]
        own = [*texts, following[-1]]
        sign = signatures_of([t.encode() for t in [*own, *changed]], width, a, b, known).astype(">u2")
        text_sign, changed_sign = sign[: len(own)], sign[len(own) :]
        near_edited, near_next = likeness(text_sign[:-1], changed_sign), likeness(text_sign[:-1], text_sign[1:])
        return [[len(texts[i]), hashlib.sha256(changed[i].encode()).digest(), text_sign[i].tobytes(), changed_sign[i].tobytes(), float(near_edited[i]), float(near_next[i])] for i in range(len(texts))]

    return judge


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    from syncproof.llm.common import slices

    return slices(batch, "text", rows=128, nbytes=1 << 20)


def _arrow(kind: T.DataType) -> pa.DataType:
    from syncproof.llm.common import arrow_type

    return arrow_type(kind)


# --- near-duplicate classes -----------------------------------------------------------------------------------------


def word_shingles(width: int):
    """f(texts) -> (64-bit hashes of the word shingles of each text, end to end, repeats included; their counts)."""
    known = LongWordHashes()

    def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for text in texts.to_pylist():
            words = text.encode().lower().split()
            ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) if words else np.zeros(1, np.uint64)
            n = min(width, len(ids))
            h = np.full(len(ids) - n + 1, n, np.uint64)
            for j in range(n):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += ids[j : j + len(h)]
            out.append(spread(h))
        return np.concatenate(out) if out else np.zeros(0, np.uint64), np.fromiter(map(len, out), np.int64, len(out))

    return shingles


class LongWordHashes(WordHashes):
    """word -> 64-bit hash."""

    hashed = staticmethod(xxhash.xxh3_64_intdigest)


def classes(signed: DataFrame, docs: DataFrame, bands: int = 25, rows: int = 5, width: int = SHINGLE, similar: float = SIMILAR, max_broadcast_rows: int = 1_000_000, dense: int = 64) -> DataFrame:
    """(h, mark, class_id) of the texts that have copies or links; class_id: the smallest doc_id that they reach.

    signed: (doc_id, h, mark, fingerprint of 16-bit places) of all documents. docs: keyed() documents. Copies meet by the two hashes of their text; distinct
    texts that share a band of places are paired (see linking), and the Jaccard similarity of the shingle sets of the whole texts is verified.
    """
    distinct = signed.groupBy("h", "mark").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("fingerprint").alias("fingerprint"))
    texts = cut(distinct.withColumn("id", F.monotonically_increasing_id()))
    band = [F.xxhash64(F.lit(j), F.substring("fingerprint", 1 + 2 * rows * j, 2 * rows)) for j in range(bands)]
    members = drawn(texts.select("id", F.explode(F.array(*band)).alias("key")), max_broadcast_rows)
    needed = cut(texts.select("id", "h", "mark").join(bounded(cut(members.select("id").distinct()), max_broadcast_rows), "id"))
    whole = cut(docs.join(bounded(needed, max_broadcast_rows), ["h", "mark"]).groupBy("id").agg(F.first("text").alias("content")))
    roots = bounded(components(links(members, whole, word_shingles(width), similar, max_broadcast_rows, dense)), max_broadcast_rows)
    several = texts.join(roots, texts["id"] == roots["node"], "left").filter("component is not null or n > 1")
    several = cut(several.select("h", "mark", "least", F.coalesce("component", "id").alias("root")))
    ids = cut(several.groupBy("root").agg(F.min("least").alias("class_id")))
    return cut(several.select("h", "mark", "root").join(bounded(ids, max_broadcast_rows), "root").select("h", "mark", "class_id"))


def with_classes(signed: DataFrame, docs: DataFrame, max_broadcast_rows: int = 1_000_000, **settings) -> DataFrame:
    found = classes(signed, docs, max_broadcast_rows=max_broadcast_rows, **settings).withColumn("_found", F.lit(True))
    joined = signed.join(bounded(found, max_broadcast_rows), ["h", "mark"], "left")
    return joined.withColumn("class_id", F.when(F.col("_found"), F.col("class_id")).otherwise(F.col("doc_id"))).drop("h", "mark", "_found")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", places: int = PLACES, width: int = SHINGLE, seed: int = SEED, **settings) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of the documents that links and equal texts join."""
    rows = keyed(docs, doc_id, text)

    def make():
        a, b = permutations(places, seed)
        known = WordHashes()
        return lambda texts: [[x.tobytes() for x in signatures_of(texts, width, a, b, known).astype(">u2")]]

    signed = cut(map_documents(rows, make, [T.StructField("fingerprint", T.BinaryType())]).select("doc.doc_id", "doc.h", "doc.mark", "fingerprint"))
    return with_classes(signed, rows, width=width, **settings).select("doc_id", "class_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _shown(with_classes(_signed(docs, SHINGLE, PLACES, SEED), keyed(docs, "doc_id", "text")))


def shingle_set(text: str, width: int) -> set[tuple[bytes, ...]]:
    words = text.encode().lower().split()
    width = min(width, len(words))
    return set(zip(*[words[i:] for i in range(width)], strict=False)) if words else {()}
