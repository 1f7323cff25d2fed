"""Line deduplication: one line stays of each set of equal or nearly equal lines over all documents.

Lines are compared with A-Z lowered and white space runs as one space. Equal lines meet by their 128-bit hash and are one
row from there on. Distinct lines meet by MinHash: signatures over character shingles, bands of them as posting keys,
of which every pair across components is tried (see linking). The exact Jaccard similarity of every pair is verified on
the texts, and verified links are joined to components by distributed union-find. A component keeps its first line by
(doc_id, line number).

All lines that are not blank are compared; lines shorter than a shingle (`shingle`, a parameter, 8 characters) are near no other, so they meet by
their hash alone. `min_chars`, 1 unless told otherwise, leaves shorter lines (normalised) alone.

Defined cases: a null text stays null and has no lines; null doc_ids come last; rows repeated with id and text are one
document, whose lines stay or go in all copies; equal ids of unlike texts are ordered by a hash of the text; texts and lines
of any length are worked whole, a single line in one piece; documents with extra columns keep them, whatever their names;
no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.llm.common import cut, slices, table
from syncproof.llm.components import components
from syncproof.llm.linking import bounded, drawn, links
from syncproof.llm.minhash import band_keys, mixed, permutations, signatures
from syncproof.llm.sets import char_shingles

SHINGLE, BANDS, ROWS, SIMILAR, MIN_CHARS = 8, 9, 4, 0.8, 1
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\v\f\r", b"abcdefghijklmnopqrstuvwxyz    ")


def eligible(text: bytes | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, normalised line) of the lines that are compared."""
    if not text:
        return []
    text = text.translate(FOLD)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    lines = [(i, x.strip(b" ")) for i, x in enumerate(text.split(b"\n"))]
    return [(i, x) for i, x in lines if len(x) >= min_chars and (len(x) >= 4 * min_chars or len(x.decode(errors="replace")) >= min_chars)]


def line_bands(texts: list[str], shingle: int, a: np.ndarray, b: np.ndarray, rows: int, block: int = 1 << 17) -> np.ndarray:
    """Band keys of lines of at least `shingle` characters, worked in blocks that fit a processor's cache."""
    out, start, total = [np.empty((0, len(a) // rows), np.int64)], 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= block or i == len(texts) - 1:
            out.append(_bands(texts[start : i + 1], shingle, a, b, rows))
            start, total = i + 1, 0
    return np.concatenate(out)


def _bands(texts: list[str], k: int, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - k + 1
    h = np.zeros(n, np.uint32)
    for j in range(k):
        h *= np.uint32(0x01000193)
        h += codes[j : j + n]
    ends = np.cumsum([len(t) for t in texts])
    inside = np.ones(n, bool)
    for j in range(1, k):
        inside[(ends - j)[ends - j < n]] = False  # shingles over a line's end
    counts = np.diff(ends, prepend=0) - k + 1
    return band_keys(signatures(mixed(h[inside]), np.cumsum(counts) - counts, a, b), rows)


def hashes(lines: list[bytes]) -> np.ndarray:
    """(lines, 2): the halves of their 128-bit hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = 10) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, h: hash of the text, line_no, line and mark: halves of its hash, k0, k1, ...: band keys, null for lines shorter than a shingle)."""
    long = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([docs.schema["doc_id"], long("h"), T.StructField("line_no", T.IntegerType()), long("line"), long("mark"), *[long(f"k{j}") for j in range(bands)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(bands * rows, seed)
        for batch in batches:
            for part in slices(batch, "text"):
                of, numbers, lines = _lines(part, min_chars)
                both = hashes(lines)
                texts = [x.decode(errors="replace") if len(x) >= shingle else "" for x in lines]
                short = np.fromiter(map(len, texts), np.int64, len(texts)) < shingle
                keys = np.zeros((len(lines), bands), np.int64)
                keys[~short] = line_bands([t for t, s in zip(texts, short, strict=True) if not s], shingle, a, b, rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(numbers, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), *[pa.array(keys[:, j], mask=short) for j in range(bands)]], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema)


def _lines(part: pa.RecordBatch, min_chars: int) -> tuple[pa.Array, list[int], list[bytes]]:
    of, numbers, lines = [], [], []
    for d, text in enumerate(part.column(part.schema.names.index("text")).cast(pa.binary()).to_pylist()):
        for i, x in eligible(text, min_chars):
            of.append(d)
            numbers.append(i)
            lines.append(x)
    return pa.array(of, pa.int32()), numbers, lines


def distinct_lines(found: DataFrame) -> DataFrame:
    """(id, line, mark, n: occurrences, k0, k1, ...): a row for each distinct line; ids are given once and written."""
    keys = [c for c in found.columns if c not in ("doc_id", "h", "line_no", "line", "mark")]
    each = found.groupBy("line", "mark").agg(F.count("*").alias("n"), *[F.first(k).alias(k) for k in keys])
    return cut(each.withColumn("id", F.monotonically_increasing_id()))


def texts_of(docs: DataFrame, needed: DataFrame, min_chars: int, max_broadcast_rows: int) -> DataFrame:
    """needed (id, line, mark) -> (id, content) of these lines. Up to the bound their hashes go to the tasks, which pass on no other lines."""
    few = needed.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    wanted = docs.sparkSession.sparkContext.broadcast(np.unique(needed.select("line").toArrow().column(0).to_numpy())) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = list(dict.fromkeys(_lines(part, min_chars)[2]))
                both = hashes(lines)
                if wanted is not None:
                    keep = np.flatnonzero(wanted.value[np.searchsorted(wanted.value[:-1], both[:, 0])] == both[:, 0]) if len(wanted.value) else []
                    lines, both = [lines[i] for i in keep], both[keep]
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([x.decode(errors="replace") for x in lines], pa.string())], names=["line", "mark", "content"])

    every = docs.select("text").mapInArrow(run, "line long, mark long, content string")
    return cut(every.join(F.broadcast(needed) if few else needed, ["line", "mark"]).groupBy("id").agg(F.first("content").alias("content")))


def similar_lines(docs: DataFrame, lines: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, min_chars: int = MIN_CHARS, max_broadcast_rows: int = 1_000_000, dense: int = 64) -> DataFrame:
    """(a, b): verified links between the ids of distinct lines; enough of them to connect all similar lines that share a band."""
    keys = [c for c in lines.columns if c not in ("id", "line", "mark", "n")]
    members = drawn(lines.select("id", F.explode(F.array(*keys)).alias("key")).filter("key is not null"), max_broadcast_rows)
    needed = cut(lines.select("id", "line", "mark").join(bounded(cut(members.select("id").distinct()), max_broadcast_rows), "id"))
    texts = texts_of(docs, needed, min_chars, max_broadcast_rows)
    return links(members, texts, lambda t: char_shingles(t, shingle), similar, max_broadcast_rows, dense)


def shingles(t: str, k: int) -> set[str]:
    return {t[i : i + k] for i in range(max(len(t) - k, 0) + 1)}


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_broadcast_rows: int = 1_000_000, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h: xxhash64 of the text, dropped: sorted line numbers from 0), for the documents that lose any."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = cut(occurrences(slim, min_chars))
    lines = distinct_lines(found)
    linked = components(similar_lines(slim, lines, min_chars=min_chars, max_broadcast_rows=max_broadcast_rows))
    rooted = lines.select("id", "line", "mark", "n").join(bounded(linked, max_broadcast_rows), F.col("id") == F.col("node"), "left")
    judged = cut(rooted.filter("component is not null or n > 1").select("line", "mark", F.coalesce("component", "id").alias("root")))
    hits = cut(found.select("doc_id", "h", "line_no", "line", "mark").join(bounded(judged, max_broadcast_rows), ["line", "mark"]).select("doc_id", "h", "line_no", "root"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "line_no")
    keeper = cut(hits.groupBy("root").agg(F.min(place).alias("keeper")))
    gone = hits.join(bounded(keeper, max_broadcast_rows), "root").filter(place != F.col("keeper"))
    return gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs with the repeated lines taken out of the texts; all rows and columns stay."""
    gone = cut(dropped_lines(docs, doc_id, text, max_broadcast_rows, min_chars).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"), "dropped"))
    if (gone.agg(F.sum(F.size("dropped"))).first()[0] or 0) <= max_broadcast_rows:  # then the texts stay where they are
        gone = F.broadcast(gone)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    at = F.col(f"doc.`{text}`")
    joined = rows.join(gone, F.col(f"doc.`{doc_id}`").eqNullSafe(F.col("gone_id")) & (F.xxhash64(at) == F.col("gone_h")), "left")
    lines = F.split(at, "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "dropped"), lambda i: F.get(lines, i)), "\n")
    return joined.select(*[F.when(F.col("dropped").isNull(), at).otherwise(kept).alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    each = docs.select("doc_id", F.xxhash64("text").alias("h"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"))
    gone = dropped_lines(docs).withColumnRenamed("doc_id", "gone_id")
    joined = each.join(gone, each["doc_id"].eqNullSafe(gone["gone_id"]) & (each["h"] == gone["h"]), "left")
    return joined.select(each["doc_id"], "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped_lines"))
