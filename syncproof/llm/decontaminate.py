"""Benchmark decontamination: a broadcast hash set of normalised benchmark word windows scans the corpus.

A word is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is `size` consecutive
words of an item; an item of fewer words, but not none, is one window. Every hash hit is verified word by word.

The set is only ever broadcast in blocks of at most `block_words` benchmark words (its size is counted first); a
larger benchmark is scanned block by block over the whole corpus, each block's hits being merged into those before.

Defined cases: a null or wordless text has no words and no hits; items that are null, wordless or without id give no
windows; repeated items count once, repeated documents each get their own row; extra columns stay as they are, whatever their
names. Texts of any length are scanned whole.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.llm.common import LOWER, UPPER, ascii_lower, cut, map_documents

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on bytes: ASCII letters are lowered and all other ASCII but digits become spaces, which split() takes away.
_FOLD = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 128 or chr(b).isdigit() or chr(b) in LOWER else 32 for b in range(256))

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
HIT_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))]


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def item_words(benchmark: DataFrame, size: int, part_words: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id string, words): items cut into overlapping parts of at most part_words + size - 1 words, so that no window is lost."""
    all_words = F.expr(f"regexp_extract_all(lowered, r'{WORD}', 0)")
    parts = benchmark.select(F.col(item_id).cast("string").alias("item_id"), ascii_lower(F.col(text)).alias("lowered")).filter("item_id is not null and lowered is not null").select("item_id", all_words.alias("w")).filter("size(w) > 0").distinct()
    return parts.select("item_id", F.expr(f"size(w) < {size}").alias("short"), F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {size} + 1, 1), {part_words}), i -> slice(w, i, {part_words} + {size} - 1))")).alias("words"))


class WindowSet:
    """Windows of one block of items, by length: sorted 64-bit hashes of vocabulary ids, and exact windows to item ids."""

    def __init__(self, parts: list[tuple[str, list[str]]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.exact: dict[int, dict[bytes, list[str]]] = {}
        for item, text_words in parts:
            ids = np.array([self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in text_words], np.uint32)
            n = min(size, len(ids))
            of_length = self.exact.setdefault(n, {})
            for i in range(len(ids) - n + 1):
                items = of_length.setdefault(ids[i : i + n].tobytes(), [])
                if item not in items:
                    items.append(item)
        self.hashes = {n: np.unique(window_hashes(np.frombuffer(b"".join(ws), np.uint32).reshape(-1, n))) for n, ws in self.exact.items()}


def window_hashes(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for j in range(windows.shape[1]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + windows[:, j]
    return h


def _scanner(known: WindowSet):
    get = known.vocabulary.get

    def scan(texts: list[bytes | None]) -> list[list]:
        lists = [words(t) for t in texts]
        counts = [len(w) for w in lists]
        starts = np.concatenate(([0], np.cumsum([n + 1 for n in counts])))  # one 0 between documents: no window spans two
        ids = np.zeros(int(starts[-1]) + 1, np.uint32)
        for at, w in zip(starts, lists, strict=False):
            ids[at : at + len(w)] = np.fromiter(map(get, w, itertools.repeat(0)), np.uint32, len(w))
        gaps = np.concatenate(([0], np.cumsum(ids == 0)))
        found: dict[int, list[tuple[int, int, list[str]]]] = {}
        for n, hashes in known.hashes.items():
            if len(ids) < n:
                continue
            full = np.flatnonzero(gaps[n:] == gaps[:-n])
            if not len(full):
                continue
            windows = ids[full[:, None] + np.arange(n)]
            h = window_hashes(windows)
            near = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
            for k in np.flatnonzero(near):
                if items := known.exact[n].get(windows[k].tobytes()):
                    at = int(full[k])
                    d = int(np.searchsorted(starts, at, side="right")) - 1
                    found.setdefault(d, []).append((at - int(starts[d]), at - int(starts[d]) + n, items))
        spans, items = [], []
        for d in range(len(texts)):
            hits = found.get(d, [])
            spans.append(merge([(a, b) for a, b, _ in hits]))
            items.append(sorted({i for *_, some in hits for i in some}))
        return [counts, [[{"start": a, "end": b} for a, b in s] for s in spans], items]

    return scan


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_words: int = 1_000_000, text: str = "text") -> DataFrame:
    """(doc struct, n_words, spans of hit words [start, end), items: sorted ids of items with occurring windows)."""
    spark = docs.sparkSession
    parts = cut(item_words(benchmark, size, max(1, block_words // 8)))
    total = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total * 5 // (4 * block_words)))
    out, before = None, "_hits_of_blocks_before"
    while before in {c.lower() for c in docs.columns}:
        before += "_"
    for b in range(blocks):
        block = parts.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b) if blocks > 1 else parts
        known = spark.sparkContext.broadcast(WindowSet([(r.item_id, r.words) for r in block.select("item_id", "words").toLocalIterator()], size))
        one = map_documents(docs if out is None else out.select("doc.*", F.struct("n_words", "spans", "items").alias(before)), lambda known=known: _scanner(known.value), HIT_FIELDS, text)
        if out is not None:
            both = F.concat(F.col(f"doc.{before}.spans"), F.col("spans"))
            one = one.select(F.struct(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns]).alias("doc"), "n_words", merged(both).alias("spans"), F.array_sort(F.array_union(f"doc.{before}.items", "items")).alias("items"))
        out = cut(one) if blocks > 1 else one
    return out


def merged(spans):
    """The union of spans, as Columns."""
    def step(acc, x):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["end"])
        longer = F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], x["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), step)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """docs without those in which any benchmark window occurs."""
    return find_contamination(docs, benchmark, size, text=text).filter("size(spans) = 0").select("doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """docs with the hit words cut out of the texts; what stood between words around a cut is kept."""
    found = find_contamination(docs, benchmark, size, text=text)
    gaps = F.split(F.col(f"doc.{text}"), WORD_ANY_CASE, -1)
    all_words = F.expr(f"regexp_extract_all(doc.`{text}`, r'{WORD_ANY_CASE}', 0)")
    hit = lambda i: F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"]))
    kept = F.array_join(F.transform(gaps, lambda g, i: F.concat(F.when((i > 0) & ~hit(i - 1), F.get(all_words, i - 1)).otherwise(""), g)), "")
    text_out = F.when(F.size("spans") == 0, F.col(f"doc.{text}")).otherwise(kept)
    return found.select(*[text_out.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syncproof.llm.common import table

    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return found.select("doc.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = r"""
with d as (select doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select distinct cast(item_id as varchar) item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null and item_id is not null),
bw as (select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') k from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw) where len(w) >= n)),
hits as (select doc_id, i, n, item_id from dw join bw using (n, k)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) s from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""
