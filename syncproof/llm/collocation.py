"""Phrase collocations by dynamic itemset counting: phrases of all lengths are counted in one cycle of scans over shards.

The corpus is dealt to `shards` equal shards, which are scanned in turn, over and over. Words are counted from the first scan on. A
phrase becomes active with the scan after the one in which both its subphrases (all but its last, all but its first word) were
found `least` times, and is counted in each shard once, wherever in the cycle that begins. So longer phrases are counted
while shorter ones still are, and the scans end when no active phrase lacks a shard.

Subphrases occur wherever the phrase does, so every phrase of `least` occurrences is activated, and its count is whole.

Texts are cut into words once: each shard is kept as slices of documents, with the words that occur in a slice and each word's place
among them. A scan turns those into ids in numpy; a phrase is the pair of its subphrases' ids, exact in 64 bits. Counts of a task go to
buckets of such keys as arrays, and a bucket is summed by sorting. What a cycle has not ended for is kept for the next scan; of the
others those found `least` times stay.

The phrases found often enough are broadcast as arrays up to `most_known` of them, counted at each scan; a corpus with more is counted by
joins of n-grams with the table of subphrases, in the same cycle of scans and with equal results.

Defined cases: a null text is empty, a null language `und`; empty and blank texts have no words; repeated rows and ids count as often as they are
there; texts of any length are worked whole; other columns are not read. A language without candidates gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syncproof.llm.common import LOWER, UPPER, ascii_lower, cut, slices, table
from syncproof.llm.linking import bounded
from syncproof.llm.skew import join_hot
from syncproof.scratch import free, new_path

LEAST, LONGEST, SHARDS, TOP = 100, 5, 2, 2000
BREAKS = ".,;:!?\n\x0b\x0c\r"
#: On bytes: A-Z lowered, all that ends a piece to a full stop, tabs to spaces; split() then parts words at spaces alone.
_FOLD = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else ord(".") if chr(b) in BREAKS else 32 if b == 9 else b for b in range(256))
KEY = ["lang", "phrase"]
COUNTS = "lang string, phrase string, since int, f long"
SLICES = "shard int, lang string, words binary, ids binary"
BLOBS = "since int, bucket int, keys binary, f binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Words in order, with a full stop wherever a piece ends."""
    return text.translate(_FOLD).replace(b".", b" . ").split()


class Lookup:
    """Ids of 64-bit keys: keys in the order of their hashes, and where those of each hash begin."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        self.bits = max(1, len(keys).bit_length())
        h = self._hash(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.ids = keys[order], ids[order]
        self.start = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(h, minlength=1 << self.bits), out=self.start[1:])

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """0 for a key that is not there."""
        h = self._hash(keys)
        at, end, out = self.start[h], self.start[h + 1], np.zeros(len(keys), np.int64)
        live = np.flatnonzero(at < end)
        at, end, keys = at[live], end[live], keys[live]
        while len(live):
            hit = self.keys[at] == keys
            out[live[hit]] = self.ids[at[hit]]
            at += 1
            on = np.flatnonzero(~hit & (at < end))
            live, at, end, keys = live[on], at[on], end[on], keys[on]
        return out


@dataclass
class Known:
    """Phrases found often enough by id, from 1 on, as arrays: size, the scan in which they got there, head (the phrase but its last word, 0 for a word) and last word's number; keys by length."""

    words: dict[str, dict[bytes, int]] = field(default_factory=dict)
    texts: list[tuple[str, str]] = field(default_factory=list)
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int8))
    reached: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int16))
    heads: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    lasts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    lookups: dict[int, Lookup] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.sizes) - 1

    def _append(self, n: int, scan: int, heads: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        ids = np.arange(len(self.sizes), len(self.sizes) + len(heads))
        new = {"sizes": np.full(len(heads), n), "reached": np.full(len(heads), scan), "heads": heads, "lasts": lasts}
        for name, values in new.items():
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, values.astype(old.dtype)]))
        return ids

    def add_words(self, found: pa.Table, scan: int) -> int:
        """Takes in those words (lang, phrase) that are new; gives how many they were."""
        fresh = sorted((lang, w) for lang, w in zip(found["lang"].to_pylist(), found["phrase"].to_pylist(), strict=True) if w.encode() not in self.words.get(lang, ()))
        ids = self._append(1, scan, np.zeros(len(fresh), np.int32), np.arange(len(self.texts), len(self.texts) + len(fresh)))
        for (lang, w), i in zip(fresh, ids.tolist(), strict=True):
            self.words.setdefault(lang, {})[w.encode()] = i
        self.texts += fresh
        return len(fresh)

    def add(self, keys: np.ndarray, scan: int, longest: int) -> int:
        """Takes in those phrases of fewer than `longest` words that are new; gives how many they were."""
        sizes, before = self.sizes[keys >> 32] + 1, len(self)
        for n in np.unique(sizes[sizes < longest]).tolist():
            mine, old = np.unique(keys[sizes == n]), self.lookups.get(n)
            mine = mine if old is None else mine[old.get(mine) == 0]
            if len(mine):
                ids = self._append(n, scan, mine >> 32, self.lasts[mine & 0xFFFFFFFF]).astype(np.int32)
                self.lookups[n] = Lookup(mine, ids) if old is None else Lookup(np.concatenate([old.keys, mine]), np.concatenate([old.ids, ids]))
        return len(self) - before

    def for_scans(self) -> dict:
        return {"words": self.words, "reached": self.reached, "lookups": self.lookups}

    def for_spelling(self) -> dict:
        return {"texts": self.texts, "sizes": self.sizes, "heads": self.heads, "lasts": self.lasts}


def spelled(keys: np.ndarray, known: dict) -> tuple[list[str], list[int], list[str]]:
    """Language, number of words and text of phrases, by their subphrases' ids."""
    texts, first = known["texts"], keys >> 32
    sizes = known["sizes"][first] + 1
    langs, phrases = [""] * len(keys), [""] * len(keys)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        ids, columns = first[at], [known["lasts"][keys[at] & 0xFFFFFFFF]]
        for _ in range(n - 1):
            columns.append(known["lasts"][ids])
            ids = known["heads"][ids]
        for i, *places in zip(at.tolist(), *[c.tolist() for c in columns[::-1]], strict=True):
            langs[i] = texts[places[0]][0]
            phrases[i] = " ".join([texts[p][1] for p in places])
    return langs, sizes.tolist(), phrases


def deal(docs: DataFrame, shards: int, lang: str, text: str, nbytes: int = 4 << 20) -> DataFrame:
    """SLICES: documents of a shard and a language, as the words there and each one's place among them, from 1 on; 0 wherever a piece ends."""
    def row(shard: int, name: str, texts: list[bytes]) -> pa.RecordBatch:
        tokens = words(b".".join(texts))
        places = dict.fromkeys(tokens)
        places.pop(b".", None)
        places = {w: i for i, w in enumerate(places, 1)}
        ids = np.fromiter(map(places.get, tokens, itertools.repeat(0)), _width(len(places)), len(tokens))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name], pa.string()), pa.array([b" ".join(places)], pa.binary()), pa.array([ids.tobytes()], pa.binary())], names=["shard", "lang", "words", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[bytes]] = {}
        sizes: dict[tuple[int, str], int] = {}
        total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for shard, name, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    of = shard, name
                    held.setdefault(of, []).append(content)
                    sizes[of] = sizes.get(of, 0) + len(content) + 1
                    total += len(content) + 1
                    if sizes[of] > nbytes or total > 16 * nbytes:
                        of = of if sizes[of] > nbytes else max(sizes, key=sizes.get)
                        total -= sizes.pop(of)
                        yield row(*of, held.pop(of))
        for of, texts in held.items():
            yield row(*of, texts)

    rows = docs.select(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SLICES)


def _width(n_words: int) -> str:
    return "<u2" if n_words < 1 << 16 else "<u4"


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    lang, held, ids = (batch.column(batch.schema.names.index(c)) for c in ("lang", "words", "ids"))
    for i in range(batch.num_rows):
        own = held[i].as_py().split()
        yield lang[i].as_py(), own, np.frombuffer(ids[i].as_buffer(), _width(len(own)))


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of 64-bit values, from each cut to the next, as binaries over the values' own memory."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(values)])


def scan_words(shard: DataFrame, most_words: int = 300_000) -> DataFrame:
    """(lang, phrase, f) of a shard's words, in parts."""
    def rows(lang: str, found: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            for lang, own, ids in _slices(batch):
                mine = found.setdefault(lang, {})
                for w, n in zip(own, np.bincount(ids, minlength=len(own) + 1)[1:].tolist(), strict=True):
                    mine[w] = mine.get(w, 0) + n
                if len(mine) > most_words:
                    yield rows(lang, found.pop(lang))
        for lang, mine in found.items():
            yield rows(lang, mine)

    return shard.mapInArrow(run, "lang string, phrase string, f long")


def active(ids: np.ndarray, known: dict, scan: int, shards: int, longest: int) -> Iterator[np.ndarray]:
    """Keys of the occurrences of active phrases of 2 words and more in a run of word ids, 0 where a phrase cannot go on."""
    when = known["reached"]
    for n in range(2, longest + 1):
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        if not len(at):
            return
        first, rest = ids[at], ids[at + 1]
        keys = (first << 32) | rest
        yield keys[scan <= np.maximum(when[first], when[rest]) + shards]
        if n == longest or n not in known["lookups"]:
            return
        ids = np.zeros(len(ids) - 1, np.int64)
        ids[at] = known["lookups"][n].get(keys)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts, or the number of times that it is there (keys are then sorted in place)."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(at, append=len(keys)) if counts is None else np.add.reduceat(counts, at) if len(at) else counts


def scan_phrases(shard: DataFrame, shared, scan: int, shards: int, longest: int, buckets: int, most: int = 1 << 20) -> DataFrame:
    """BLOBS of a shard's active phrases, in parts: keys and counts by the scan that they are active from and by bucket."""
    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        when = shared.value["reached"]
        keys = np.concatenate(held)
        held.clear()
        keys, counts = summed(keys)
        since = np.maximum(when[keys >> 32], when[keys & 0xFFFFFFFF]).astype(np.int32) + 1
        bucket = ((keys.view(np.uint64) * _MIX >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
        for begun in np.unique(since).tolist():
            mine = np.flatnonzero(since == begun)
            mine = mine[np.argsort(bucket[mine], kind="stable")]
            of = bucket[mine]
            cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts) - 1, begun, np.int32)), pa.array(of[cuts[:-1]]), _blobs(keys[mine], cuts), _blobs(counts[mine], cuts)], names=["since", "bucket", "keys", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = shared.value, [], 0
        for batch in batches:
            for lang, own, places in _slices(batch):
                ids = known["words"].get(lang)
                if not ids:
                    continue
                of = np.fromiter(itertools.chain([0], map(ids.get, own, itertools.repeat(0))), np.int64, len(own) + 1)
                for keys in active(of[places], known, scan, shards, longest):
                    held.append(keys)
                    n += len(keys)
                if n > most:
                    yield from rows(held)
                    n = 0
        if n:
            yield from rows(held)

    return shard.mapInArrow(run, BLOBS)


def merged(blobs: DataFrame, scan: int, shards: int, least: int) -> DataFrame:
    """BLOBS summed, one row a bucket and beginning, and `often`: the keys found `least` times so far. Of phrases whose cycle ends with this scan only those stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for since, bucket, keys, f in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.setdefault((since, bucket), []).append((keys, f))
        for since, bucket in sorted(held):
            parts = held.pop((since, bucket))
            keys, f = summed(*[np.frombuffer(b"".join(x), np.int64) for x in zip(*parts, strict=True)])
            often = f >= least
            some = keys[often]
            if since + shards - 1 == scan:
                keys, f = some, f[often]
            yield pa.RecordBatch.from_arrays([pa.array([since], pa.int32()), pa.array([bucket], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (keys, f, some)]], names=["since", "bucket", "keys", "f", "often"])

    return blobs.mapInArrow(run, BLOBS + ", often binary")


def _grams(n: int):
    """All n-grams of the words w, as structs."""
    each = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("phrase")))
    return F.when(F.size("w") >= n, each).otherwise(F.array().cast("array<struct<n:int,phrase:string>>"))


def scan_joined(shard: DataFrame, ready: DataFrame | None, scan: int, shards: int, longest: int) -> DataFrame:
    """The same by joins: n-grams of the shard, counted, of which those stay whose subphrases are in `ready` (lang, phrase, reached) and that still lack the shard."""
    pieces = shard.select("lang", F.explode(F.split(ascii_lower(F.col("text")), r"[.,;:!?\x0A-\x0D]")).alias("piece")).select("lang", F.expr(r"regexp_extract_all(piece, '[^ \\t]+', 0)").alias("w")).filter("size(w) > 0")
    lengths = [1] * (scan < shards) + list(range(2, longest + 1)) * (ready is not None)
    if not lengths:
        return shard.sparkSession.createDataFrame([], COUNTS)
    counts = pieces.select("lang", F.explode(F.concat(*[_grams(n) for n in lengths])).alias("g")).groupBy("lang", "g.n", "g.phrase").agg(F.count("*").alias("f"))
    found = counts.filter("n = 1").select("lang", "phrase", F.lit(0).alias("since"), "f")
    if ready is not None:
        cut_off = lambda last: F.array_join(F.slice(F.split("phrase", " "), F.lit(1) if last else F.lit(2), F.col("n") - 1), " ")
        longer = counts.filter("n > 1").select("*", cut_off(True).alias("head"), cut_off(False).alias("tail"))
        for side in ("head", "tail"):
            longer = join_hot(longer, ready.select("lang", F.col("phrase").alias(side), F.col("reached").alias(f"{side}_reached")), ["lang", side]).filter(F.col(f"{side}_reached").isNotNull())
        since = F.greatest("head_reached", "tail_reached") + 1
        found = found.unionByName(longer.filter(since + shards > scan).select("lang", "phrase", since.alias("since"), "f"))
    return found


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, most_known: int = 8_000_000, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, n, phrase, f) of every phrase of 1 to longest words found `least` times, and (lang, n) with all word occurrences."""
    return _by_ids(docs, least, longest, shards, most_known, lang, text) or _by_joins(docs, least, longest, shards, lang, text)


def _by_ids(docs: DataFrame, least: int, longest: int, shards: int, most_known: int, lang: str, text: str) -> tuple[DataFrame, DataFrame] | None:
    """Scans until all counts are whole. None if more phrases than most_known would have to be broadcast."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession)
    deal(docs, shards, lang, text).write.partitionBy("shard").parquet(path)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known, last, before, whole = Known(), -1, None, []
    word_tables: list[DataFrame] = []
    for scan in itertools.count():
        shard = spark.read.schema(SLICES).parquet(path).filter(F.col("shard") == scan % shards).drop("shard")
        now, often = None, np.zeros(0, np.int64)
        if len(known):
            shared = spark.sparkContext.broadcast(known.for_scans())
            blobs = scan_phrases(shard, shared, scan, shards, longest, 4 * tasks)
            if before is not None:
                blobs = blobs.unionByName(before.drop("often").filter(F.col("since") + shards > scan))
            now = cut(merged(blobs.repartition(tasks, "bucket"), scan, shards, least), free_shuffles=True)
            shared.destroy()  # its counts are written: nothing will ask for it again
            whole.append(cut(now.filter(F.col("since") + shards - 1 == scan).select("keys", "f")))
            often = np.concatenate([often, *[np.frombuffer(r.often, np.int64) for r in now.select("often").collect()]])
        fresh = 0
        if scan < shards:
            word_tables.append(cut(scan_words(shard).groupBy(*KEY).agg(F.sum("f").alias("f"))))
            all_words = reduce(DataFrame.unionByName, word_tables)
            sums = cut(all_words.groupBy(*KEY).agg(F.sum("f").alias("f")).filter(F.col("f") >= least))
            if sums.count() + len(known) > most_known:
                return None
            fresh = known.add_words(sums.select(*KEY).toArrow(), scan)
        if len(known) + len(often) > most_known:
            return None
        fresh += known.add(often, scan, longest)
        if before is not None:
            free(before)  # what goes on is in the new table
        before = now
        last = scan if fresh else last
        if scan >= shards - 1 and scan >= last + shards:
            break
    totals = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = sums.select("lang", F.lit(1).alias("n"), "phrase", "f")
    if not whole:
        return phrases, totals
    shared = spark.sparkContext.broadcast(known.for_spelling())

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                langs, sizes, texts = spelled(np.frombuffer(keys, np.int64), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string()), pa.array(np.frombuffer(f, np.int64))], names=["lang", "n", "phrase", "f"])

    return phrases.unionByName(reduce(DataFrame.unionByName, whole).mapInArrow(spell, "lang string, n int, phrase string, f long")), totals


def _by_joins(docs: DataFrame, least: int, longest: int, shards: int, lang: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The same with nothing broadcast. Each scan's counts are written once; a phrase found `least` times in its cycle is found least / shards times in
    one of its scans, so only those that are in some scan's table that often are summed over the tables of a cycle."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard"))
    rows.write.partitionBy("shard").parquet(path)
    ready, last = None, -1
    tables: list[DataFrame] = []
    whole: list[DataFrame] = []
    totals: list[DataFrame] = []
    for scan in itertools.count():
        shard = spark.read.schema("lang string, text string, shard int").parquet(path).filter(F.col("shard") == scan % shards).drop("shard")
        tables.append(cut(scan_joined(shard, ready, scan, shards, longest).groupBy(*KEY).agg(F.max("since").alias("since"), F.sum("f").alias("f"))))
        if scan < shards:
            totals.append(cut(tables[-1].filter("since = 0").groupBy("lang").agg(F.sum("f").alias("n"))))
        cycle = reduce(DataFrame.unionByName, tables[-shards:]).filter(F.col("since") > scan - shards)
        heavy = bounded(cut(cycle.filter(F.col("f") * shards >= least).select(*KEY).distinct()), 2_000_000)
        sums = cut(cycle.join(heavy, KEY, "left_semi").groupBy(*KEY).agg(F.max("since").alias("since"), F.sum("f").alias("f")).filter(F.col("f") >= least))
        whole.append(sums.filter(F.col("since") + shards - 1 == scan))
        if len(tables) >= shards:
            free(tables[-shards])  # no later cycle begins before the next table
        short = sums.filter(F.size(F.split("phrase", " ")) < longest).select("lang", "phrase", F.lit(scan).alias("reached"))
        new = short if ready is None else short.join(ready, KEY, "left_anti")
        last = last if new.isEmpty() else scan
        ready = cut(new if ready is None else ready.unionByName(new))
        if scan >= shards - 1 and scan >= last + shards:
            break
    often = reduce(DataFrame.unionByName, whole)
    return often.select("lang", F.size(F.split("phrase", " ")).alias("n"), "phrase", "f"), reduce(DataFrame.unionByName, totals).groupBy("lang").agg(F.sum("n").alias("n"))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of every phrase of 2 words and more: its lowest-scoring cut, ties to the smallest first part."""
    parts = phrases.filter("n > 1").select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"), F.explode(F.expr("sequence(1, n - 1)")).alias("k"), F.split("phrase", " ").alias("w"))
    parts = parts.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        parts = join_hot(parts, phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    whole = "decimal(38,0)"
    score = F.expr(f"(cast(1000 as {whole}) * cast(a as {whole}) * cast(n as {whole})) div (cast(l as {whole}) * cast(r as {whole}))")
    cuts = parts.join(F.broadcast(totals), "lang").withColumn("score", score)
    least = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return least.select("lang", "phrase", "size", "a", "c.l", "c.r", "n", "c.score")


def maximal(found: DataFrame, percent: int = 100) -> DataFrame:
    """Candidates but those inside a longer one (kept or not) that has at least `percent` hundredths of their occurrences."""
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = found.filter("size > 2").select("lang", F.col("a").alias("longer"), "size", F.split("phrase", " ").alias("w")).select("lang", "longer", F.explode(inner).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def top(found: DataFrame, k: int = TOP, buckets: int = 64) -> DataFrame:
    """The first k of each language with their rank; each of `buckets` shares of a language is cut to k first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    few = found.withColumn("_bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_bucket").orderBy(*order))).filter(F.col("_at") <= k).drop("_bucket", "_at")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, k: int = TOP, shards: int = SHARDS, most_known: int = 8_000_000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's collocations."""
    phrases, totals = count_phrases(docs, least, longest, shards, most_known, lang, text)
    found = cut(scored(cut(phrases), totals))
    return top(maximal(found), k).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


SQL = r"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
g as (select lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) phrase from w, range(1, 6) z(s) where len(w) >= s),
f as (select lang, s, phrase, count(*) f from g group by all),
n as (select lang, cast(sum(f) as bigint) n from f where s = 1 group by lang),
c as (select lang, s, phrase, f a, string_split(phrase, ' ') w from f where s > 1 and f >= 100),
k as (select c.*, k, array_to_string(w[1:k], ' ') h, array_to_string(w[k + 1:], ' ') t from c, range(1, 5) y(k) where k < s),
x as (select k.lang, k.s, k.phrase, k.a, k.k, l.f l, r.f r, n.n, cast(1000::hugeint * k.a * n.n // (l.f::hugeint * r.f) as bigint) score from k join f l on l.lang = k.lang and l.phrase = k.h join f r on r.lang = k.lang and r.phrase = k.t join n on n.lang = k.lang),
b as (select * from x qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, a, unnest(flatten(list_transform(range(2, s), lambda m: list_transform(range(1, s - m + 2), lambda j: array_to_string(w[j:j + m - 1], ' '))))) phrase from c where s > 2),
o as (select lang, phrase, max(a) longer from i group by all),
v as (select b.* from b left join o using (lang, phrase) where longer is null or 100 * longer < 100 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank, phrase, a, l, r, n, score from v qualify rank <= 2000
"""
