"""SentencePiece encoding and decoding as a relational lattice, with a Viterbi fold in Spark's higher-order functions.

Texts are cut into units that no piece of the vocabulary spans. The distinct units of the corpus are exploded into the ends
of their substrings; an equi-join of the characters before an end with the tails of the pieces turns each into the lattice
edges that end there. The table leaves out pieces that lose to a split of themselves, as no best path holds them. Ends are
grouped by unit and a fold over them keeps the best path (largest sum of scores; of equal ones the edge that starts first).
A character without a piece gets an edge of the least score less ten and becomes its UTF-8 bytes (or the unknown piece).

Applying the units' pieces to documents needs no shuffle of texts: the most frequent units (at most `dictionary_units`, each
of at most 48 characters, so the size is bounded) are broadcast as sorted hashes with packed ids. Units beyond it are
joined: their occurrences by unit, then back to the documents that hold them.

Units have 64-bit hashes; ids are those of the model file, read as plain pieces with scores (path is a parameter).

Defined cases: null text gives null ids, empty text no ids; spaces become `▁` after one is put in front, as the model
asks; a `▁` in a text decodes to a space, as in the library; repeated rows are encoded alike; extra columns stay, but for kept
columns named `ids` or `round_trip`, which give way to the results; texts and units of any length cost their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.llm.common import cut, slices, table
from syncproof.llm.sets import runs, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONGEST_SHARED = 48
HEAD, BLOCK, LONG = 4, 256, 64
SIGN = np.uint64(1 << 63)
KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a word of eight


@dataclass
class Pieces:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    dummy_prefix: bool

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep texts as they are can be applied")
        return Pieces([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], model.normalizer_spec.add_dummy_prefix)

    @property
    def usable(self) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k in (1, 4)]

    def useful(self) -> list[int]:
        """The usable pieces but for those that some split into others beats by its sum: no best path can hold them."""
        score = {self.pieces[i]: float(self.scores[i]) for i in self.usable}
        return [i for i in self.usable if self.kinds[i] == 4 or best_split(self.pieces[i], score) <= self.scores[i] + 1e-4 * abs(self.scores[i])]

    @property
    def unknown_score(self) -> float:
        return float(np.float32(min(self.scores[i] for i in self.usable) - 10))

    @property
    def fallback(self) -> list[int]:
        """The ids of the 256 byte pieces, or of the unknown piece alone."""
        by_byte = {self.pieces[i]: i for i, k in enumerate(self.kinds) if k == 6}
        return [by_byte[f"<0x{b:02X}>"] for b in range(256)] if by_byte else [self.kinds.index(2)]

    def unit_regex(self) -> str:
        """The finest cut that no piece goes over: between letters and other characters, or else before spaces only."""
        characters = {c for i in self.usable for c in self.pieces[i]}
        numerals = "".join(sorted(c for c in characters if c.isalnum() and not c.isalpha() and not re.match(r"\d", c)))  # to the regex these are as letters
        cut_letters = rf"{SPACE}*[^\W\d_{SPACE}{numerals}]+|{SPACE}*(?:[\W\d_{numerals}](?<!{SPACE}))+|{SPACE}+"
        for regex in (cut_letters, rf"{SPACE}*[^{SPACE}]+|{SPACE}+"):
            if all(re.fullmatch(regex, self.pieces[i]) for i in self.usable):
                return regex
        return r"(?s).+"

    def as_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]


def best_split(piece: str, score: dict[str, float]) -> float:
    """The largest sum of scores over the splits of a piece into two or more others (minus infinity: none)."""
    best = [0.0] + [-np.inf] * len(piece)
    for e in range(1, len(piece) + 1):
        best[e] = max((best[s] + score.get(piece[s:e], -np.inf) for s in range(1 if e == len(piece) else 0, e)), default=-np.inf)
    return best[-1]


def normalised(text: str, dummy_prefix: bool) -> str:
    return (SPACE if dummy_prefix else "") + text.replace(" ", SPACE) if text else ""


def hashes(units: pa.Array) -> np.ndarray:
    """64-bit hashes of their bytes, which are mixed in by eights after the length; of units that no dictionary holds, of the first bytes alone."""
    binary = units.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(units) + 1] if len(units) else np.zeros(1, np.int64)
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    data = np.zeros(size // 8 * 8 + 24, np.uint8)
    if size:
        data[:size] = np.frombuffer(binary.buffers()[2], np.uint8, size, first)
    eights, at, left = data.view("<u8"), offsets[:-1] - first, np.minimum(np.diff(offsets), 4 * LONGEST_SHARED)
    out, rows = spread(left.astype(np.uint64)), slice(None)
    while len(at):
        bits = (at.astype(np.uint64) & np.uint64(7)) << np.uint64(3)
        word = eights[at >> 3] >> bits
        word |= eights[(at >> 3) + 1] << np.uint64(1) << (np.uint64(63) - bits)
        word &= KEPT[np.minimum(left, 8)]
        word ^= out[rows]
        out[rows] = spread(word)
        more = np.flatnonzero(left > 8)
        rows = more if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return out


# --- lattice and Viterbi over distinct units -----------------------------------------------------------------------


def coarse_words(texts: pa.Array, dummy_prefix: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words of each text, their numbers end to end, the words): words start with the spaces before them, as `▁`.

    Texts whose spaces all stand alone between words are split and numbered by Arrow, the others by a regular expression;
    a word that both hold is there twice.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = pc.match_substring(texts, "  ")
    for other in (pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.equal(texts, ""), pa.scalar(not dummy_prefix)):
        odd = pc.or_(odd, other)
    lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    coded = lists.flatten().dictionary_encode()
    words, numbers = pc.binary_join_element_wise(SPACE, coded.dictionary, ""), coded.indices.to_numpy()
    found = [re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", normalised(x, dummy_prefix)) for x in texts.filter(odd).to_pylist()]
    if not found:
        return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), numbers, words
    other = pa.array([w for x in found for w in x], pa.string()).dictionary_encode()
    is_odd, counts = odd.to_numpy(zero_copy_only=False), np.zeros(len(texts), np.int64)
    counts[~is_odd], counts[is_odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False), [len(x) for x in found]
    starts = np.zeros(len(texts), np.int64)
    for side, first in ((~is_odd, 0), (is_odd, len(numbers))):
        starts[side] = first + np.cumsum(counts[side]) - counts[side]
    both = np.concatenate([numbers, other.indices.to_numpy() + np.int64(len(words))])
    return counts, both[runs(starts, counts)], pa.concat_arrays([words, other.dictionary])


def cutter(regex: str):
    """f(words) -> (units of each word, the units end to end). The common words, letters with at most one mark behind, are cut by Arrow."""
    find = re.compile(regex).findall
    fine = re.fullmatch(regex, f"{SPACE}a,") is None

    def cut_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        if not fine:
            lists = pa.array([find(w) for w in words.to_pylist()], pa.list_(pa.string()))
            return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        spaced = pc.starts_with(words, SPACE)
        last = pc.utf8_slice_codeunits(words, -1)
        head = pc.utf8_slice_codeunits(words, 0, -1)
        as_mask = lambda x: x.to_numpy(zero_copy_only=False)
        one = as_mask(pc.and_(spaced, pc.utf8_is_alpha(pc.utf8_slice_codeunits(words, 1))))
        marked = pc.and_(pc.invert(pc.utf8_is_alnum(last)), pc.not_equal(last, SPACE))
        two = ~one & as_mask(pc.and_(pc.and_(spaced, marked), pc.utf8_is_alpha(pc.utf8_slice_codeunits(head, 1))))
        lists = [find(w) for w in words.filter(pa.array(~(one | two))).to_pylist()]
        counts = np.where(one, 1, 2).astype(np.int64)
        counts[~(one | two)] = [len(x) for x in lists]
        parts = [words.filter(pa.array(one)), head.filter(pa.array(two)), last.filter(pa.array(two)), pa.array([u for x in lists for u in x], pa.string())]
        ends = np.cumsum(counts)
        place = [(ends - counts)[one], (ends - counts)[two], (ends - 1)[two], runs((ends - counts)[~(one | two)], counts[~(one | two)])]
        order = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        order[np.concatenate(place)] = np.arange(len(order))
        return counts, pa.concat_arrays(parts).take(pa.array(order))

    return cut_words


def distinct_units(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """(unit, n): how often each unit occurs in all texts. Words are counted first, and only distinct ones are cut into units."""
    regex, dummy = pieces.unit_regex(), pieces.dummy_prefix

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", rows=4096, nbytes=4 << 20):
                _, numbers, words = coarse_words(part.column(0), dummy)
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(numbers, minlength=len(words)), pa.int64())], names=["word", "n"])
            pa.default_memory_pool().release_unused()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_words = cutter(regex)
        for batch in batches:
            counts, units = cut_words(batch.column(0))
            yield pa.RecordBatch.from_arrays([units, pa.array(np.repeat(batch.column(1).to_numpy(), counts), pa.int64())], names=["unit", "n"])

    words = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "word string, n long").filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(split, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def tails(pieces: Pieces) -> list[tuple[str, list, list | None]]:
    """(tail, found, longer): for each end of at most HEAD characters that a useful piece has, the (n, id, score) of all useful pieces that it ends with,
    and (piece, n, id, score) of longer ones that end with it. A last character that is no piece is found as id -1, at the least score less ten."""
    ids: dict[str, list[int]] = {}
    longer: dict[str, list] = {}
    for i in pieces.useful():
        piece = pieces.pieces[i]
        ids.setdefault(piece, []).append(i)
        more = longer.setdefault(piece[-HEAD:], [])
        if len(piece) > HEAD:
            more.append((piece, len(piece), i, float(pieces.scores[i])))
    found = lambda t: [(n, i, float(pieces.scores[i])) for n in range(1, len(t) + 1) for i in ids.get(t[-n:], [])]
    unknown = lambda t: [] if t[-1] in ids else [(1, -1, pieces.unknown_score)]
    return [(t, found(t) + unknown(t), more or None) for t, more in longer.items()]


def edges(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(uid, unit: struct) -> (uid, unit: in one row of each uid, e, character, found): a row for each end e of substrings, with the last character and
    (n, id, score) of each useful piece of n characters that ends there, and of the lone character if it is none (id -1).

    The last characters, HEAD of them or the most that the tail of any piece matches, meet the tails of the pieces; of longer pieces the rest is
    compared after the join. Units are cut into blocks first, and a row holds no more than the longest piece could cover, so that long units cost
    their length, not its square.
    """
    spark = units.sparkSession
    edge = "array<struct<n:int,id:int,score:float>>"
    vocabulary = spark.createDataFrame(tails(pieces), f"tail string, own {edge}, longer array<struct<piece:string,n:int,id:int,score:float>>")
    longest = max([HEAD, *(len(pieces.pieces[i]) for i in pieces.useful())])
    blocks = units.select("uid", "unit", F.explode(F.sequence(F.lit(0), F.length("unit.unit") - 1, F.lit(BLOCK))).alias("base"))
    begun = blocks.withColumn("off", F.greatest(F.col("base") - longest, F.lit(0)))
    texts = begun.select("uid", F.when(F.col("base") == 0, F.col("unit")).alias("unit"), "base", "off", F.substr(F.col("unit.unit"), F.col("off") + 1, F.col("base") - F.col("off") + BLOCK).alias("block"))
    ends = texts.select("uid", "unit", "off", "block", F.explode(F.sequence(F.col("base") + 1, F.col("off") + F.length("block"))).alias("e"))
    at = F.col("e") - F.col("off")
    last = lambda n: F.substr(F.col("block"), F.greatest(at - n + 1, F.lit(1)), F.least(at, F.lit(n)))
    met = ends.select("uid", F.when(F.col("e") == 1, F.col("unit")).alias("unit"), "e", last(longest).alias("before"), last(HEAD).alias("end"), F.lit(None).cast(edge).alias("found"))
    for n in range(HEAD, 0, -1):  # the vocabulary is fixed in size; what has met a tail looks for no shorter one
        key = F.when(F.col("found").isNull(), F.right(F.col("end"), F.lit(n)))
        met = met.join(F.broadcast(vocabulary if n == HEAD else vocabulary.drop("longer")), key == F.col("tail"), "left")
        met = met.select("uid", "unit", "e", "before", "end", F.coalesce("found", "own").alias("found"), "longer")
    whole = F.transform(F.filter("longer", lambda x: F.col("before").endswith(x["piece"])), lambda x: F.struct(x["n"].alias("n"), x["id"].alias("id"), x["score"].alias("score")))
    unknown = F.array(F.struct(F.lit(1).alias("n"), F.lit(-1).alias("id"), F.lit(pieces.unknown_score).cast("float").alias("score")))
    found = F.when(F.col("found").isNull(), unknown).when(F.col("longer").isNull(), F.col("found")).otherwise(F.concat("found", whole))
    return met.select("uid", "unit", "e", F.right(F.col("end"), F.lit(1)).alias("character"), found.alias("found"))


def viterbi(lattice: Column) -> Column:
    """array of (e, found), a row for each end, sorted -> array of (id, s) of the best path, from its end; of equal ones the first start wins.

    A fold over ends keeps the best score up to each and the edge that reaches it so; a second, from the last end backwards, walks along these edges.
    """
    start = F.array(F.struct(F.lit(0.0).cast("float").alias("score"), F.lit(0).alias("n"), F.lit(0).alias("id")))

    def step(best: Column, x: Column) -> Column:
        ways = F.transform(x["found"], lambda y: F.struct((F.get(best, x["e"] - y["n"])["score"] + y["score"]).alias("score"), y["n"].alias("n"), y["id"].alias("id")))
        return F.array_append(best, F.array_max(ways))  # of equal scores the longest edge starts first

    def walk(acc: Column, x: Column) -> Column:
        s = acc["at"] - x["n"]
        taken = F.struct(s.alias("at"), (x["n"] - 1).alias("over"), F.array_append(acc["path"], F.struct(x["id"].alias("id"), s.alias("s"))).alias("path"))
        return F.when(acc["over"] > 0, F.struct(acc["at"].alias("at"), (acc["over"] - 1).alias("over"), acc["path"].alias("path"))).when(x["n"] > 0, taken).otherwise(acc)

    def back(best: Column) -> Column:
        end = F.struct((F.size(best) - 1).alias("at"), F.lit(0).alias("over"), F.array().cast("array<struct<id:int,s:int>>").alias("path"))
        return F.aggregate(F.reverse(best), end, walk, lambda acc: acc["path"])

    return F.aggregate(lattice, start, step, back)


def best_path(e: np.ndarray, s: np.ndarray, score: np.ndarray) -> list[int]:
    """viterbi() of one long unit: the places of the best path's edges, from its start; edges come sorted by e, then s."""
    length = int(e[-1])
    best, by = np.full(length + 1, -np.inf, np.float32), [0] * (length + 1)
    best[0] = 0
    for k, (i, j, x) in enumerate(zip(s.tolist(), e.tolist(), score, strict=True)):
        if (way := best[i] + x) > best[j]:
            best[j], by[j] = way, k
    out, at = [], length
    while at:
        out.append(by[at])
        at = int(s[by[at]])
    return out[::-1]


def encoded_units(units: DataFrame, pieces: Pieces, units_a_task: int = 10_000) -> DataFrame:
    """(unit, n, ids) of distinct units (unit, n). Units over LONG characters are folded one by one in Arrow, so that they cost their length."""
    spark = units.sparkSession
    numbered = cut(units.select(F.struct("unit", "n").alias("unit"), F.monotonically_increasing_id().alias("uid"), (F.length("unit") > LONG).alias("long")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-numbered.count() // units_a_task))
    dealt = edges(numbered.filter("not long").repartition(tasks, "uid"), pieces)  # the groups below stay in these partitions: edges are not shuffled
    lattice = dealt.groupBy("uid").agg(F.max("unit").alias("unit"), F.sort_array(F.collect_list(F.struct("e", "found"))).alias("lattice"))
    codes = F.array(*[F.lit(i) for i in pieces.fallback])
    character = lambda s: F.encode(F.substr(F.col("unit.unit"), s + 1, F.lit(1)), "UTF-8")
    as_bytes = lambda s: F.transform(F.sequence(F.lit(1), F.octet_length(character(s))), lambda k: F.get(codes, F.conv(F.hex(F.substring(character(s), k, F.lit(1))), 16, 10).cast("int")))
    unknown = as_bytes if len(pieces.fallback) == 256 else lambda s: F.array(F.lit(pieces.fallback[0]))
    known = F.forall("path", lambda p: p["id"] >= 0)
    ids = F.when(known, F.reverse(F.transform("path", lambda p: p["id"]))).otherwise(F.flatten(F.transform(F.reverse("path"), lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(unknown(p["s"])))))
    folded = lattice.select("unit", viterbi(F.col("lattice")).alias("path")).select("unit", ids.alias("ids")).select("unit.unit", "unit.n", "ids")
    done = cut(folded)
    long = numbered.filter("long")
    if not long.isEmpty():
        fallback = pieces.fallback

        def fold(group: pa.Table) -> pa.Table:
            group = group.sort_by([("e", "ascending"), ("s", "ascending")])
            path = best_path(*(group.column(c).to_numpy() for c in ("e", "s", "score")))
            taken = group.take(pa.array(path))
            out = []
            for i, sub in zip(taken.column("id").to_pylist(), taken.column("sub").to_pylist(), strict=True):
                out += [i] if i >= 0 else [fallback[b] for b in sub.encode()] if len(fallback) == 256 else fallback
            return pa.table({"uid": group.column("uid").slice(0, 1), "ids": pa.array([out], pa.list_(pa.int32()))})

        each = edges(long.repartition("uid"), pieces).select("uid", "e", "character", F.explode("found").alias("edge"))
        found = each.select("uid", "e", (F.col("e") - F.col("edge.n")).alias("s"), "edge.id", "edge.score", F.when(F.col("edge.id") < 0, F.col("character")).alias("sub")).groupBy("uid").applyInArrow(fold, "uid long, ids array<int>")
        done = done.unionByName(cut(found.join(long, "uid").select("unit.unit", "unit.n", "ids")))
    return done


# --- documents -----------------------------------------------------------------------------------------------------


class Dictionary:
    """Ascending hashes of frequent units, and their ids end to end in that order: 12 bytes a unit and 2 or 4 an id."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        self.keys, self.ids = keys, ids
        self.bounds = np.zeros(len(counts) + 1, np.uint32)
        np.cumsum(counts, out=self.bounds[1:])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, start, count) of hashes; of unknown ones (start 0, count 1)."""
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.ones(len(h), np.int64)
        order, at = np.argsort(h), np.empty(len(h), np.int64)
        at[order] = np.searchsorted(self.keys, h[order])  # in ascending order a search finds the keys near in memory
        np.minimum(at, len(self.keys) - 1, out=at)
        known, starts = self.keys[at] == h, self.bounds[at].astype(np.int64)
        return known, np.where(known, starts, 0), np.where(known, self.bounds[at + 1] - starts, 1)


def frequent(encoded: DataFrame, most: int, vocabulary: int) -> tuple[Dictionary, Column, bool]:
    """The dictionary, what tells its units in (unit, n), and whether it holds all units. Counts come down as a histogram of at most 512 bars."""
    bar = F.floor(F.log2(F.col("n").cast("double")) * 8)
    short = F.length("unit") <= LONGEST_SHARED
    bars = encoded.filter(short).groupBy(bar.alias("bar")).agg(F.count("*").alias("units")).orderBy(F.desc("bar")).collect()
    total, least = 0, None
    for r in bars:
        if total + r.units > most:
            break
        total, least = total + r.units, r.bar
    inside = short & (bar >= (least if least is not None else 1 << 30))

    width = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = (hashes(batch.column(0)) ^ SIGN).view(np.int64)  # ascending as the hashes are
            yield pa.RecordBatch.from_arrays([pa.array(signed), batch.column(1)], names=["h", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = np.diff(lists.offsets.to_numpy()).astype(np.uint16)
            keys = batch.column(0).to_numpy().view(np.uint64) ^ SIGN
            yield pa.RecordBatch.from_pylist([{"k": keys.tobytes(), "c": counts.tobytes(), "i": lists.flatten().to_numpy().astype(width).tobytes()}])

    # Spark sorts, so that the driver lays the parts end to end and holds no more than the dictionary itself
    parts = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = encoded.filter(inside).select("unit", "ids").mapInArrow(hashed, "h long, ids array<int>")
    by_hash = keyed.repartitionByRange(parts, "h").sortWithinPartitions("h")
    blobs: dict[str, bytearray] = {"k": bytearray(), "c": bytearray(), "i": bytearray()}
    for r in by_hash.mapInArrow(pack, "k binary, c binary, i binary").toLocalIterator():
        for n in blobs:
            blobs[n] += r[n]
    dictionary = Dictionary(np.frombuffer(blobs["k"], np.uint64), np.frombuffer(blobs["c"], np.uint16), np.frombuffer(blobs["i"], width))
    return dictionary, inside, encoded.filter(~inside).isEmpty()


class Encoder:
    """Texts to ids by the dictionary; it keeps nothing from one call to the next."""

    def __init__(self, dictionary: Dictionary, regex: str, dummy_prefix: bool):
        self.d, self.cut_words, self.dummy = dictionary, cutter(regex), dummy_prefix

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(ids of each word, the ids end to end, units): an id of -1 - k stands for units[k], which the dictionary has not."""
        cuts, units = self.cut_words(words)
        short = pc.less_equal(pc.utf8_length(units), LONGEST_SHARED).to_numpy(zero_copy_only=False)
        known, starts, n = self.d.find(hashes(units))
        known, starts, n = known & short, np.where(short, starts, 0), np.where(short, n, 1)
        ids = (self.d.ids if len(self.d.ids) else np.zeros(1, np.uint16))[runs(starts, n)].astype(np.int32)
        ends = np.cumsum(n)
        ids[ends[~known] - 1] = -1 - np.flatnonzero(~known)
        return (np.add.reduceat(n, np.cumsum(cuts) - cuts) if len(cuts) else n), ids, units

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, list[list[str]] | None]:
        """(ids, for each text the units that ids -1, -2, ... stand for; None if there are none at all)."""
        counts, numbers, words = coarse_words(texts, self.dummy)
        word_sizes, word_ids, units = self.of_words(words)
        n = word_sizes[numbers]
        ids = word_ids[runs((np.cumsum(word_sizes) - word_sizes)[numbers], n)]
        offsets = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))]
        missing = None
        if (ids < 0).any():
            missing = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own: dict[str, int] = {}
                for k in a + np.flatnonzero(ids[a:b] < 0):
                    ids[k] = -1 - own.setdefault(units[-1 - int(ids[k])].as_py(), len(own))
                missing.append(list(own))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pc.is_null(texts)), missing


class Decoder:
    """Lists of ids to texts."""

    def __init__(self, pieces: Pieces):
        self.parts, self.dummy = pa.array(pieces.as_bytes(), pa.binary()), pieces.dummy_prefix

    def decode(self, ids: pa.ListArray) -> pa.Array:
        whole = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.take(self.parts, ids.values), mask=pc.is_null(ids)), b"")
        try:
            text = whole.cast(pa.string())
        except pa.ArrowInvalid:  # ids that are no whole characters
            text = pa.array([None if t is None else t.decode(errors="replace") for t in whole.to_pylist()], pa.string())
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text) if self.dummy else text


def encode(docs: DataFrame, pieces: Pieces, keep: list[str], text: str = "text", dictionary_units: int = 1 << 22) -> DataFrame:
    """The columns `keep` of docs with ids array<int> and round_trip: whether the ids decode to the text (spaces for any `▁` in it)."""
    spark = docs.sparkSession
    encoded = encoded_units(distinct_units(docs, pieces, text), pieces)
    dictionary, inside, complete = frequent(encoded, dictionary_units, len(pieces.pieces))
    shared = spark.sparkContext.broadcast((dictionary, pieces))
    regex = pieces.unit_regex()
    plain = F.translate(F.col(f"`{text}`"), SPACE, " ")  # what the ids stand for
    match = [] if complete else [F.xxhash64(plain).alias("h"), F.octet_length(plain).cast("long").alias("size")]  # to check texts that join their units
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), *match, F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value[0], regex, shared.value[1].dummy_prefix), Decoder(shared.value[1])
        for batch in batches:
            for part in slices(batch, "text", rows=4096, nbytes=2 << 20):
                texts = part.columns[-1]
                ids, missing = encoder.encode(texts)
                if missing is None:
                    same = pc.or_kleene(pc.is_null(texts), pc.equal(decoder.decode(ids), pc.replace_substring(texts, SPACE, " ")))
                else:
                    same = pa.nulls(len(texts), pa.bool_())  # not whole yet
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, pa.array(missing or [[]] * len(texts), pa.list_(pa.string())), same], names=schema.names)
            pa.default_memory_pool().release_unused()

    out = rows.mapInArrow(run, schema)
    columns = [F.col(f"kept.`{c}`").alias(c) for c in keep if c not in ("ids", "round_trip")]
    if complete:
        return out.select(*columns, "ids", "round_trip")
    wanted = out.filter("size(missing) > 0").select("h", "size", F.posexplode("missing").alias("k", "unit")).distinct()
    filled = wanted.join(encoded.filter(~inside).select("unit", F.col("ids").alias("own")), "unit").groupBy("h", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "own"))), lambda x: x["own"]).alias("filled"))
    whole = F.flatten(F.transform("ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(F.get("filled", -1 - i))))
    joined = out.join(filled, ["h", "size"], "left").withColumn("ids", F.when(F.size("missing") > 0, whole).otherwise(F.col("ids")))
    ready = joined.select("kept", "ids", "h", "size", "round_trip")
    again = _decoded(ready.filter("round_trip is null"), pieces, "ids")
    own = lambda c: F.col(f"row.{c}")
    later = again.select(own("kept"), own("ids"), own("h"), own("size"), (own("ids").isNull() | ((F.octet_length("decoded") == own("size")) & (F.xxhash64("decoded") == own("h")))).alias("round_trip"))
    both = ready.filter("round_trip is not null").unionByName(later)
    return both.select(*columns, "ids", "round_trip")


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with a column of the texts that the ids stand for (null where ids is null). A column of that name is replaced."""
    return _decoded(rows, pieces, ids).select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns if c != out], F.col("decoded").alias(out))


def _decoded(rows: DataFrame, pieces: Pieces, ids: str) -> DataFrame:
    """(row struct, decoded)."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)
    schema = T.StructType([T.StructField("row", rows.schema), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                row = batch.slice(i, 512).column(0)
                lists = pa.concat_arrays([row.field(ids)])
                yield pa.RecordBatch.from_arrays([row, decoder.decode(lists)], names=["row", "decoded"])

    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")).mapInArrow(run, schema)


def tokenize(docs: DataFrame, keep: list[str], model: str = MODEL, text: str = "text") -> DataFrame:
    return encode(docs, Pieces.load(model), keep, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "round_trip")
