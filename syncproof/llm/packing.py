"""Packing by power-of-two decomposition: every document's tokens are cut into pieces of binary lengths.

A document of n tokens (its ids and one end id) gives n // longest pieces of `longest` tokens, then one piece for each
binary digit of the rest, longest first. A piece is a sequence of its own: its length is a power of two, so nothing is
padded, and no sequence crosses documents. Sequences of equal lengths form a bucket, from which batches of one shape
are drawn; sequence ids run through the buckets, longest first, so a bucket is a range of ids.

Tokens are those of a tokenizer file of the `tokenizers` library. Texts are cut at white space, which its pre-tokenizer drops, and
words are looked up in a bounded table of words met before; what is not there is encoded by the library.

Defined cases: a null, empty or blank text is one piece, the end id; texts of any length are worked whole, in parts of bounded
size; repeated rows and ids each give their own pieces; rows of null id are kept, first in their buckets; extra columns, of
whatever names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncproof.llm.common import arrow_type, cut, slices, table
from syncproof.llm.ranks import numbered

LONGEST, END = 2048, 1
#: Lower-case letters that composition leaves alone, or punctuation: one pre-token each. Between the two a pre-token ends.
_LETTERS, _MARKS = "a-zß-öø-ÿ", ".,;:!?"
_STEM = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+")
_SEAM = re.compile(f"([{_LETTERS}])([{_MARKS}])")
_SPACE = re.compile(r"[ \t\n\r]")
#: str.split() parts words here, the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


class Encoder:
    """ids of texts as little-endian 32-bit bytes, equal to those of the library's tokenizer for the whole text.

    Words met are kept in two generations of at most `most_words` each: when the younger is full, it takes the place of the elder.
    """

    def __init__(self, path: str, most_words: int = 600_000, part: int = 1 << 20, longest_word: int = 40):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model, self.letters = self.tokenizer.model, {ord(c): bytes_of.pre_tokenize_str(c)[0][0] for c in map(chr, range(33, 256)) if _STEM.fullmatch(c)}
        self.most_words, self.part, self.longest_word = most_words, part, longest_word
        self.words: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """A stem by the tokenizer's own model, any other word by the whole tokenizer."""
        if len(word) > self.longest_word or not _STEM.fullmatch(word):
            return self.plain(word)
        got = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]
        return struct.pack(f"<{len(got)}I", *got)

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts that end before white space."""
        at = 0
        while at < len(text):
            m = _SPACE.search(text, at + self.part) if len(text) - at > self.part else None
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end

    def learned(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.most_words:
                self.words, self.elder = {}, self.words
            found = self.elder.get(word)
            found = self.words[word] = self.word(word) if found is None else found
        return found

    def encode(self, text: str | None) -> bytes:
        out = []
        for part in self.parts(text or ""):
            if _NOT_SPACE.search(part):
                out.append(self.plain(part))
                continue
            if "<|" not in part and _is_latin(part):  # special tokens are told by case
                part = part.lower()
            words = _SEAM.sub(r"\1 \2", part).split()
            got = list(map(self.words.get, words))
            for i in [i for i, g in enumerate(got) if g is None]:
                got[i] = self.learned(words[i])
            out += got
        return b"".join(out)


def _is_latin(text: str) -> bool:
    """Whether lower() does to text what the tokenizer does, letter by letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Binary lengths that add up to n, none over longest (a power of two)."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


#: Of this Python worker, by path: later tasks find the words of earlier ones.
_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, path: str, longest: int = LONGEST, end: int = END, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): the binary pieces of every document; ids as little-endian 32-bit bytes."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema[doc_id].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in out.fields])
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        rows, held = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(t) + last
                    at, n = 0, len(ids) // 4
                    for size in lengths(n, longest):
                        rows.append((i, at, size, n, ids[4 * at : 4 * (at + size)]))
                        at, held = at + size, held + 4 * size
                        if held >= batch_bytes or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, out)


def sequences(found: DataFrame) -> DataFrame:
    """Pieces with sequence_id, numbered through the buckets of equal length, longest first, and offset, always 0. Pieces are written first: ordering reads them twice."""
    return numbered(cut(found), [F.col("length").desc(), F.col("doc_id"), F.col("start"), F.col("doc_tokens")], "sequence_id").withColumn("offset", F.lit(0).cast("long"))


def pack(docs: DataFrame, path: str, longest: int = LONGEST, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids array<int>, sequence_id, offset): the packed corpus, sequences of binary lengths."""
    found = sequences(pieces(docs, path, longest, end, doc_id, text))
    at = lambda i, b: F.conv(F.hex(F.substring("ids", 4 * i + b, 1)), 16, 10).cast("int")
    value = lambda i: at(i, 1) + at(i, 2) * 256 + at(i, 3) * 65536 + at(i, 4) * 16777216
    return found.withColumn("ids", F.transform(F.sequence(F.lit(0), (F.col("length") - 1).cast("int")), value))


def buckets(packed: DataFrame) -> DataFrame:
    """(length, sequences, tokens, first_sequence, last_sequence): what batches of one shape can be drawn from."""
    return packed.groupBy("length").agg(F.count("*").alias("sequences"), F.sum("length").alias("tokens"), F.min("sequence_id").alias("first_sequence"), F.max("sequence_id").alias("last_sequence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digested = found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return sequences(digested).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
