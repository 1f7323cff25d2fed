import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from syncproof.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["Don't, we'll; I'd've  it's 's'S", "<|endoftext|> a<|startoftext|>b", "a\x1cb \x1f c\x85d e f　g", "É É ﬁ ǅ İstanbul ΑΣ ß ẞ", "é ́x 가각", "12 345.67,,,!? ...", "ｆｕｌｌ １２３ ½ ² Ⅷ _under_score", "x" * 5000 + " " + "é" * 500, "\x00\x01 ﻿​ z", "Ünïcödé, Çà! ÷ × ñ;;", "नमस्ते दुनिया 你好，世界", "᠎ a᠎b"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_looked_up_encode_as_whole_texts_do(tokenizer):
    for most, part in ((300_000, 1 << 20), (3, 7)):
        encoder = packing.Encoder(PATH, most_words=most, part=part)
        for text in [*HARD, " ".join(HARD), "\n".join(HARD) * 3, "", None, " \n\t"]:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain(tokenizer, text)[:-1]


def test_lengths_are_binary_and_add_up():
    for n in [1, 2, 3, 2047, 2048, 2049, 5000, 1_000_003]:
        found = packing.lengths(n)
        assert sum(found) == n and found == sorted(found, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in found)
        assert len([x for x in found if x < 2048]) == len({x for x in found if x < 2048})
    assert packing.lengths(5, 1) == [1] * 5


def test_pack_round_trip_on_edges(edges, tokenizer):
    rows = packing.pack(edges, PATH, longest=64).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(len(r.ids) == r.length and r.offset == 0 for r in rows)
    texts = [(r.doc_id, r.text) for r in edges.collect()]
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(r.ids)
    for i, t in texts:
        want, found = plain(tokenizer, t), by_doc[(i, len(plain(tokenizer, t)))]
        assert [x for at in sorted(found) for x in found[at][0]] == want
    assert sum(r.length for r in rows) == sum(len(plain(tokenizer, t)) for _, t in texts)
    ranked = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in ranked] == sorted((r.length for r in rows), reverse=True)
    for b in packing.buckets(packing.pack(edges, PATH, longest=64)).collect():
        assert b.last_sequence - b.first_sequence + 1 == b.sequences and b.tokens == b.sequences * b.length


def test_empty_and_refused(documents):
    none = documents([])
    assert packing.pack(none, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(none, PATH, longest=48)


def test_query_against_the_library(spark, tokenizer):
    found = packing.query(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = {r.doc_id: plain(tokenizer, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    want = {(i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)) for i, ids in docs.items() for at, n in zip(np.cumsum([0, *packing.lengths(len(ids))]).tolist(), packing.lengths(len(ids)), strict=False)}
    rows = found.collect()
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    assert found.filter(F.col("offset") != 0).count() == 0


def test_numbers_run_through_hot_groups_and_equal_rows(spark):
    from syncproof.llm.ranks import numbered, numbered_within

    rows = spark.createDataFrame([(1, 7)] * 300 + [(1, k) for k in range(100)] + [(2, 5), (3, 1), (3, 0)], "g long, v long")
    found = numbered(rows, [F.col("g"), F.col("v")], "n").collect()
    assert [r.n for r in sorted(found, key=lambda r: (r.g, r.v, r.n))] == list(range(len(found)))
    within = numbered_within(rows, "g", [F.col("v")], "n").collect()
    for g in (1, 2, 3):
        mine = sorted((r.v, r.n) for r in within if r.g == g)
        assert [n for _, n in mine] == list(range(len(mine)))
    assert numbered(rows.limit(0), [F.col("g")], "n").count() == 0
