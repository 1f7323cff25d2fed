import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from syncproof.llm import sentencepiece as S

TEXTS = ["", None, " ", "  a   b  ", "語🦀 x²y _a__b 12_3 a\n\nb\t", "▁▁x ▁", "don't l'été " + "x" * 3000, "a" * 47 + "é" * 100 + " हिन्दी ไทย", "The usual text, with words that (mostly) have pieces."]


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    """The public pieces as a unigram model for the library; far scores are made small, as its sums are 32-bit."""
    m = proto.ModelProto()
    with open(S.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40000.0)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("most", [1 << 22, 200])
def test_ids_are_the_best_path(spark, sf, documents, model, most):
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=model), S.Pieces.load(model)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40").collect()]
    got = S.decode(S.encode(documents(texts), pieces, ["doc_id", "key"], dictionary_units=most), pieces).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        assert r.ids == (None if t is None else library.encode(t))
        assert r.decoded == (None if t is None else t.replace("▁", " ")) and r.round_trip


def test_query_round_trips(spark, sf):
    rows = S.query(spark, sf).collect()
    assert len(rows) == 200 and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)


def test_edges(spark, edges):
    out = S.tokenize(edges, edges.columns)
    assert out.columns == [*edges.columns, "ids", "round_trip"] and out.count() == edges.count() and out.filter("not round_trip").count() == 0
    assert S.tokenize(edges.limit(0), ["doc_id"]).count() == 0


def test_units_are_never_crossed():
    import re

    p = S.Pieces.load()
    regex = p.unit_regex()
    assert all(re.fullmatch(regex, p.pieces[i]) for i in p.usable)
    p.pieces[p.usable[0]] = "a,b"
    assert re.findall(p.unit_regex(), "▁x,y▁z") == ["▁x,y", "▁z"]


def test_only_beaten_pieces_are_left_out():
    p = S.Pieces(["ab", "cd", "abcd", "abc", "d", "▁ab"], [-1.0, -2.0, -5.0, -3.0, -9.0, -4.0], [1] * 6, True)
    assert [p.pieces[i] for i in p.useful()] == ["ab", "cd", "abc", "d", "▁ab"]
    p.scores[2] = -3.0  # as good as its split: it stays, the fold decides
    assert len(p.useful()) == 6
    p.scores[2], p.kinds[2] = -5.0, 4
    assert len(p.useful()) == 6


def test_long_units_cost_their_length(documents):
    import random
    import time

    rng = random.Random(3)
    letters = "".join(rng.choices("etaoinshrdlu", k=200_000))
    began = time.time()
    out = {r.doc_id: r for r in S.tokenize(documents([letters, letters[:3000], letters[:200], "a" * 100_000]), ["doc_id"]).collect()}
    assert time.time() - began < 60 and all(r.round_trip for r in out.values())
    pieces = S.Pieces.load()
    score = {pieces.pieces[i]: pieces.scores[i] for i in pieces.usable}
    for k, n in ((1, 3000), (2, 200)):
        text, best = S.SPACE + letters[:n], [0.0]
        for e in range(1, n + 2):
            best.append(max(best[s] + score[text[s:e]] for s in range(max(0, e - 16), e) if text[s:e] in score))
        assert "".join(pieces.pieces[i] for i in out[k].ids) == text
        assert abs(sum(pieces.scores[i] for i in out[k].ids) - best[-1]) < 1e-4 * abs(best[-1])


def test_kept_columns_of_clashing_names(documents):
    from pyspark.sql import functions as F

    docs = documents(["some words", None]).select("doc_id", "text", F.lit("x").alias("ids"), F.lit("y").alias("round_trip"), F.lit("z").alias("decoded"), F.lit("k").alias("kept"))
    out = S.tokenize(docs, docs.columns)
    assert out.columns == ["doc_id", "text", "decoded", "kept", "ids", "round_trip"]
    assert {r.doc_id: r.decoded for r in S.decode(out, S.Pieces.load()).collect()} == {0: "some words", 1: None}


def test_lattice_has_a_row_for_each_character(spark):
    from pyspark.sql import functions as F

    p = S.Pieces.load()
    texts = ["▁international", "▁a", "語x🦀", "▁" * 20, "the" * 150]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "uid long, unit string, n long").select("uid", F.struct("unit", "n").alias("unit"))
    got = S.edges(rows, p).collect()
    assert sorted((r.uid, r.e) for r in got) == [(i, e) for i, t in enumerate(texts) for e in range(1, len(t) + 1)]
    assert sorted(r.unit.unit for r in got if r.unit) == sorted(texts)
    ids = {p.pieces[i]: i for i in p.useful()}
    longest = max(map(len, ids))
    for r in got:
        t = texts[r.uid]
        want = {(n, ids[t[r.e - n : r.e]], p.scores[ids[t[r.e - n : r.e]]]) for n in range(1, min(r.e, longest) + 1) if t[r.e - n : r.e] in ids}
        assert r.character == t[r.e - 1] and {tuple(x) for x in r.found} == want | ({(1, -1, p.unknown_score)} if r.character not in ids else set())


def test_hashes_and_search():
    import numpy as np
    import pyarrow as pa

    units = ["", "a", "a\0", "▁ab", "1234567", "12345678", "123456789", "123456781", "🦀" * 48, "🦀" * 47 + "x", *map(str, range(5000))]
    h = S.hashes(pa.array(units))
    assert len(set(h.tolist())) == len(units)
    assert (S.hashes(pa.array(["some", *reversed(units)]).slice(1)) == h[::-1]).all() and len(S.hashes(pa.array([], pa.string()))) == 0
    inside = np.sort(h[::2])
    known, starts, n = S.Dictionary(inside, np.arange(len(inside)) % 3 + 1, np.zeros(1, np.uint16)).find(h)
    assert known.tolist() == [i % 2 == 0 for i in range(len(units))]
    at = np.searchsorted(inside, h[::2])
    assert (n[::2] == at % 3 + 1).all() and (starts[::2] == np.concatenate(([0], np.cumsum(np.arange(len(inside)) % 3 + 1)))[at]).all() and (n[1::2] == 1).all()
