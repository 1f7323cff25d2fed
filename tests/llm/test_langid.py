import numpy as np
import pytest
from pyspark.sql import functions as F

from syncproof.llm import langid as G


def test_gradients_against_differences():
    net = G.Network.fresh(["a", "b", "c"], 3, 1)
    for p in net.parts():
        p[...] = p  # float32, so steps must not be too small
    net.inputs, net.recurrent = [x.astype(np.float64) for x in net.inputs], [x.astype(np.float64) for x in net.recurrent]
    rng = np.random.default_rng(0)
    codes, label = rng.integers(0, 256, (7, 4)), np.array([0, 1, 2, 1])
    grads, _ = net.gradients(codes, label)
    for p, g in zip(net.parts(), grads, strict=True):
        spots = [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g), axis=None)[:3]]
        for at in spots:
            old, step = p[at], 1e-2
            p[at] = old + step
            up = net.gradients(codes, label)[1]
            p[at] = old - step
            down = net.gradients(codes, label)[1]
            p[at] = old
            assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=2e-4)


@pytest.fixture(scope="module")
def predicted(spark, sf):
    return {r.doc_id: r for r in G.query(spark, sf).collect()}


def test_held_out_accuracy(spark, sf, predicted):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {d: r.held_out for d, r in predicted.items()} == {r.doc_id: G.crc_fold(r.doc_id) == 1 for r in rows}
    out = [r for r in rows if G.crc_fold(r.doc_id) == 1]
    assert sum(predicted[r.doc_id].lang_pred == r.lang for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in predicted.values())


def test_only_the_text_counts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    net = G.fit(rows, steps=10)
    text = rows.filter("doc_id = 3").first().text
    a = G.predict(spark.createDataFrame([(1, text, "xx"), (2, text, None)], "doc_id long, text string, lang string"), net).collect()
    assert a[0].lang_pred == a[1].lang_pred and a[0].score == a[1].score


def test_labels_of_held_out_documents_are_not_used(spark, documents):
    ids = [i for i in range(40) if G.crc_fold(i) == 1]
    assert G.fit(documents(["some words here"] * len(ids), ids=ids)) is None
    assert G.fit(documents(["some words here"] * 5, langs=[None] * 5)) is None


def test_edges(spark, sf, edges):
    net = G.fit(spark.read.parquet(f"{sf}/documents.parquet"), steps=10)
    got = G.predict(edges, net).collect()
    assert len(got) == edges.count()
    for r in got:
        und = r.doc.text is None or not any(map(str.isalpha, r.doc.text))
        assert (r.lang_pred == "und") is und and (r.score == 0) is und
    assert {r.lang_pred for r in G.predict(edges, None).collect()} == {"und"}
    assert G.identify(edges.limit(0)).count() == 0
    kept = G.keep_identified(spark.read.parquet(f"{sf}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() >= 195


def test_whole_texts_are_read():
    net = G.Network.fresh(["a", "b"], 3, 1)
    f = G.labeller(net, width=16, block=3)
    text = b"abc def " * 40
    whole = net.position_probabilities(np.ascontiguousarray(G.windows(text, 16).T))[:, :, :].mean(axis=(0, 2))
    assert f([text])[1][0] == pytest.approx(whole.max(), rel=1e-5)
    short = b"abcde"
    part = net.position_probabilities(np.ascontiguousarray(G.windows(short, 16).T))[:5].mean(axis=(0, 2))
    assert f([short, None, text])[1][0] == pytest.approx(part.max(), rel=1e-5)


def plain(net, text, width=16):
    """One text, byte by byte: each direction's gates in loops over windows and positions, probabilities meaned over the text."""
    size, total, n = net.recurrent[0].shape[1], np.zeros(len(net.languages)), 0
    for start in range(0, len(text), width):
        window = list(text[start : start + width].ljust(width))
        states = []
        for way in (0, 1):
            u, h, seen = net.recurrent[way].astype(float), np.zeros(size), {}
            for t in range(width) if way == 0 else reversed(range(width)):
                x = net.inputs[way][window[t]].astype(float)
                z = 1 / (1 + np.exp(-(x[:size] + u[:size] @ h)))
                r = 1 / (1 + np.exp(-(x[size : 2 * size] + u[size : 2 * size] @ h)))
                h = (1 - z) * h + z * np.tanh(x[2 * size :] + u[2 * size :] @ (r * h))
                seen[t] = h
            states.append(seen)
        for t in range(min(width, len(text) - start)):
            logits = net.out @ np.concatenate([states[0][t], states[1][t]]) + net.bias[:, 0]
            p = np.exp(logits - logits.max())
            total, n = total + p / p.sum(), n + 1
    return total / n


def test_rows_against_a_plain_loop(spark, edges):
    net = G.fit(edges.withColumn("lang", F.when(F.length("text") % 2 == 0, "en").otherwise("de")), steps=5)
    assert net.languages == ["de", "en"]
    got = G.predict(edges, net).collect()
    assert len(got) == edges.count()
    for r in got:
        text = r.doc.text
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = plain(net, text.encode(), G.WINDOW)
        assert r.score == pytest.approx(p.max(), abs=1e-4)
        assert p[net.languages.index(r.lang_pred)] == pytest.approx(p.max(), abs=1e-4)


def test_every_language_is_learned(spark):
    """Null and equal ids are drawn by their texts, many copies of one document do not hide the others, and few come down."""
    free = [i for i in range(4000) if G.crc_fold(i) != 1]
    rows = [(i, f"english words {i}", "en") for i in free[:900]] + [(None, f"deutsche Wörter {i}", "de") for i in range(900)] + [(free[0], f"mots français {i}", "fr") for i in range(900)] + [(free[1], "palabras", "es")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = G.sample(docs, per_language=40).collect()
    assert {x: sum(r.lang == x for r in drawn) for x in ("de", "en", "es", "fr")} == {"de": 40, "en": 40, "es": 1, "fr": 40}
    assert G.fit(docs, steps=2).languages == ["de", "en", "es", "fr"]
    assert len(G.sample(docs, most_documents=2).collect()) == 4


def test_windows_are_cut_from_whole_texts(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000)) + "é"
    got = G.sample(spark.createDataFrame([(0, text, "en"), (7, "ab", "de")], "doc_id long, text string, lang string")).collect()
    raw = text.encode()
    n = -(-len(raw) // 96)
    want = [raw[k * 96 : k * 96 + 96] for k in sorted({i * (n - 1) // 5 for i in range(6)})]
    assert {r.lang: [bytes(w) for w in r.windows] for r in got} == {"en": want, "de": [b"ab"]}
