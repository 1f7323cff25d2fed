import numpy as np

from syncproof.llm import quality as Q


def test_scores(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in Q.query(spark, sf).collect()}
    assert len(got) == 200 and all(0 <= r.score <= 1 for r in got.values())
    assert set(labels) <= set(got)


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    n = 600
    y = rng.integers(0, 2, n)
    content, metadata = (rng.standard_normal((n, 8)) + (2 * y - 1)[:, None] * 0.9 for _ in range(2))
    few = np.arange(n) < 60
    calibrating = np.arange(60) % 3 == 0
    x, pool = (content[few], metadata[few]), (content[~few][:400], metadata[~few][:400])
    test = (content[460:], metadata[460:])
    model = Q.co_train(x, y[few], pool, calibrating)
    each = [np.mean((s >= 0.5) == y[460:]) for s in model.scores(*test)]
    assert each[2] >= 0.95 and each[2] >= min(each[:2])
    assert all(n > 0 for n in model.handed.values()) and len(model.handed) == 4
    alone = Q.co_train(x, y[few], pool, calibrating, rounds=0)
    before = [np.mean((s >= 0.5) == y[460:]) for s in alone.scores(*test)]
    assert sum(each) >= sum(before) and sum(alone.handed.values()) == 0


def test_a_weak_view_teaches_both_classes():
    rng = np.random.default_rng(1)
    n = 900
    y = (rng.random(n) < 0.75).astype(int)
    content = rng.standard_normal((n, 8)) + (2 * y - 1)[:, None] * 2.0
    metadata = rng.standard_normal((n, 6)) + (2 * y - 1)[:, None] * 0.25  # never 95 % sure of a bad one
    few = np.arange(n) < 300
    model = Q.co_train((content[few], metadata[few]), y[few], (content[~few], metadata[~few]), np.arange(300) % 4 == 0)
    assert model.handed[1, 0] > 0 and model.handed[1, 1] > 0 and model.handed[0, 0] > 0 and model.handed[0, 1] > 0
    assert np.mean((model.scores(content[~few], metadata[~few])[2] >= 0.5) == y[~few]) > 0.97


def test_scores_against_the_formula(spark, sf):
    """Every row's score is recomputed one document at a time from the fitted weights."""
    import math

    from syncproof.llm.fingerprint import WordHashes

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels)
    got = {r.doc_id: r for r in Q.query(spark, sf).collect()}
    for r in docs.collect():
        if model.constant is not None:
            assert got[r.doc_id].score == model.constant
            continue
        text, row = (r.text or "").encode(), {"lang": r.lang, "source": r.source, "n_chars": r.n_chars}
        views = [Q.content_features([text], WordHashes())[0], Q.metadata_features([row], [text])[0]]
        odds = [s * (sum(float(a) * float(b) for a, b in zip(v, w[:-1], strict=True)) + float(w[-1])) + o for v, w, (s, o) in zip(views, (model.content, model.metadata), model.calibration, strict=False)]
        s, o = model.calibration[2]
        want = [*odds, s * (sum(odds) - model.prior) + o]
        for name, z in zip(("content_score", "metadata_score", "score"), want, strict=True):
            assert abs(got[r.doc_id][name] - 1 / (1 + math.exp(-z))) < 1e-3


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.fit(docs, labels.filter("doc_id % 3 <> 0"))
    want = {r.doc_id: r.quality for r in labels.filter("doc_id % 3 = 0").collect()}
    got = {r.doc.doc_id: r.score >= 0.5 for r in Q.score(docs, model).collect()}
    assert np.mean([got[d] == bool(q) for d, q in want.items()]) > 0.95


def test_edges(spark, edges):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.score(edges, Q.fit(edges, none)).collect()
    assert len(got) == edges.count() and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (99, 0), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in Q.score(edges, Q.fit(edges, labels)).collect()} == {1.0}
    assert Q.score(edges.limit(0), Q.fit(edges.limit(0), none)).count() == 0
    both = spark.createDataFrame([(i, i % 2) for i in range(11)], "doc_id long, quality int")
    assert Q.score(edges, Q.fit(edges, both)).count() == edges.count()
