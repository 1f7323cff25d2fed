import hashlib

import pytest

from syncproof.llm import fingerprint as P


def test_query_against_brute_force(spark, sf):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in P.query(spark, sf).collect()}
    errors = []
    for i, (d, x) in enumerate(docs):
        y, r = docs[(i + 1) % len(docs)][1], got[d]
        e = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = (P.shingle_set(t, 5) for t in (x, e, y))
        errors += [abs(len(a & b) / len(a | b) - r.near_edited), abs(len(a & c) / len(a | c) - r.near_next)]
    assert len(got) == len(docs) and sum(errors) / len(errors) < 0.03 and max(errors) < 0.25
    by_text = {}
    for d, x in docs:
        assert by_text.setdefault(x, got[d].fingerprint) == got[d].fingerprint


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_next_documents_over_ranges(spark, documents, partitions):
    texts = [None, "", "a b c d e f", "é" * 7, "a b c d e f"]
    docs = documents(texts).select("doc_id", "text").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: r for r in P.fingerprint_with_next(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for d, t in enumerate(texts):
        x, y = t or "", texts[(d - 1) % 5] or ""
        assert got[d].edited_sha256 == hashlib.sha256((x[: len(x) - len(x) // 2] + y[: len(x) // 2]).encode()).hexdigest()
    assert got[2].fingerprint == got[4].fingerprint and got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1.0


def test_edges(spark, edges):
    got = P.fingerprint_with_next(edges.select("doc_id", "text")).collect()
    assert len(got) == edges.count() and all(0 <= r.near_edited <= 1 for r in got)
    assert P.fingerprint_with_next(edges.select("doc_id", "text").limit(0)).count() == 0
    one = P.fingerprint_with_next(edges.select("doc_id", "text").filter("doc_id = 4")).first()
    assert one.edited_sha256 == hashlib.sha256(b"ono").hexdigest() and one.near_next == 1.0


def test_near_duplicate_classes(spark, documents):
    base = " ".join(f"w{i}" for i in range(200))
    family = [base.replace(f"w{k * 20 + 10} ", f"new{k} ") for k in range(8)]
    texts = [base, *family, base, "something else altogether " * 3, None, ""]
    got = {r.doc_id: r.class_id for r in P.near_duplicates(documents(texts)).collect()}
    assert [got[i] for i in range(10)] == [0] * 10 and got[10] == 10 and got[11] == got[12] == 11


def test_classes_against_all_pairs(spark, sf):
    from collections import Counter

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    boss, index, sets = {d: d for d, _ in docs}, {}, {d: P.shingle_set(t, 5) for d, t in docs}

    def find(d):
        while boss[d] != d:
            d = boss[d]
        return d

    for d, t in docs:
        for other, n in Counter(o for g in sets[d] for o in index.get(g, ())).items():
            if n >= 0.8 * (len(sets[d]) + len(sets[other]) - n):
                a, b = sorted((find(d), find(other)))
                boss[b] = a
        for g in sets[d]:
            index.setdefault(g, []).append(d)
    got = {r.doc_id: r.class_id for r in P.query(spark, sf).collect()}
    assert got == {d: find(d) for d, _ in docs} and len(set(got.values())) < len(docs)
