import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from syncproof.llm import simhash as S
from syncproof.llm.components import components


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, ids):
    v, boss = np.array(values, np.uint64), list(range(len(values)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= 3):
            a, b = find(i), find(int(j))
            boss[b] = a
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if r not in least else min(least[r], d)
    return [least[find(i)] for i in range(len(v))]


def test_covering_sets():
    quads = S.quadruples()
    assert len(quads) == 14
    from itertools import combinations

    for n in range(4):
        for unlike in combinations(range(8), n):
            assert any(not set(unlike) & set(q) for q in quads)


def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.query(spark, sf).collect()}
    prints = [fingerprint(t) for _, t in docs]
    want = classes(prints, [d for d, _ in docs])
    assert got == {d: (f"{f:016x}", c) for (d, _), f, c in zip(docs, prints, want, strict=True)}


def test_dense_families_lose_no_link(spark):
    rng = np.random.default_rng(5)
    family = {int(rng.integers(1 << 63)) ^ 0}
    center = next(iter(family))
    for _ in range(900):  # near copies within a few weak bits, and chains away from them
        x = center
        for b in rng.choice(14, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b * 4)
        family.add(x)
    far = [int(x) for x in rng.integers(1 << 63, size=300)]
    values = sorted(family | set(far) | {f ^ 0b111 for f in far[:50]} | {f ^ 0b1111 << 8 for f in far[50:100]})
    df = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)),) for v in values], "fingerprint long")
    want = classes(values, values)
    for dense in (512, 20):
        found = {r.node: r.component for r in components(S.links(df, dense=dense)).collect()}
        signed = [int(np.array(v, np.uint64).view(np.int64)) for v in values]
        groups, expect = {}, {}
        for v, s, w in zip(values, signed, want, strict=True):
            groups.setdefault(found.get(s, s), set()).add(v)
            expect.setdefault(w, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_edges(spark, edges):
    got = S.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    zero = [r for r in got if r.doc.text is None or not r.doc.text.strip()]
    assert {r.fingerprint for r in zero} == {0} and {r.component_id for r in zero} == {0}
    assert {r.component_id for r in got if r.doc.doc_id is None} == {None}
    assert S.near_duplicates(edges.limit(0)).count() == 0


def test_one_of_each_component_stays(spark, documents, edges):
    kept = S.keep_one(edges)
    assert kept.columns == edges.columns
    comps = {r.root for r in S.near_duplicates(edges).collect()}  # by root: an id that two texts share names two components
    rows = kept.collect()
    assert len(rows) == len(comps)
    assert [r.text for r in S.keep_one(documents(["a b c", "a b c", "x y z"])).orderBy("doc_id").collect()] == ["a b c", "x y z"]
    assert len(S.keep_one(documents(["a b c", "a b c", "x y z"], ids=[1, 1, 2])).collect()) == 2
    assert len(S.keep_one(documents(["a b c", "a b c", "x y z"], ids=[1, 2, 3]), max_broadcast_rows=0).collect()) == 2


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(e.limit(0)).count() == 0


def test_only_counted_tables_are_broadcast(spark, monkeypatch):
    """Whatever size Spark takes them for: postings are 14 times the rows that it sees."""
    from syncproof.llm import linking

    plans, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    S.links(spark.range(50).select(F.col("id").alias("fingerprint"))).collect()
    ids, few = spark.range(9), spark.range(5)
    plans += [ids.join(linking.bounded(few, 4), "id")._jdf.queryExecution().executedPlan().toString()]
    assert len(plans) > 1
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert "BroadcastHashJoin" in ids.join(linking.bounded(few, 5), "id")._jdf.queryExecution().executedPlan().toString()
