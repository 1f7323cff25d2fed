from collections import Counter

from syncproof.llm import line_dedup as L


def brute(docs):
    """(doc_id, line number) to drop, by all pairs of unlike lines."""
    lines = [(d, i, x) for d, t in sorted(docs) for i, x in L.eligible(t.encode() if t else None, L.MIN_CHARS)]
    first = {}
    for d, i, x in lines:
        first.setdefault(x, (d, i))
    each = list(first)
    sets, boss, index = [L.shingles(x.decode(), L.SHINGLE) for x in each], list(range(len(each))), {}

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in index.get(g, ())).items():
            if n >= L.SIMILAR * (len(s) + len(sets[j]) - n):
                boss[find(i)] = find(j)
        for g in s:
            index.setdefault(g, []).append(i)
    keeper = {}
    for i, x in enumerate(each):
        keeper[find(i)] = min(keeper.get(find(i), first[x]), first[x])
    place = {x: i for i, x in enumerate(each)}
    return {(d, i) for d, i, x in lines if keeper[find(place[x])] != (d, i)}


def test_query_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    got = {(r.doc_id, int(i)) for r in L.query(spark, sf).collect() for i in r.dropped_lines.split(",") if i}
    assert not got - want and len(got) >= 0.97 * len(want)


def test_lines_are_taken_out(spark, documents):
    line = "A line of some length that comes again in many documents."
    near = line.replace("many documents", "many document")
    docs = documents([f"{line}\nown words of the first document here", f"intro\n{line.upper()}\n\nown words of the second one here", near, None, "", "short\nshort", f"{line}\n{line}"])
    out = {r.doc_id: r.text for r in L.drop_lines(docs).collect()}
    assert out == {0: f"{line}\nown words of the first document here", 1: "intro\n\nown words of the second one here", 2: "", 3: None, 4: "", 5: "short\nshort", 6: ""}
    assert L.drop_lines(docs).columns == docs.columns


def test_large_families_become_one(spark, documents):
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(words[:k] + [f"changed{k}"] + words[k + 1 :]) for k in range(60)] + [" ".join(words)] * 40
    gone = L.dropped_lines(documents(texts)).collect()
    assert len(gone) == 99


def test_edges(spark, edges):
    assert L.drop_lines(edges).count() == edges.count()
    assert L.dropped_lines(edges.limit(0)).count() == 0
    both = L.dropped_lines(edges, max_broadcast_rows=0).collect()
    assert sorted(map(str, both)) == sorted(map(str, L.dropped_lines(edges).collect()))
    repeated = edges.filter("doc_id = 8 and text like 'the same%'")
    assert L.drop_lines(repeated).filter("text <> ''").count() == 2  # one document, given twice


def test_short_lines_are_compared(spark, sf, documents):
    import corpus_pipeline as P

    texts = ["All rights reserved.\nend\nfirst own words", " all  rights RESERVED.\n\nEND\nsecond own words", "语\nabcdefg\nabcdefgh", "语\nabcdefh\nabcdefgh", "menu item number one 23", "menu item number one 24"]
    docs = documents(texts)
    want = brute(list(enumerate(texts)))
    assert want == {(1, 0), (1, 2), (3, 0), (3, 2), (5, 0)}
    assert {(r.doc_id, i) for r in L.dropped_lines(docs).collect() for i in r.dropped} == want
    out = {r.doc_id: r.text for r in P.lines(spark, docs, sf).collect()}
    assert out == dict(enumerate(texts)) | {1: "\nsecond own words", 3: "abcdefh", 5: ""}


def test_lengths_of_similar_lines_may_differ(spark, documents):
    gone = L.dropped_lines(documents(["-" * 30, "-" * 400])).collect()
    assert [(r.doc_id, r.dropped) for r in gone] == [(1, [0])]


def test_pairs_that_share_a_passage_are_found(spark, documents):
    import random

    rng = random.Random(1)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n)).replace("  ", "xy").strip().ljust(n, "z")
    passage = some(150)
    texts = [f"{own}{end}" for own in (passage + some(48) for _ in range(150)) for end in (some(8), some(8))]
    want = brute(list(enumerate(texts)))
    assert want == {(d, 0) for d in range(1, 300, 2)}
    assert (1 - L.SIMILAR**L.ROWS) ** L.BANDS < 0.01
    assert {(r.doc_id, i) for r in L.dropped_lines(documents(texts)).collect() for i in r.dropped} == want
