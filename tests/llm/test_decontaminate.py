import hashlib
import re

from syncproof.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if some := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= some
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def got(df):
    return sorted((r.doc.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in df.collect())


LONG = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, LONG), (2, "short item here"), (3, None), (4, "!!"), (5, LONG), (None, "no id at all"), (12, "Çelik œuvre")]
TEXTS = [None, "", "x " + LONG.upper() + " y", "a short ITEM here, short item here", "beta gamma delta epsilon zeta eta theta iota kappa", "gamma delta epsilon zeta eta theta iota kappa lambda mu beta", "Çelik œuvre", "çelik œuvre", LONG * 3, "no id at all"]


def test_brute_force(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(TEXTS)
    want = sorted(brute(list(enumerate(TEXTS)), [i for i in ITEMS if i[0] is not None]))
    assert got(D.find_contamination(docs, items)) == want
    assert got(D.find_contamination(docs, items, block_words=8)) == want  # many blocks, long items in parts


def test_edges_and_empty_tables(spark, edges):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find_contamination(edges, items).count() == edges.count()
    none = items.limit(0)
    assert {tuple(r["items"]) for r in D.find_contamination(edges, none).collect()} == {()}
    assert D.find_contamination(edges.limit(0), items).count() == 0
    kept = D.drop_contaminated(edges, items)
    assert kept.columns == edges.columns and kept.count() == edges.count()


def test_spans_are_removed(spark, documents):
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    out = D.remove_spans(documents([f"keep this. {LONG}! And that.", "clean"]), items)
    assert sorted(r.text for r in out.collect()) == ["clean", f"keep this. {re.sub('[A-Za-z]', '', LONG)}! And that."]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute([tuple(r) for r in docs], [(r.item_id, r.text) for r in items])}
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.query(spark, sf).collect()}
    assert rows == want and any(r[4] for r in rows.values())


def test_clashing_names_in_many_blocks(spark, edges):
    """A document column of the name that hits of earlier blocks are carried under."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = edges.selectExpr("*", "1 as _hits_of_blocks_before", "2 as _found", "3 as gone_id")
    some = D.find_contamination(docs, items, block_words=8)
    assert some.select("doc.*").columns == docs.columns
    found = lambda df: sorted((str(r.doc.doc_id), r.n_words, r["items"]) for r in df.collect())
    assert found(some) == found(D.find_contamination(docs, items))
    assert D.drop_contaminated(docs, items).columns == docs.columns
