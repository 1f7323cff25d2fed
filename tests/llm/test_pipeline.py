"""Every stage against what it must do to its own input."""

import pytest

import corpus_pipeline as P
from syncproof.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("input", docs)]
    for name, f in P.STAGES:
        out.append((name, cut(f(spark, out[-1][1], sf))))
    return dict(out)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert [n for n in stages] == ["input", "language", "lines", "near_duplicates", "benchmark", "tokens"]
    for name in ("language", "lines", "near_duplicates", "benchmark"):
        assert stages[name].columns == COLUMNS and dict(stages[name].dtypes) == dict(stages["input"].dtypes)


def test_stages_hand_on(stages):
    assert len(ids(stages["language"])) >= 198  # all have letters of a known language
    assert ids(stages["lines"]) == ids(stages["language"])
    assert all(r.n_chars == len(r.text) for r in stages["lines"].collect())
    assert ids(stages["near_duplicates"]) < ids(stages["lines"])
    assert ids(stages["tokens"]) == ids(stages["benchmark"]) and stages["tokens"].filter("not round_trip").count() == 0


def test_decisions(spark, sf, stages):
    from llm_brute import contaminated, simhash_classes

    lines = [(r.doc_id, r.text) for r in stages["lines"].collect()]
    assert ids(stages["near_duplicates"]) == set(simhash_classes(lines).values())
    kept = [(r.doc_id, r.text) for r in stages["near_duplicates"].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids(stages["benchmark"]) == {d for d, _ in kept} - contaminated(kept, items)


def test_run(spark, sf, stages):
    assert ids(P.run(spark, sf)) == ids(stages["tokens"])


def test_edges(spark, sf, edges):
    docs = edges.select(*COLUMNS)
    for name, f in P.STAGES:
        assert f(spark, docs, sf).count() <= docs.count(), name
        assert f(spark, docs.limit(0), sf).count() == 0, name
