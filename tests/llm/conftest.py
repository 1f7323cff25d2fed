import pytest
from pyspark.sql import types as T

#: Columns that clash with names that the operators use, and texts at the edges.
SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("h", T.StringType()), ("key", T.LongType()), ("spans", T.StringType()), ("component_id", T.StringType()), ("doc", T.StringType())]])
EDGES = [None, "", " ", "\n\n", "one", "word " * 5000, "🦀" * 3000, "x" * 40_000, "the same text twice over and over again", "the same text twice over and over again", "¿Qué? ñandú, 語 — don't\tstop\u00a0now"]


@pytest.fixture(scope="session")
def documents(spark):
    """f(texts, langs=None, ids=None): documents with columns of clashing names."""
    def make(texts, langs=None, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[k], None, None if t is None else len(t), "h", k, "s", "c", "d") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edges(documents):
    """Edge texts, a row repeated whole, a row of null id and one of an id that is there already."""
    return documents([*EDGES, EDGES[8], "no id", "another text under id eight"], ids=[*range(len(EDGES)), 8, None, 8])
