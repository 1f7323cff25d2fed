import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from syncproof.llm import collocation


def plain(docs, least, longest, k):
    """The contract in loops: docs are (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        rows = []
        for p, a in found.items():
            if 100 * inside[p] >= 100 * a:
                continue
            score, cut = min((1000 * a * n[lang] // (counts[p[:c]] * counts[p[c:]]), c) for c in range(1, len(p)))
            rows.append((score, a, " ".join(p), counts[p[:cut]], counts[p[cut:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(rows[:k])]
    return sorted(out)


def mined(spark, docs, least=4, longest=5, k=50, **settings):
    df = spark.createDataFrame([(i, t, lang, 1, "p") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n long, phrase string")
    return sorted(map(tuple, collocation.mine(df, least, longest, k, **settings).collect()))


def prose(seed, docs=60):
    rng = random.Random(seed)
    common = "New York Times of the United States of America in the end of the day ÉTÉ été naïve 語 x\x1fy  z".split(" ")
    out = []
    for i in range(docs):
        text = "".join(rng.choice(common) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "; "]) for _ in range(rng.randint(0, 80)))
        out.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return out


EDGES = [("en", None), ("en", ""), (None, " \t"), ("en", ".,;:!?\n\r\x0b\x0c"), ("de", "ein Wort"), ("en", "a b a b a b a b a b a b a"), ("en", "Same same SAME same"), ("en", "Same same SAME same"), ("fr", "la la " * 3000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, seed):
    docs = prose(seed) + EDGES
    want = plain(docs, 4, 5, 50)
    assert len(want) > 40
    assert mined(spark, docs) == want


def test_joins_give_the_same(spark):
    docs = prose(3) + EDGES
    want = plain(docs, 4, 4, 30)
    assert mined(spark, docs, longest=4, k=30, most_known=5, shards=2) == want == mined(spark, docs, longest=4, k=30, shards=3)


def test_late_words_still_get_a_whole_cycle(spark):
    """A word that reaches the threshold in the last shard only: its phrases are counted in all shards, those before included."""
    docs = [("en", "alpha beta gamma delta eps")] * 7 + [("en", "filler words here")] * 3
    for shards in (1, 4, 7):
        assert mined(spark, docs, least=7, shards=shards) == plain(docs, 7, 5, 50) == [("en", 1, "alpha beta gamma delta eps", 7, 7, 7, 44, 6285)]


def test_exact_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", 1, "a", 9_999_999_999_999), ("en", 1, "b", 9_999_999_999_997), ("en", 2, "a b", 9_999_999_999_990)], "lang string, n int, phrase string, f long")
    totals = spark.createDataFrame([("en", 123_456_789_012_345)], "lang string, n long")
    r = collocation.scored(phrases, totals).collect()[0]
    assert r.score == 1000 * 9_999_999_999_990 * 123_456_789_012_345 // (9_999_999_999_999 * 9_999_999_999_997)


def test_no_documents(spark):
    assert mined(spark, [("en", None)]) == []
    assert collocation.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_over_a_million_phrases_are_counted_by_ids(spark, monkeypatch):
    """1.2 million pairs, which an earlier bound of a million gave to joins of all n-grams, from the first scan again."""
    def refused(*args):
        raise AssertionError("counted by joins")

    monkeypatch.setattr(collocation, "scan_joined", refused)
    at = np.random.default_rng(1).integers(0, 3000, (65, 20_000))
    df = spark.createDataFrame([("en", " ".join(f"w{i}" for i in row)) for row in at.tolist()], "lang string, text string")
    phrases, totals = collocation.count_phrases(df, least=1, longest=3)
    pairs, times = np.unique(at[:, :-1] * 3000 + at[:, 1:], return_counts=True)
    got = phrases.groupBy("n").agg(F.count("*"), F.sum("f"), F.max("f")).orderBy("n").collect()
    assert len(pairs) > 1_000_000
    assert tuple(got[1]) == (2, len(pairs), times.sum(), times.max())
    assert [tuple(r) for r in totals.collect()] == [("en", at.size)]


def test_long_phrases_and_wide_slices(spark):
    """More words than 16 bits number, in one slice, and slices cut at every document."""
    text = " ".join(f"w{i}" for i in range(70_000)) + ". " + "w69998 w69999 w0 " * 3
    docs = [("en", text)] * 2 + [(None, "x y z. " * 5)]
    df = spark.createDataFrame(docs, "lang string, text string")
    dealt = collocation.deal(df, 2, "lang", "text", nbytes=10).collect()
    assert sorted((r.lang, len(r.words.split())) for r in dealt) == [("en", 70_000), ("en", 70_000), ("und", 3)]
    assert mined(spark, docs, least=5) == plain(docs, 5, 5, 50)
