import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from syncproof.llm import trie

SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("at", T.StringType()), ("a", T.LongType()), ("block", T.LongType())]])


@pytest.fixture(scope="module")
def made(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def plain_turns(rows):
    """conv_id -> ordered (role, text)."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v, key=lambda s: (s[0], s[1].encode(), s[2].encode()))] for c, v in out.items()}


def plain_trie(paths):
    """The trie of conv_id -> path, node by node."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = set()
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        ends = ",".join(map(str, sorted(c for c in own if len(paths[c]) == len(p))))
        out.add((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(turns, width=8, rebuild=True):
    steps = trie.turns(turns)
    convs, steps = trie.rebuilt(steps) if rebuild else (trie.conversations_of(steps).select("conv_id"), steps)
    steps = trie.named(steps)
    last = trie.ends(convs, steps)
    rows = trie.trie(last, steps, width).join(trie.end_digests(last), ["depth", "node_a", "node_b"], "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or none) for r in rows]
    assert len(set(got)) == len(got)
    return set(got)


def branching(seed, convs, most, words="ab"):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]) if t % 3 else "user", rng.choice(words) * rng.choice([1, 1, 2])) for c in convs for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("width", [2, 8])
def test_long_and_branching_conversations(made, width):
    """Copies, prefixes of others, and paths over many blocks."""
    rows = branching(1, range(40), 7) + [(c, t, "user", f"long {t}" if t < 21 + c % 3 else f"own {c}") for c in range(50, 56) for t in range(25)]
    assert found(made(rows), width, rebuild=False) == plain_trie(plain_turns(rows))


def test_edges(made):
    """Null ids, turns, roles and texts, rows repeated whole, ties of turns, empty texts, a long text, surrogate pairs."""
    rows = [(None, 0, "user", "x"), (7, None, "user", "null first"), (7, 0, None, None), (7, 0, "user", ""), (7, 0, "user", ""), (8, None, "user", "null first"), (8, 0, "", ""), (9, 3, "user", "y" * 100_000), (10, 5, "user", "🦀" * 3), (11, 1, "user", "🦀" * 3), (-5, 1, "user", "n")]
    assert found(made(rows), 2, rebuild=False) == plain_trie(plain_turns(rows))
    assert found(made([])) == set()
    assert found(made([(None, 0, "user", "x")])) == set()


def test_rebuilding(made):
    """First turns come from the hundred's first conversation; conversations may become turnless."""
    rows = branching(3, [0, *range(1, 30), *range(130, 150), *range(200, 230)], 6)
    paths = plain_turns(rows)
    new = {}
    for c, path in paths.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = paths.get(c - c % 100, [])[:h] + path[h:]
    assert any(not p for p in new.values())
    assert found(made(rows), 4) == plain_trie(new)


def test_sums_run_on_over_runs_of_blocks(made):
    rows = [(1, t, "user", str(t)) for t in range(45)] + [(2, t, "user", str(t)) for t in range(44)]
    steps = trie.named(trie.turns(made(rows)))
    last = trie.ends(trie.conversations_of(steps).select("conv_id"), steps)
    few = {tuple(r)[:5] for r in trie.blocks(last, steps, 4, run=2).collect()}
    assert few == {tuple(r)[:5] for r in trie.blocks(last, steps, 4).collect()}


def test_digest_of_pieces_is_that_of_the_whole(spark):
    ids = list(range(5, 4000, 3))
    last = spark.createDataFrame([(c, 2, 7, 8, 0) for c in ids] + [(1, 3, 7, 8, 0)], "conv_id long, depth long, a long, b long, chars long")
    assert trie.joined_ids(last, 400).count() > 60
    got = {r.depth: r.ends_sha256 for r in trie.end_digests(last, 400).collect()}
    assert got == {2: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 3: hashlib.sha256(b"1").hexdigest()}


def test_hot_join(spark):
    from syncproof.llm.skew import join_hot

    left = spark.createDataFrame([(1, i) for i in range(900)] + [(i, i) for i in range(2, 100)] + [(-1, 0)] * 50, "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(50)], "k long, w long")
    assert sorted(map(tuple, join_hot(left, right, ["k"]).fillna(-9).collect())) == sorted(map(tuple, left.join(right, "k", "left").fillna(-9).collect()))
    assert join_hot(left.limit(0), right, ["k"]).count() == 0
