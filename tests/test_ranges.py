import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from syncproof.operators import ranges, rules, storms

T0 = datetime(2024, 1, 1)


def test_a_hot_key_goes_over_ranges(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else None if i % 7 == 0 else f"k{i % 5}", i, rng.choice([None, 1, 2])) for i in range(4000)]
    rows = ranges.laid(spark.createDataFrame(data, "k string, i long, v long"), ["k"], ["i"])
    assert rows.filter("k = 'hot'").select(ranges.PART).distinct().count() > 1
    got = ranges.with_running(ranges.with_previous(rows, ["k"], F.col("v"), "before"), ["k"], F.col("v"), "total")
    assert set(got.columns) == {"k", "i", "v", "before", "total", ranges.PART, ranges.ROW}
    last, total, want = {}, {}, {}
    for k, i, v in data:
        total[k] = total.get(k, 0) + (v or 0)
        want[i] = (last.get(k), total[k])
        last[k] = v if v is not None else last.get(k)
    assert {r.i: (r.before, r.total) for r in got.collect()} == want


def test_exact_storm_of_one_signature(spark):
    rng, at, data, want, n = random.Random(4), 0, [], {}, 0
    for i in range(3000):
        step = rng.choice([1, 5, 299, 300, 301])
        at += step
        n += i == 0 or step > 300
        data.append(("s", i, T0 + timedelta(seconds=at)))
        want[i] = (n, i == 0 or step > 300)
    got = storms.storm_exact(spark.createDataFrame(data, "signature string, seq long, ts timestamp")).collect()
    assert {r.seq: (r.cluster, r.is_new) for r in got} == want


def test_incidents_of_one_fingerprint(spark):
    n, schema = 3000, "seq long, ts timestamp, fingerprint string, pipeline_id long, rule_id long, stream string, rule_name string, event string, severity string, channel_ids array<long>"
    m = spark.createDataFrame([(i, T0 + timedelta(seconds=i), "f", 1, 5, "s", "failed", "sync_failed", "critical", [1]) for i in range(n)], schema)
    closed = sorted(random.Random(5).sample(range(n), 40))
    got = {r.island: (r.event_count, r.opened_seq) for r in rules.incident_dedup(m, spark.createDataFrame([("f", i) for i in closed], "fingerprint string, seq long")).collect()}
    want = {}
    for i in range(n):
        island = sum(c < i for c in closed)
        count, first = want.get(island, (0, i))
        want[island] = (count + 1, first)
    assert got == want


def one_by_one(signals, gap):
    """Each connector's signals in order against all its live clusters: an exact key first, then alike words."""
    words = lambda t: {w for w in t.split() if w != "?"}
    out, live, made = {}, {}, {}
    for connector, seq, at, code, normal in sorted(signals, key=lambda s: (s[2], s[1])):
        mine, key = live.setdefault(connector, []), code or normal
        mine[:] = [c for c in mine if at - c["last"] <= gap]
        a = words(normal)
        hit = next((c for c in mine if c["key"] == key), None)
        if hit is None and not code:
            hit = next((c for c in mine if not c["code"] and a and c["words"] and len(a & c["words"]) / len(a | c["words"]) >= storms.ALIKE), None)
        if hit is None:
            made[connector] = made.get(connector, 0) + 1
            hit = {"key": key, "code": code, "words": a, "n": made[connector]}
            mine.append(hit)
            out[seq] = (hit["n"], True)
        else:
            out[seq] = (hit["n"], False)
        hit["last"] = at
    return out


def test_fuzzy_storms_without_silence(spark):
    rng, signals, at = random.Random(6), [], 0
    for seq in range(4000):
        at += rng.choice([0, 1, 2, 40])
        topic = rng.randrange(8)
        own = [f"t{topic}w{j}" for j in range(6)]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(6)] = f"t{topic}x{rng.randrange(3)}"
        message = " ".join(own) if rng.random() < 0.97 else ""
        signals.append((rng.choice(["a", "a", "a", "b"]), seq, at, rng.choice(["", "", "", "E1", "t0w0"]), message))
    df = spark.createDataFrame([(c, s, T0 + timedelta(seconds=t), k or None, m or None) for c, s, t, k, m in signals], "connector string, seq long, ts timestamp, code string, message string")
    got = {r.seq: (r.cluster, r.is_new) for r in storms.storm_fuzzy(df).collect()}
    # digits are part of words here, so the messages are taken as the operator normalises them
    normal = {r.seq: r.n for r in df.select("seq", storms.normalize(F.coalesce("message", F.lit(""))).alias("n")).collect()}
    want = one_by_one([(c, s, t, k, normal[s]) for c, s, t, k, _ in signals], storms.GAP_SECONDS)
    assert got == want
    assert storms.storm_fuzzy(df.limit(0)).count() == 0


def test_families_are_what_alike_kinds_reach(spark):
    chain = [" ".join(f"w{j}" for j in range(i, i + 8)).replace("w", "v") for i in range(30)]
    kinds = spark.createDataFrame([("=a", s, s.split()) for s in chain] + [("=b", chain[0], chain[0].split()), ("=a", "lone", ["lone"]), ("=a", "", [])], "who string, sig string, words array<string>")
    pairs = storms.alike_kinds(kinds)
    sets = {(r.who, r.sig): set(r.words) for r in kinds.collect()}
    want = {(w, a, b) for (w, a), x in sets.items() for (v, b), y in sets.items() if w == v and a < b and x and y and len(x & y) / len(x | y) >= 0.6}
    assert {tuple(r) for r in pairs.collect()} == want
    got = {(r.who, r.sig): r.family for r in storms.families(kinds, pairs).collect()}
    assert got == {("=a", s): min(chain) for s in chain} | {("=b", chain[0]): chain[0], ("=a", "lone"): "lone", ("=a", ""): ""}
