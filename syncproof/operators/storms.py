"""Alert storms: signatures of failures, and clusters of equal or alike ones in a rolling window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncproof.functions.joins import bounded
from syncproof.operators.ranges import PART, ROW, laid, with_previous, with_running
from syncproof.scratch import cut

#: The patterns that a message's variable parts are told by, the gap and the likeness of a storm's messages.
GAP_SECONDS, ALIKE = 300, 0.6


def normalize(message: Column) -> Column:
    """The message in lower case with quoted parts, hex or long ids and numbers as `?`, and single spaces."""
    out = F.lower(message)
    for regex in (r""""[^"]*"|'[^']*'""", r"0x[0-9a-fA-F]+|[0-9a-fA-F]{8,}", r"\d+"):
        out = F.regexp_replace(out, regex, "?")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def signature(connector: Column, code: Column, message: Column) -> Column:
    return F.concat(connector, F.lit("|"), F.when(F.coalesce(code, F.lit("")) != "", code).otherwise(normalize(F.coalesce(message, F.lit("")))))


def storm_exact(signals: DataFrame, key: str = "signature", ts: str = "ts", seq: str = "seq", gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """signals with cluster (number within the signature) and is_new: a signal more than the gap after the one before opens a cluster.

    A signature may hold any share of the signals: they are laid out by ranges. A signal without a time opens a cluster.
    """
    rows = with_previous(laid(signals, [key], [ts, seq]), [key], F.col(ts), "_before")
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.col("_before"))
    opened = rows.withColumn("is_new", F.coalesce(gap > gap_seconds * 1_000_000, F.lit(True)))
    return with_running(opened, [key], F.col("is_new"), "cluster").drop(PART, ROW, "_before")


def words(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: (t != "?") & (t != "")))


def alike_kinds(kinds: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(who, a, b), a < b: pairs of kinds (who, sig, words) whose words are alike, found by an inverted index of words.

    Two sets so alike share one of the rarest words of each, as many as may be missing and one more, so only these are indexed.
    """
    each = kinds.filter("size(words) > 0").select("who", "sig", "words", F.explode("words").alias("word"))
    counted = each.join(each.groupBy("who", "word").agg(F.count("*").alias("uses")), ["who", "word"])
    ranked = counted.groupBy("who", "sig").agg(F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct("uses", "word"))).alias("order"))
    size = F.size("words")
    index = ranked.select("who", "sig", "words", F.explode(F.slice("order", F.lit(1), size - F.ceil(size * alike - 1e-9).cast("int") + 1)["word"]).alias("word"))
    other = index.select("who", "word", F.col("sig").alias("b"), F.col("words").alias("words_b"))
    fits = (F.col("sig") < F.col("b")) & (F.least(size, F.size("words_b")) >= alike * F.greatest(size, F.size("words_b")) - 1e-9)
    shared = F.size(F.array_intersect("words", "words_b"))
    met = index.join(other, ["who", "word"]).filter(fits).filter(shared / (size + F.size("words_b") - shared) >= alike)
    return met.select("who", F.col("sig").alias("a"), "b").distinct()


def families(kinds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(who, sig, family): the least signature that a kind reaches over pairs. Labels go to neighbours and to the labels' own labels until none changes."""
    labels = cut(kinds.select("who", "sig", F.col("sig").alias("family")))
    if pairs.isEmpty():
        return labels
    both = cut(pairs.unionByName(pairs.select("who", F.col("b").alias("a"), F.col("a").alias("b"))))
    while True:
        near = both.join(labels.select("who", F.col("sig").alias("b"), F.col("family").alias("near")), ["who", "b"]).groupBy("who", F.col("a").alias("sig")).agg(F.min("near").alias("near"))
        lower = labels.join(near, ["who", "sig"], "left").select("who", "sig", F.col("family").alias("was"), F.least("family", "near").alias("to"))
        lower = cut(lower)
        jump = lower.select("who", F.col("sig").alias("to"), F.col("to").alias("beyond"))
        moved = cut(lower.join(jump, ["who", "to"], "left").select("who", "sig", "was", F.least("to", "beyond").alias("family")))
        labels = moved.drop("was")
        if moved.filter("family < was").isEmpty():
            return labels


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


class Clusters:
    """Live clusters of one stretch, in the order they were opened: one for each kind of message at most. Times and gap in microseconds."""

    def __init__(self, gap: int, alike: float = ALIKE):
        self.gap, self.alike, self.live, self.opened = gap, alike, [], 0

    def add(self, first: int, last: int, sig: str, coded: bool, own: frozenset[str]) -> tuple[int, bool]:
        """(cluster, is_new) of a run of signals of one kind, from its first time to its last."""
        self.live = [c for c in self.live if first - c["last"] <= self.gap]
        same = [c for c in self.live if c["sig"] == sig]
        near = [c for c in self.live if not coded and not c["coded"] and jaccard(own, c["words"]) >= self.alike] if not same else []
        for c in (same + near)[:1]:
            c["last"] = last
            return c["number"], False
        self.opened += 1
        self.live.append({"number": self.opened, "sig": sig, "coded": coded, "words": own, "last": last})
        return self.opened, True


def storm_fuzzy(signals: DataFrame, connector: str = "connector", ts: str = "ts", seq: str = "seq", gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """(connector, seq, cluster, is_new): signals without a code also join a live cluster of alike words (its first message's).

    Order matters only among kinds of messages that are alike, directly or over others (a family): no other signal can join their clusters.
    A family's signals are cut at its own silences, and signals of one kind in a row are one run, as they all join one cluster. The runs of a
    stretch go through a fold that holds the live clusters only; a family whose kinds take turns without a silence is one task's stream of runs.
    Clusters are numbered within the connector in the order they were opened. Every signal must have a time.
    """
    gap, family = gap_seconds * 1_000_000, ["who", "family"]
    who = F.coalesce(F.concat(F.lit("="), F.col(connector)), F.lit(""))
    code, normal = F.coalesce("code", F.lit("")), normalize(F.coalesce("message", F.lit("")))
    slim = cut(signals.select(F.col(connector).alias("connector"), who.alias("who"), F.col(seq).alias("seq"), F.unix_micros(F.col(ts)).alias("at"), (code != "").alias("coded"), words(normal).alias("words"), F.coalesce(signature(F.col(connector), F.col("code"), F.col("message")), F.lit("")).alias("sig")))
    kinds = cut(slim.groupBy("who", "sig").agg(F.max(F.when(~F.col("coded"), F.col("words"))).alias("words")))
    of = families(kinds, alike_kinds(kinds.filter("words is not null")))
    rows = laid(slim.drop("words").join(bounded(of), ["who", "sig"]), family, ["at", "seq"])
    seen = with_previous(rows, family, F.struct("at", "sig", "coded"), "_before")
    silent = F.coalesce(F.col("at") - F.col("_before.at") > gap, F.lit(True))
    turn = silent | (F.col("_before.sig") != F.col("sig")) | (F.col("_before.coded") != F.col("coded"))
    marked = cut(seen.withColumn("_silent", silent).withColumn("_turn", turn).drop("_before"))
    numbered = cut(with_running(with_running(marked, family, F.col("_silent"), "stretch"), family, F.col("_turn"), "run"))
    run = [*family, "stretch", "run"]
    runs = numbered.groupBy(*run).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("sig").alias("sig"), F.first("coded").alias("coded"), F.min_by(F.struct("at", "seq", ROW), ROW).alias("opening"))
    runs = runs.join(bounded(kinds), ["who", "sig"])

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, clusters = None, None
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if (r.who, r.family, r.stretch) != now:
                    now, clusters = (r.who, r.family, r.stretch), Clusters(gap)
                out.append((*now, r.run, r.at, r.seq, r.first_row, *clusters.add(r.first, r.last, r.sig, r.coded, frozenset(() if r.words is None else r.words))))
            yield pd.DataFrame(out, columns=["who", "family", "stretch", "run", "at", "seq", "first_row", "own", "opens"])

    slim_runs = runs.select(*run, "first", "last", "sig", "coded", "words", F.col("opening.at").alias("at"), F.col("opening.seq").cast("long").alias("seq"), F.col(f"opening.{ROW}").alias("first_row"))
    dealt = slim_runs.repartition(*run[:3]).sortWithinPartitions(*run)
    found = cut(dealt.mapInPandas(fold, "who string, family string, stretch long, run long, at long, seq long, first_row long, own long, opens boolean"))
    opened = with_running(laid(found.filter("opens").select(*run[:3], "own", "at", "seq"), ["who"], ["at", "seq"]), ["who"], F.lit(1), "cluster")
    placed = found.join(opened.select(*run[:3], "own", "cluster"), [*run[:3], "own"]).select(*run, "first_row", "opens", "cluster")
    here = numbered.groupBy(PART, *run).agg(F.lit(None).alias("_")).drop("_").join(placed, run)  # a run of many ranges is met in each apart
    out = numbered.join(bounded(here), [PART, *run])
    return out.select("connector", "seq", "cluster", (F.col("opens") & (F.col(ROW) == F.col("first_row"))).alias("is_new"))
