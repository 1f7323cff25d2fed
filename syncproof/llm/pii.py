"""Personal data: pattern matches with checks, and bootstrapped contextual extraction from them, all in native Columns.

Base matches (email, ip, card, phone) are the seeds. A seed's lexical pattern is the word before it. What has the shape of
an identifier and overlaps no seed is a candidate instance, also with the word before it: words with digits, groups of digits
with spaces, dots, brackets or hyphens between them, and addresses with @ or a spelled "at". Patterns and instances form
a bipartite graph, scored in rounds. A pattern's score for a kind is the sum of its instances' scores over their number
plus one; seeds have the score 1, other instances the mean over the scored patterns that they stand behind. A pattern is scored
once `support` distinct instances behind it have a score of `confident` or more: at first these are seeds only, later also
candidates that other patterns found, so instances induce new patterns. Patterns that end at `confident` or more report
every candidate behind them as a span of their kind. Base spans always stay as they are.

The regular expressions are those of the contract with possessive repeats and, where a run could be tried from each of its
characters, a guard for the run's start (or the end of the match before): they match the same, in linear time and stack.

Defined cases: null text counts as empty; a document without matches has empty strings and zero counts; rows repeated with
id and text are judged alike; no seeds give no patterns; a pattern that is accepted for several kinds takes the one of the best
score, at equal scores the first as listed; a text's work grows with its length times the logarithm of its matches; extra
columns do not enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syncproof.llm.common import cut, table
from syncproof.llm.spans import PLACE, as_spans, clear_of, digits, listed, places

KINDS = ["email", "ip", "card", "phone"]
REGEX = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPACE, INK = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
#: What a candidate looks like, from the start of a word: digit groups of one number, an address with @ or "at", a word with a digit.
SHAPES = [
    rf"[+(]?[0-9]++(?:[\x20().-]{{1,2}}[0-9]++(?![^{SPACE}().,;:!?\]\"'-])){{1,5}}+",
    rf"[^{SPACE}@]++@{INK}++",
    rf"{INK}+?[-_(\[{{](?i:at)[-_)\]}}]\p{{L}}{INK}*+",
    rf"\p{{L}}{INK}*+\x20at\x20[\p{{L}}-]++\x20dot\x20\p{{L}}++",
    rf"[^{SPACE}0-9]*+[0-9]{INK}*+",
]
CANDIDATE = rf"(?<!{INK})(?:{'|'.join(SHAPES)})"
LEFT_WORD = r"(\p{L}[\p{L}\p{M}_]*)[^\p{L}\p{M}_]{0,3}$"


def small_number(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(plain) <= 3) & (F.substring(plain, 1, 3).cast("int") <= 255)


def luhn(number: Column) -> Column:
    """number: digits."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x["hit"], r"\."), small_number),
    "card": lambda x: F.length(digits(x["hit"])).between(12, 19) & luhn(digits(x["hit"])),
    "phone": lambda x: F.length(digits(x["hit"])).between(9, 15),
}
#: What a text must hold for a kind to occur at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 4) -> DataFrame:
    """(doc_id, h: hash of the text, n_*, covered: base spans, seeds, candidates of so many code points or more)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    tried = rows.withColumns({k: places(F.when(F.contains("text", F.lit(NEEDS[k])), F.col("text")).otherwise(""), REGEX[k]) for k in KINDS} | {"words": places(F.col("text"), CANDIDATE)})
    kept = tried.withColumns({k: F.filter(k, VALID[k]) for k in KINDS})
    free = F.filter(clear_of(F.col("words"), *[F.col(k) for k in KINDS]), lambda x: F.length(trimmed(x["hit"])) >= shortest)
    before = lambda x: F.lower(F.regexp_extract(F.right(x["gap"], F.lit(40)), LEFT_WORD, 1))
    seeds = F.concat(*[F.transform(k, lambda x, i=i: F.struct(F.lit(i).alias("kind"), before(x).alias("left"), x["hit"].alias("value"))) for i, k in enumerate(KINDS)])
    shift = lambda x: x["start"] + leading(x["hit"])
    candidates = F.transform(free, lambda x: F.struct(before(x).alias("left"), trimmed(x["hit"]).alias("value"), shift(x).alias("start"), (shift(x) + F.length(trimmed(x["hit"]))).alias("end")))
    covered = F.concat(*[as_spans(F.col(k), i) for i, k in enumerate(KINDS)])
    return kept.select("doc_id", F.xxhash64("text").alias("h"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], covered.alias("covered"), seeds.alias("seeds"), candidates.alias("candidates"))


def leading(word: Column) -> Column:
    return F.length(F.regexp_extract(word, r"^[^\p{L}0-9+]*", 0))


def trimmed(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}0-9+]+", ""), r"[^\p{L}0-9]+$", "")


def behind(rows: DataFrame, patterns: DataFrame, most: int = 200_000, salts: int = 16) -> DataFrame:
    """rows (left, value, ...) with the patterns (left, ...) that they stand behind; a word may have most of the rows."""
    if patterns.count() <= most:
        return rows.join(F.broadcast(patterns), "left")
    dealt = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int")).join(dealt, ["left", "salt"]).drop("salt")


def patterns(found: DataFrame, rounds: int = 4, support: int = 5, confident: float = 0.5) -> DataFrame:
    """(left, kind): the patterns that the scored graph of patterns and instances accepts."""
    seeds = cut(found.select(F.explode("seeds").alias("x")).select("x.*").filter("left <> ''").distinct())
    others = cut(found.select(F.explode("candidates").alias("x")).select("x.left", "x.value").filter("left <> ''").distinct())
    sizes = cut(seeds.select("left").unionAll(others.select("left")).groupBy("left").agg((F.count("*") + 1).alias("n")))
    known = cut(seeds.groupBy("left", "kind").agg(F.count("*").cast("double").alias("weight"), F.count("*").alias("strong")))

    def scored(weights: DataFrame) -> DataFrame:
        return cut(weights.filter(F.col("strong") >= support).join(sizes, "left").select("left", "kind", (F.col("weight") / F.col("n")).alias("score")))

    scores = scored(known)
    for _ in range(rounds - 1):
        if scores.isEmpty():
            break
        instances = behind(others, scores).groupBy("value", "kind").agg(F.avg("score").alias("score"))
        gained = others.join(instances, "value").groupBy("left", "kind").agg(F.sum("score").alias("weight"), F.count_if(F.col("score") >= confident).alias("strong"))
        scores = scored(known.unionByName(gained).groupBy("left", "kind").agg(F.sum("weight").alias("weight"), F.sum("strong").alias("strong")))
    best = scores.filter(F.col("score") >= confident).groupBy("left").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    return cut(best)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, counts n_*, base: array of (start, kind, end), spans: base and found ones)."""
    found = cut(base_spans(docs, doc_id, text))
    accepted = patterns(found, **settings)
    candidates = found.select("doc_id", "h", F.explode("candidates").alias("x")).select("doc_id", "h", "x.left", "x.value", "x.start", "x.end")
    added = behind(candidates, accepted).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added")).select(F.col("doc_id").alias("added_id"), F.col("h").alias("added_h"), "added")
    both = found.join(added, F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("h") == F.col("added_h")), "left")
    spans = F.when(F.col("added").isNull(), F.col("covered")).otherwise(F.concat("covered", "added"))
    return both.select("doc_id", *[f"n_{k}" for k in KINDS], F.col("covered").alias("base"), spans.alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(KINDS, F.col("base")), 256).alias("base_sha256"), listed(KINDS, F.col("spans")).alias("spans"))


__all__ = ["KINDS", "PLACE", "REGEX", "base_spans", "find", "patterns", "query"]
