"""Secret scan: pattern matches with checks, and multipart credential linking by an interval join, all in native Columns.

Base matches (assign, access, hex) are reported as they are. Weak candidates are reported only where complementary parts of a
credential stand within `scope` code points of each other in a document: an identifier (user, login, client id, access
key) and an unlabelled secret (16 characters or more of mixed letters and digits) confirm each other, base matches
counting as parts too, and an endpoint (url or host with port) is reported where both others are near.

The interval join meets parts by (document, scope bucket): per bucket and side the first and last of the starts and of the
ends that lie in it are kept, and each weak part meets the buckets from one before its start to one after its end. That is
enough to tell exactly whether a part ends or starts within the scope. An identifier and a secret must not overlap to
confirm each other; an endpoint may hold or cross its parts, but is not found within one.

Defined cases: null text counts as empty; a document without matches has empty strings and zero counts; rows repeated with
id and text are judged alike; spans of unlike kinds at one place all stay; a text's work grows with its length times the logarithm
of its matches; extra columns do not enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syncproof.llm.common import cut, table
from syncproof.llm.spans import as_spans, clear_of, listed, places

BASE = ["assign", "access", "hex"]
WEAK = ["identifier", "secret", "endpoint"]
REGEX = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]{24,}+",
    "identifier": r"""(?<![A-Za-z0-9_])(?i:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20{0,3}[:=]\x20{0,3}["']?[A-Za-z0-9._@-]{3,}+""",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+",
    "endpoint": r"""(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]++|(?<![A-Za-z0-9.-])[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5}(?![0-9])""",
}
NEEDS = {"endpoint": ":", "access": "AKIA"}
VALUE = r"""^.*?[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: The side of a credential that each kind stands for: 0 identifier, 1 secret, 2 endpoint.
SIDE = [1, 0, 1, 0, 1, 2]


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h: hash of the text, n_*, base spans, weak spans)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    where = lambda k: F.when(F.contains("text", F.lit(NEEDS[k])), F.col("text")).otherwise("") if k in NEEDS else F.col("text")
    tried = rows.withColumns({k: places(where(k), REGEX[k]) for k in (*BASE, *WEAK)})
    valid = tried.withColumns({
        "assign": F.filter("assign", lambda x: F.length(F.regexp_extract(x["hit"], VALUE, 1)) >= 6),
        "access": F.filter("access", lambda x: F.length(x["hit"]) >= 20),
    })
    base = F.concat(*[as_spans(F.col(k), i) for i, k in enumerate(BASE)])
    weak = F.concat(*[as_spans(clear_of(F.col(k), *[F.col(b) for b in BASE]), len(BASE) + i) for i, k in enumerate(WEAK)])
    return valid.select("doc_id", F.xxhash64("text").alias("h"), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], base.alias("base"), weak.alias("weak"))


def linked(found: DataFrame, scope: int = 200) -> DataFrame:
    """(doc_id, h, added): the weak spans whose complements stand within the scope."""
    sides = F.array(*[F.lit(s) for s in SIDE])
    has_weak = found.filter("size(weak) > 0").select("doc_id", "h", "base", "weak").dropDuplicates(["doc_id", "h"])
    every = cut(has_weak.select("doc_id", "h", F.explode(F.concat("base", "weak")).alias("x")).select("doc_id", "h", "x.start", "x.kind", "x.end", F.get(sides, F.col("x.kind")).alias("side")))
    bucket = lambda c: F.floor(F.col(c) / scope).cast("long")
    ends = every.filter("side < 2").select("doc_id", "h", "side", F.explode(F.array(*[F.struct(bucket(c).alias("bucket"), *[(F.col(c) if c == d else F.lit(None).cast("int")).alias(d) for d in ("start", "end")]) for c in ("start", "end")])).alias("x")).select("doc_id", "h", "side", "x.*")
    held = ends.groupBy(F.col("doc_id").alias("held_id"), F.col("h").alias("held_h"), F.col("bucket").alias("held_bucket")).agg(*[getattr(F, f)(F.when(F.col("side") == s, F.col(c))).alias(f"{f}_{c}_{s}") for s in (0, 1) for f in ("min", "max") for c in ("start", "end")])
    weak = every.filter(F.col("kind") >= len(BASE)).withColumns({"lo": bucket("start"), "hi": bucket("end")}).withColumn("near_bucket", F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)))
    met = weak.join(held, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("h") == F.col("held_h")) & (F.col("near_bucket") == F.col("held_bucket")))
    at = F.col("near_bucket")

    def near(s: int) -> Column:
        """A part of the side ends at most the scope before, or starts at most the scope after; endpoints may also hold it."""
        before = (at == F.col("lo")) & (F.col(f"min_end_{s}") <= F.col("start")) | (at == F.col("lo") - 1) & (F.col(f"max_end_{s}") >= F.col("start") - scope)
        after = (at == F.col("hi")) & (F.col(f"max_start_{s}") >= F.col("end")) | (at == F.col("hi") + 1) & (F.col(f"min_start_{s}") <= F.col("end") + scope)
        starts_in = (at == F.col("lo")) & (F.col(f"max_start_{s}") >= F.col("start")) | (at > F.col("lo")) & (at <= F.col("hi")) & F.col(f"max_start_{s}").isNotNull()
        ends_in = (at == F.col("hi")) & (F.col(f"min_end_{s}") <= F.col("end")) | (at >= F.col("lo")) & (at < F.col("hi")) & F.col(f"min_end_{s}").isNotNull()
        held = (F.col("side") == 2) & (F.coalesce(starts_in, F.lit(False)) | F.coalesce(ends_in, F.lit(False)))
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)) | held

    seen = met.groupBy("doc_id", "h", "start", "kind", "end", "side").agg(*[F.bool_or(near(s)).alias(f"near_{s}") for s in (0, 1)])
    complete = seen.filter(F.when(F.col("side") == 0, F.col("near_1")).when(F.col("side") == 1, F.col("near_0")).otherwise(F.col("near_0") & F.col("near_1")))
    return complete.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 200) -> DataFrame:
    """(doc_id, counts n_*, base: array of (start, kind, end), spans: base and linked ones)."""
    found = cut(parts(docs, doc_id, text))
    added = linked(found, scope).select(F.col("doc_id").alias("added_id"), F.col("h").alias("added_h"), "added")
    both = found.join(added, F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("h") == F.col("added_h")), "left")
    return both.select("doc_id", *[f"n_{k}" for k in BASE], "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [*BASE, *WEAK]
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(listed(kinds, F.col("base")), 256).alias("base_sha256"), listed(kinds, F.col("spans")).alias("spans"))
