"""URL filters: host-suffix and path-prefix expressions meet rule keys by short hash prefixes, then by full digests.

A rule is (host, path, verdict): it fits its host and all subdomains where the url's path starts with the rule's path.
Of the fitting rules the longest (host and path together) wins; of equal ones `block` wins.

Every distinct url is expanded into (host suffix, directory prefix) expressions; a rule's key is its host with its path up
to the last slash. The equi-join is on the first four bytes of the SHA-256 of such an expression; the full digest and
the rest of the rule's path are then confirmed. Expressions are made distinct before the join, so a common host costs
one row, and none has more labels or slashes than some rule has, so that a url of many slashes costs its length, not its
square; rules and judged urls are broadcast only up to a counted bound, else both sides are shuffled. Null urls are not joined.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and gets the default verdict;
repeated urls and pages each keep their row; urls of any length are judged whole; a rule of null host or path is ignored; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syncproof.llm.common import ascii_lower, cut, table
from syncproof.llm.linking import bounded

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, most: int) -> Column:
    """The host's suffixes of whole labels, up to so many labels."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))


def directories(path: Column, most: int) -> Column:
    """The path's prefixes that end in a slash, up to so many slashes, and the empty one."""
    parts = F.split(path, "/", most + 2)
    return F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(most))), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


def digest(host: Column, directory: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), directory), 256))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_broadcast_rules: int = 200_000, max_broadcast_urls: int = 200_000) -> DataFrame:
    """(page struct, host, path, rule, verdict). rules: (host, path, verdict)."""
    keyed = rules.filter("host is not null and path is not null").select(
        ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).withColumn("full", digest(F.col("rule_host"), F.regexp_extract("rule_path", r"(?s)^(?:.*/)?", 0))).withColumn("short", F.substring("full", 1, 4))
    n_rules, labels, slashes = keyed.agg(F.count("*"), F.max(F.size(F.split("rule_host", r"\.", -1))), F.max(F.size(F.split("rule_path", "/", -1)) - 1)).first()
    if n_rules <= max_broadcast_rules:
        keyed = F.broadcast(keyed)

    urls = pages.select(F.col(f"`{url}`").alias("url")).filter("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''")
    expanded = urls.select("url", "path", F.explode(host_suffixes(F.col("host"), labels or 1)).alias("suffix"), directories(F.col("path"), slashes or 0).alias("dirs")).select("url", "path", "suffix", F.explode("dirs").alias("directory"))
    hits = (
        expanded.withColumn("digest", digest(F.col("suffix"), F.col("directory")))
        .join(keyed, F.substring("digest", 1, 4) == F.col("short"))
        .filter((F.col("digest") == F.col("full")) & F.col("path").startswith(F.col("rule_path")))
    )
    precedence = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), (F.col("rule_verdict") == "block").alias("blocks"), F.length("rule_host").alias("h"), "rule_host", "rule_path")
    best = hits.groupBy("url").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), precedence).alias("won"))
    pages = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"))
    at = F.col(f"page.`{url}`")
    best = cut(best)  # urls that a rule fits; beyond the bound a plain shuffle, of which a frequent url's share can be split
    met = pages.filter(at.isNotNull()).join(bounded(best, max_broadcast_urls), at == F.col("url"), "left")
    none = pages.filter(at.isNull()).select("page", *[F.lit(None).cast(best.schema[c].dataType).alias(c) for c in ("url", "won")])
    return met.select("page", "url", "won").unionByName(none).select("page", host_of(at).alias("host"), path_of(at).alias("path"), F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page.page_id", "host", "path", "rule", "verdict")


SQL = r"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
r(h, q, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
select page_id, host, path, (select h || q from r where (host = h or host like '%.' || h) and starts_with(path, q) order by length(h || q) desc limit 1) "rule",
  coalesce((select v from r where (host = h or host like '%.' || h) and starts_with(path, q) order by length(h || q) desc limit 1), 'allow') verdict
from p
"""
