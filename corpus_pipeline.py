"""A corpus pipeline of five operators; each stage takes (spark, docs, sf_dir) and works on all that the one before kept.

language: documents without a recognisable language go. lines: repeated and nearly repeated lines are taken out of the
texts, all documents stay. near_duplicates: one document of each SimHash component stays. benchmark: documents that hold a
benchmark window go. tokens: texts become piece ids, with a check that they decode to the text.

Defined cases: a null, empty or letterless text is rejected by language, so later stages meet none of it in run(); called by
themselves they keep a null text as null (tokens: null ids, n_ids 0). Texts of any length are worked whole. A document
whose lines all go stays with an empty text. near_duplicates takes null and empty
texts for copies of each other. Of ties in near_duplicates the smallest doc_id stays, null ids last, of rows
repeated whole one. Extra columns go through every stage but the last. No documents give no rows; an empty benchmark
drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syncproof.llm import decontaminate, langid, line_dedup, sentencepiece, simhash
from syncproof.llm.common import cut, table

#: No SQL can train or apply the first stage's network; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(docs, min_chars=line_dedup.MIN_CHARS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepiece.tokenize(docs, ["doc_id"])
    return encoded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "round_trip")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
