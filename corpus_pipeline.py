"""A corpus pipeline over `documents`: what each stage keeps is the next one's input.

The second stage decides by doc_id: rows of one doc_id stay or go together, and of rows equal in doc_id and text the least
one stays. Rows without a doc_id are never taken for copies. All other stages judge each row by its own text. Texts are
redacted before they are encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.llm import decontaminate, ngram_join, pieces, pii, quality
from postern.session import stage

#: Near copies: five-word shingles, similarity of 0.8 or more.
NGRAM, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the hard rules and lie near a language reference learned from these documents."""
    return quality.filtered(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id, with each different text it has once."""
    groups = ngram_join.link_groups(docs.select("doc_id", "text"), n=NGRAM, percent=PERCENT)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *rest)).alias("rest"))
    kept = kept.select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in rest])
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    # A hit is a fact about the text, so it is carried back by 128 bits of hash of the text.
    mark = ["_one", "_two"]
    marked = docs.withColumns({"_one": F.xxhash64("text"), "_two": F.xxhash64(F.lit(1), "text")})
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, hits = decontaminate.hits(marked.select("doc_id", "text", *mark), items, keep=mark)
    found = rows.join(hits.select("_row").distinct(), "_row", "left_semi").select(*mark).distinct()
    return marked.join(found, mark, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each personal span replaced by its kind; n_chars follows the new text."""
    found = pii.find(docs, pii.train(docs.select("doc_id", "text")))
    return found.withColumn("text", pii.redacted()).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    return pieces.encode(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_free),
    ("personal_data", personal_data),
    ("sentencepiece", token_ids),
]

#: Trained and language-model stages have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs)
    return docs
