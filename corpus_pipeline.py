"""A corpus pipeline of five stages; each works on all that the one before kept and returns the columns of
documents, the last one the packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontam, linededup, near, packing, quality
from foliospark.llm.queries import table, tokenizer
from foliospark.llm.shared import saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the counts or the line labels reject (a null text among them)."""
    return quality.filter_quality(docs, quality.fit_field(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier line; n_chars follows the text. Every document stays."""
    out = linededup.dedup_lines(docs)
    return out.select(*(F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return near.drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the contamination rule rejects."""
    found = decontam.find_benchmark(docs, table(spark, sf_dir, "benchmark"), keep=[c for c in docs.columns if c != "doc_id"])
    return found.where(~decontam.contaminated(F.col("n_hit"), F.col("n_words"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminate), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
