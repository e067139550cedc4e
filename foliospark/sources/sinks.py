"""Sinks: tables, JSON baselines, Markdown text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str) -> None:
    """All or nothing, as the committer moves finished files only."""
    df.write.mode("overwrite").parquet(path)


def write_baseline(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_markdown(documents: DataFrame, path: str, key: str = "file_id") -> None:
    """A folder for each key with its Markdown as text."""
    documents.select(key, "markdown").write.mode("overwrite").partitionBy(key).text(path, lineSep="\0")
