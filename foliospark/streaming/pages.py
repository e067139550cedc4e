"""The page functions over a stream of page tables. Without state; running counts are a watermark aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_pages(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def judged(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with quality columns; the same expressions as in batch."""
    t = F.col(text)
    return pages.withColumns({"alnum": T.alnum_fraction(t), "junk": T.junk_fraction(t), "usable": T.usable(t)})


def progress_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events in each window and key, closed when the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
