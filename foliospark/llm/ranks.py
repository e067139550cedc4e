"""Gapless numbers within groups of any size: no task has to hold a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 1024


def salted_rank(df: DataFrame, keys: list[str], order: list[str], name: str, salts: int = SALTS) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... within each group of equal (non-null) `keys`.

    Rows are dealt to `salts` parts of their group by a hash of `order`, numbered there in that order, and
    moved up by the counts of the parts before. The numbers depend only on the rows, so that a lost and
    repeated task gives the same ones (rows equal in `order` are interchangeable).
    """
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = d.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    d = d.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)))
    return d.join(sizes, [*keys, "_salt"]).withColumn(name, (F.col("_base") + F.col("_own") - 1).cast("long")).drop("_salt", "_base", "_own")
