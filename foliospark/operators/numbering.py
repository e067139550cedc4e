"""Numbers of pages in files of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..sources.kept import kept

c = F.col


def numbered(d: DataFrame, key: str, order: list[str], number: str = "page_no", total: str = "total") -> DataFrame:
    """Adds number (1, 2, ... in `order` within each value of `key`) and total (rows of that value).

    Rows are sorted by range into blocks, numbered within their block, and moved up by the rows of their key in earlier blocks
    (prefix sums over one row a block and key), so that no task holds a whole key. Every row gets a number, repeated rows and
    null keys or orders too; rows that are equal in key and order are numbered in any order.
    """
    # written, as both uses below must see the same blocks, which another run (or adaptive execution) would cut elsewhere
    d = kept(d.repartitionByRange(c(key), *(c(x) for x in order)).withColumn("_block", F.spark_partition_id()))
    n = d.groupBy("_block", key).agg(F.count(F.lit(1)).alias("_n"))
    of_key = Win.partitionBy(key)
    before = of_key.orderBy("_block").rowsBetween(Win.unboundedPreceding, -1)
    n = n.select(c("_block").alias("_b"), c(key).alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(of_key).alias("_total"))
    own = F.row_number().over(Win.partitionBy("_block", key).orderBy(*order))
    d = d.withColumn("_own", own).join(n, (c("_block") == c("_b")) & c(key).eqNullSafe(c("_k")))
    return d.withColumns({number: (c("_base") + c("_own")).cast("int"), total: c("_total").cast("int")}).drop("_block", "_b", "_k", "_base", "_total", "_own")
