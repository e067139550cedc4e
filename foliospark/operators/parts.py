"""Size-bounded parts, work plans, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import values as V

c = F.col


def split_by_size(pages: DataFrame, key: str, order: str, size: str, most_mb: float = V.MOST_MB) -> DataFrame:
    """(key, part_no, first_page, last_page, n_bytes, oversize): pages in order, each part as long as it fits.

    A page that is too large is a part of its own. Sizes add up here. Without a limit, or where all fits, there is
    one part. One file's page sizes are folded in one row."""
    limit = int(max(most_mb, 0) * 1024 * 1024 * V.SIZE_MARGIN)
    f = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(c(order).alias("o"), c(size).cast("bigint").alias("b")))).alias("p"))
    part = "array<struct<first:int,last:int,bytes:bigint>>"

    def step(acc, p):
        last = F.try_element_at(acc, F.lit(-1))
        n = F.coalesce(last["last"], F.lit(0)) + 1
        fits = F.coalesce((last["bytes"] + p["b"] <= limit), F.lit(False)) if limit else F.size(acc) > 0
        grown = F.struct(last["first"].alias("first"), n.alias("last"), (last["bytes"] + p["b"]).alias("bytes"))
        new = F.struct(n.alias("first"), n.alias("last"), p["b"].alias("bytes"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    f = f.select(key, F.posexplode(F.aggregate("p", F.array().cast(part), step)).alias("i", "e"))
    return f.select(key, (c("i") + 1).alias("part_no"), c("e.first").alias("first_page"), c("e.last").alias("last_page"), c("e.bytes").alias("n_bytes"), ((c("e.bytes") > limit) if limit else F.lit(False)).alias("oversize"))


def work_units(pages: Column, ocr_pages: Column, with_ocr: bool = True) -> Column:
    w = V.WEIGHTS
    return pages * (w["clean"] + w["number"] + w["export"] + w["split"]) + (ocr_pages * w["ocr"] if with_ocr else 0.0)


def work_plan(pages: DataFrame, key: str, needs_ocr: Column) -> DataFrame:
    """(key, pages, ocr_pages, units, base): work of each file, and of those before it."""
    d = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.count_if(needs_ocr).alias("ocr_pages"))
    d = d.withColumn("units", work_units(c("pages"), c("ocr_pages")))
    return d.withColumn("base", F.coalesce(F.sum("units").over(Win.orderBy(key).rowsBetween(Win.unboundedPreceding, -1)), F.lit(0.0)))


def smoothed(events: DataFrame, key: str, order: list[str], value: str, weight: float = 0.3) -> DataFrame:
    """(key, n, ema): exponential smoothing of a key's values in order, the first value as start."""
    g = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, c(value).alias("_v")))).alias("e"))
    fold = F.aggregate("e", F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x["_v"]).otherwise(weight * x["_v"] + (1 - weight) * a))
    return g.select(key, F.size("e").alias("n"), fold.alias("ema"))


def percent(events: DataFrame, key: str, order: list[str], done: Column, total: Column) -> DataFrame:
    """Events with a percentage that never falls and stays at 99 at most."""
    now = F.when(total > 0, F.least(F.lit(99.0), done / total * 100.0).cast("int")).otherwise(0)
    return events.withColumn("percent", F.max(now).over(Win.partitionBy(key).orderBy(*order).rowsBetween(Win.unboundedPreceding, 0)))


def throttled(events: DataFrame, key: str, order: list[str], seconds: Column, gap: float = 0.1) -> DataFrame:
    """(key, emitted): how many events come at least `gap` seconds after the last one that was emitted."""
    g = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(seconds.alias("t"), *order))).alias("e"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("n"))

    def step(a, x):
        out = a["last"].isNull() | (x["t"] - a["last"] >= gap)
        return F.struct(F.when(out, x["t"]).otherwise(a["last"]).alias("last"), F.when(out, a["n"] + 1).otherwise(a["n"]).alias("n"))

    return g.select(key, F.aggregate("e", start, step)["n"].alias("emitted"))
