"""Inputs of the regression baseline, and frames that come back.

A baseline holds, for each page, the keys of the elements that calibrated rules took away. A key may be there several times. In a
cleaned file none of them may be found again; a file that is gone is a failure of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import values as V
from .boilerplate import PAGE

c = F.col


def frame_keys(judged: DataFrame) -> DataFrame:
    """(file_id, page_id, key, n): what calibrated rules took, with how often. Boxes of nothing (all zeros) are no frames."""
    seen = (c("x0") != 0) | (c("y0") != 0) | (c("x1") != 0) | (c("y1") != 0)
    d = judged.where(c("reason").isin(*V.FRAME_REASONS) & seen)
    return d.groupBy(*PAGE, G.box_key().alias("key")).agg(F.count(F.lit(1)).alias("n"))


def baseline(keys: DataFrame) -> DataFrame:
    """(file_id, page_id, removed): each page's keys in order, repeats included; as it is stored."""
    all_ = F.flatten(F.collect_list(F.array_repeat("key", c("n").cast("int"))))
    return keys.groupBy(*PAGE).agg(F.sort_array(all_).alias("removed"))


def stored_keys(stored: DataFrame) -> DataFrame:
    """frame_keys of a stored baseline."""
    return stored.select(*PAGE, F.explode("removed").alias("key")).groupBy(*PAGE, "key").agg(F.count(F.lit(1)).alias("n"))


def present_keys(elements: DataFrame) -> DataFrame:
    """(file_id, page_id, key) of all elements of a cleaned file."""
    return elements.where("kind is not null").select(*PAGE, G.box_key().alias("key")).distinct()


def failures(keys: DataFrame, present: DataFrame) -> DataFrame:
    """(file_id, page_id, key, n, verdict): frames that are there again, each as often as the baseline has it, and files of the baseline
    that are gone, with a null page and key and the number of frames that nobody could look for."""
    files = present.select(c("file_id").alias("_f")).distinct()
    there = keys.join(files, keys["file_id"] == files["_f"], "left_semi")
    back = there.join(present, [*PAGE, "key"], "left_semi").select(*PAGE, "key", "n", F.lit("reappeared").alias("verdict"))
    gone = keys.join(files, keys["file_id"] == files["_f"], "left_anti").groupBy("file_id").agg(F.sum("n").alias("n"))
    kind = {k: keys.schema[k].dataType for k in ("page_id", "key")}
    return back.unionByName(gone.select("file_id", F.lit(None).cast(kind["page_id"]).alias("page_id"), F.lit(None).cast(kind["key"]).alias("key"), "n", F.lit("missing").alias("verdict")))
