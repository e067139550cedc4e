"""Audits, regression checks and before/after gates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import values as V

c = F.col


def by_reason(judged: DataFrame) -> DataFrame:
    """(reason, pages, elements, chars, area): what each reason takes; pages are those with text or an area of note."""
    d = judged.where("reason is not null").groupBy("file_id", "page_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(c("kind") == "T", c("n_chars")).otherwise(0)).alias("chars"), F.sum(F.when(G.image, G.area_fraction()).otherwise(0.0)).alias("area"))
    noted = (c("chars") > 0) | (c("area") >= 0.01)
    return d.groupBy("reason").agg(F.count_if(noted).alias("pages"), F.sum("n").alias("elements"), F.sum("chars").alias("chars"), F.sum("area").alias("area"))


def ranked(audit: DataFrame) -> DataFrame:
    """Reasons by weight, an area of one page counting as 1000 characters; a row for each reason, a handful."""
    return audit.withColumn("weight", c("chars") + 1000 * c("area")).withColumn("place", F.row_number().over(Win.orderBy(F.desc("weight"), "reason")))


def top_snippets(judged: DataFrame, most: int = 120, width: int = 160) -> DataFrame:
    """The first snippets of each reason, in page order."""
    w = Win.partitionBy("reason").orderBy("file_id", "page_id", "el_ix")
    d = judged.where("reason is not null and kind = 'T' and n_chars > 0").withColumn("place", F.row_number().over(w)).where(c("place") <= most)
    return d.select("reason", "place", "file_id", "page_id", F.substring("txt", 1, width).alias("snippet"))


def normal_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: T.strip(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


def lost_lines(before: DataFrame, after: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line): lines that are gone, with their number of times; order isn't looked at (a multiset difference)."""
    lines = lambda d: d.select(key, F.explode(normal_lines(c(text))).alias("line"))
    return lines(before).exceptAll(lines(after))


#: Texts whose lines are Python objects at one time.
DIFF_ROWS = 64


def _diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from difflib import SequenceMatcher

    for batch in batches:
        for at in range(0, batch.num_rows, DIFF_ROWS):
            b = batch.slice(at, DIFF_ROWS)
            out = []
            for a, z in zip(b.column("a"), b.column("z")):
                a, z = a.as_py() or [], z.as_py() or []
                out.append([x for op, i, j, _, _ in SequenceMatcher(None, a, z, autojunk=False).get_opcodes() if op in ("delete", "replace") for x in a[i:j]])
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(out, pa.list_(pa.string()))], names=["_k", "lost"])


def lost_lines_in_order(before: DataFrame, after: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lost): the lines that an ordered comparison says were deleted or replaced."""
    d = before.select(c(key).alias("_k"), normal_lines(c(text)).alias("a")).join(after.select(c(key).alias("_k"), normal_lines(c(text)).alias("z")), "_k", "left")
    d = d.withColumn("z", F.coalesce("z", F.array().cast("array<string>")))
    return d.mapInArrow(_diff, f"_k {d.schema['_k'].dataType.simpleString()}, lost array<string>").withColumnRenamed("_k", key)


def retention(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, ratio, coverage, note): how much of the characters and words stayed."""
    d = before.select(key, c("text").alias("a")).join(after.select(key, c("text").alias("z")), key)
    d = d.withColumns({"ca": F.length("a"), "cz": F.length("z"), "pa": T.plain_words(c("a")), "pz": T.plain_words(c("z"))})
    d = d.withColumns({"ratio": F.expr("try_divide(cz, ca)"), "coverage": F.when(F.size("pa") > 0, F.size(F.array_intersect("pa", "pz")) / F.size("pa"))})
    gone, half, kept = V.NOTES
    first = F.when((c("ca") >= V.TEXT_LEAST) & (c("cz") < V.TEXT_LEAST), gone).when(c("ratio") < 0.5, half)
    note = F.concat_ws("; ", first, F.when(c("coverage") >= 0.8, kept))
    return d.select(key, "ratio", "coverage", F.when(note == "", "-").otherwise(note).alias("note"))


def words_missing(rows: DataFrame, key: str, a: str, z: str) -> DataFrame:
    """(key, word, n): words of array a that array z lacks, with how often a has them."""
    own = rows.select(key, F.explode(a).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return own.join(rows.select(key, F.explode(z).alias("word")).distinct(), [key, "word"], "left_anti")


def gate(pairs: DataFrame, least: float = 0.999, conf_drop: float = 0.5) -> DataFrame:
    """One row: totals before and after and the verdict. pairs: (chars_a, chars_z, conf_a, conf_z, diff)."""
    d = pairs.agg(F.sum("chars_a").alias("chars_a"), F.sum("chars_z").alias("chars_z"), F.avg("conf_a").alias("conf_a"), F.avg("conf_z").alias("conf_z"), F.count_if(c("diff") > 0).alias("pages_differ"))
    return d.withColumn("passed", (c("chars_z") >= least * c("chars_a")) & (c("conf_z") >= c("conf_a") - conf_drop))


def compare(base: DataFrame, now: DataFrame, tol: float = 0.001) -> DataFrame:
    """(file, page, verdict): a frame element must stay removed, and neither ink nor text may shrink; more is no failure.
    Both: (file_id, page_id, removed array, ink, chars); now also has `present`, the keys still there."""
    d = base.select("file_id", "page_id", "removed", c("ink").alias("ink_a"), c("chars").alias("chars_a")).join(now.select("file_id", "page_id", "present", c("ink").alias("ink_z"), c("chars").alias("chars_z")), ["file_id", "page_id"], "full")
    back = F.size(F.array_intersect("removed", "present"))
    verdict = F.when(c("chars_a").isNull(), "new").when(c("chars_z").isNull(), "missing").when(back > 0, "reappeared").when(c("ink_z") < c("ink_a") - tol, "ink").when(c("chars_z") < c("chars_a"), "chars").when(c("chars_z") > c("chars_a"), "better").otherwise("same")
    return d.select("file_id", "page_id", verdict.alias("verdict"))


def changed(base: DataFrame, now: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose value differs, nulls being a value."""
    d = base.select(*keys, c(value).alias("before")).join(now.select(*keys, c(value).alias("after")), keys, "left")
    return d.where(~c("before").eqNullSafe(c("after")))


def even_sample(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Every step-th row, k at most, with step = max(1, n // k)."""
    n = rows.count()
    step = max(1, n // k)
    d = rows.withColumn("_rn", F.row_number().over(Win.orderBy(order)) - 1)
    return d.where((c("_rn") % step == 0) & (c("_rn") / step < k)).drop("_rn")
