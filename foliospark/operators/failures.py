"""Files and pages that fail go on as rows: what is wrong stands in `error`, and the plan, the gate and the export go by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parts import work_units

c = F.col


def read_fields(raw: DataFrame, kinds: dict[str, str], needed: tuple[str, ...] = ()) -> DataFrame:
    """Fields that came as text, as the kinds asked for. A text that isn't of its kind, or a needed field that is missing, gives null
    and an error that names the first such field; the row stays."""
    typed = {k: F.expr(f"try_cast(`{k}` as {t})") for k, t in kinds.items()}
    wrong = [F.when(c(k).isNotNull() & typed[k].isNull(), F.concat(F.lit(f"{k}: "), c(k))) for k in kinds]
    missing = [F.when(c(k).isNull(), F.lit(f"{k}: missing")) for k in needed]
    return raw.withColumn("error", F.coalesce(*wrong, *missing, F.lit(None).cast("string"))).withColumns(typed)


def plan(files: DataFrame, pages: DataFrame, file: str, order: str, needs_ocr: Column, with_ocr: bool = True) -> DataFrame:
    """(file, pages, ocr_pages, units, failed_pages, error): work of every file in the list, those that fail too.

    files: file and error (null where it could be opened); pages: file, order, error and what needs_ocr reads. A file with an error of
    its own or of a page (its first in order stands for it) is planned as if all its pages were to be recognised, with one
    page at least. A file that opens and has no pages needs no work. Files that are listed repeatedly count once."""
    f = files.groupBy(file).agg(F.min("error").alias("_own"))
    p = pages.groupBy(c(file).alias("_f")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce(needs_ocr, F.lit(True))).alias("_ocr"), F.count("error").alias("_bad"),
        F.min_by(F.when(c("error").isNotNull(), F.struct(c(order).alias("page"), "error")), F.when(c("error").isNotNull(), F.struct(c(order), "error"))).alias("_first"),
    )
    d = f.join(p, f[file].eqNullSafe(p["_f"]), "left")
    error = F.coalesce("_own", F.concat(F.lit("page "), F.coalesce(c("_first.page").cast("string"), F.lit("?")), F.lit(": "), c("_first.error")))
    n = F.coalesce("_n", F.lit(0))
    d = d.withColumn("error", error).withColumn("pages", F.when(error.isNotNull(), F.greatest(n, F.lit(1))).otherwise(n))
    d = d.withColumn("ocr_pages", F.when(c("error").isNotNull(), c("pages")).otherwise(F.coalesce("_ocr", F.lit(0))))
    return d.select(file, "pages", "ocr_pages", work_units(c("pages"), c("ocr_pages"), with_ocr).alias("units"), F.coalesce("_bad", F.lit(0)).alias("failed_pages"), "error")


def gated(pages: DataFrame, grid: DataFrame, key: list[str]) -> DataFrame:
    """Pages worth a closer look: those in `grid`, and those with an error, as nothing is known of them."""
    bad = pages.where("error is not null").select(*key)
    return bad.unionByName(pages.where("error is null").select(*key).join(grid.select(*key).distinct(), key, "left_semi"))


def exported(done: DataFrame, planned: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """Documents of the files without an error, and (file, error) of the others: a failed file is told, and nothing of it is written."""
    ok = planned.where("error is null").select(c(file).alias("_f"))
    return done.join(ok, done[file].eqNullSafe(ok["_f"]), "left_semi"), planned.where("error is not null").select(file, "error")


def outcome(planned: DataFrame, documents: DataFrame, file: str) -> DataFrame:
    """(file, status, error, pages, ocr_pages, units, failed_pages, parts): one row a file; status is done, failed or empty."""
    written, _ = exported(documents, planned, file)
    n = written.groupBy(c(file).alias("_f")).agg(F.count(F.lit(1)).alias("_parts"))
    d = planned.join(n, planned[file].eqNullSafe(n["_f"]), "left").withColumn("parts", F.coalesce("_parts", F.lit(0)))
    status = F.when(c("error").isNotNull(), "failed").when(c("parts") == 0, "empty").otherwise("done")
    return d.select(file, status.alias("status"), "error", "pages", "ocr_pages", "units", "failed_pages", "parts")


#: What a page's fields have to be.
PAGE_FIELDS = {"ink": "bigint", "regions": "int", "scan": "boolean"}
