"""Queries over files and pages that fail; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly as X
from ..operators import failures as E
from ..operators import numbering as N
from ..operators import pages as P
from . import measured as Z
from .assembly import _SE, _TEXT
from .registry import c, docs, query

#: Fields of pages as text, some of them broken; files that can't be opened or have no pages.
RAW = f"""select source, doc_id, {_TEXT} as text, case when doc_id % 397 = 11 then 'n/a' when doc_id % 401 = 7 then null else cast(n_chars * case when doc_id % 2 = 0 then 10 else 40 end as string) end as ink,
  case when doc_id % 499 = 3 then '2,5' when doc_id % 4 = 1 then '2' else '0' end as regions, case when doc_id % 3 = 0 then 'true' else 'false' end as scan from documents"""
FILES = "select distinct source, cast(null as string) as error from documents union all select 'locked', 'cannot be opened' union all select 'blank', null union all select 'src1', null"


def raw_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = docs(spark, sf_dir)
    at = lambda sql: spark.sql(sql.replace("chr(57344)", "''").replace("from documents", "from {d}"), d=d)
    return at(FILES), E.read_fields(at(RAW), E.PAGE_FIELDS, ("ink",))


def _planned(spark, sf_dir):
    files, pages = raw_pages(spark, sf_dir)
    dense = P.density(F.coalesce("text", F.lit("")), c("ink"))
    needs = P.planned_for_ocr(c("text"), dense, P.page_class(c("text"), c("scan")))
    return E.plan(files, pages, "source", "doc_id", needs), pages


_TYPED = f"""rw as ({RAW}),
ty as (select source, doc_id, text, try_cast(ink as bigint) as ink, try_cast(regions as int) as regions, try_cast(scan as boolean) as scan, coalesce(case when ink is not null and try_cast(ink as bigint) is null then 'ink: ' || ink end, case when regions is not null and try_cast(regions as int) is null then 'regions: ' || regions end, case when ink is null then 'ink: missing' end) as error from rw)"""


def _plan_sql() -> str:
    from .registry import _SOLID, _STRIP, _USABLE

    dense = f"case when coalesce(ink, 0) <= 0 then 'inf' :: double else length({_SOLID.format('text')}) / ink * 1000.0 end"
    needs = f"case when not {_USABLE.format('text')} then true when length({_STRIP.format('text')}) > 600 then false when {dense} >= 45 then false else scan end"
    return f"""{_TYPED}, pn as (select source, count(*) as n, count_if({needs}) as ocr, count(error) as bad, arg_min('page ' || doc_id || ': ' || error, doc_id) filter (error is not null) as error from ty group by source),
pl0 as (select f.source, coalesce(own, pn.error) as error, coalesce(n, 0) as n, coalesce(ocr, 0) as ocr, coalesce(bad, 0) as bad from (select source, min(error) as own from ({FILES}) group by source) f left join pn using (source)),
pl1 as (select source, case when error is null then n else greatest(n, 1) end as pages, case when error is null then ocr else greatest(n, 1) end as ocr_pages, bad as failed_pages, error from pl0),
pl as (select source, pages, ocr_pages, cast(pages * 1.8 + ocr_pages * 2.6 as double) as units, failed_pages, error from pl1)"""


@query("with " + _plan_sql() + " select source, pages, ocr_pages, round(units, 6) as units, failed_pages, error from pl")
def tolerant_plan(spark, sf_dir):
    return _planned(spark, sf_dir)[0].withColumn("units", F.round("units", 6))


@query(f"with {_TYPED} select source, doc_id, error from ty where error is not null or doc_id % 50 = 9")
def gated_pages(spark, sf_dir):
    _, pages = raw_pages(spark, sf_dir)
    grid = pages.where("doc_id % 50 = 9").select("source", "doc_id")
    return E.gated(pages, grid, ["source", "doc_id"]).join(pages.select("source", "doc_id", "error"), ["source", "doc_id"])


@query(_SE + _plan_sql() + f""", np as (select source, count(distinct part_no) as parts from f group by source)
select source, case when error is not null then 'failed' when coalesce(parts, 0) = 0 then 'empty' else 'done' end as status, error, pages, ocr_pages, round(units, 6) as units, failed_pages, case when error is null then coalesce(parts, 0) else 0 end as parts from pl left join np using (source)""")
def file_outcomes(spark, sf_dir):
    """From raw pages to documents, with files that fail on the way."""
    planned, pages = _planned(spark, sf_dir)
    p = N.numbered(pages.withColumns({"large_image": F.lit(False), "regions": F.coalesce("regions", F.lit(0)), "scan": F.coalesce("scan", F.lit(False))}).drop("error"), "source", ["doc_id"])
    none = spark.createDataFrame([], "source string, page_no int, region int, word_ix int, text string, conf string")
    tables = spark.createDataFrame([], "source string, page_no int, zone int, markdown string")
    done = X.documents(X.sections(p, X.page_info(X.decided(p), none, "source"), tables, "source"), Z._placed(spark, sf_dir).select("source", "page_no", "part_no"), "source")
    return E.outcome(planned, done, "source").withColumn("units", F.round("units", 6))
