"""Queries over parts of measured size; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import values as V
from ..operators import measured as X
from .registry import docs, query

_MB = 0.05
_LIMIT = int(_MB * 1024 * 1024 * V.SIZE_MARGIN)
#: What a document's page uses: its own content, a font of its language, one of 37 pictures, and for some a letterhead.
OBJECTS = """select source, doc_id, concat('content ', cast(doc_id as string)) as name, cast(n_chars as bigint) as bytes from documents
union all select source, doc_id, concat('font ', lang), cast(9000 + 700 * length(lang) as bigint) from documents
union all select source, doc_id, concat('picture ', cast(doc_id % 37 as string)), cast(300 * (doc_id % 37) as bigint) from documents where doc_id % 3 = 0
union all select source, doc_id, 'letterhead', cast(6000 as bigint) from documents where doc_id % 5 < 2
union all select source, doc_id, 'letterhead', cast(5000 as bigint) from documents where doc_id % 5 = 1"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    objects = spark.sql(OBJECTS.replace("from documents", "from {d}"), d=d)
    return X.page_parts(d, objects, "source", "doc_id", most_mb=_MB)


_FOLD = f"""with recursive o as (select source, doc_id, name, max(bytes) as bytes from ({OBJECTS}) group by all),
p as (select source, doc_id, row_number() over (partition by source order by doc_id) as k, map_from_entries(list((name, bytes) order by name)) as m from o group by source, doc_id),
f as (
  select source, doc_id, k, 1 as part_no, map_keys(m) as own, {X.OVERHEAD} + list_sum(map_values(m)) as size, {X.OVERHEAD} + list_sum(map_values(m)) as alone from p where k = 1
  union all
  select source, doc_id, k, case when fits then part_no else part_no + 1 end, case when fits then list_distinct(list_concat(own, map_keys(m))) else map_keys(m) end, case when fits then size + more else {X.OVERHEAD} + list_sum(map_values(m)) end, {X.OVERHEAD} + list_sum(map_values(m))
  from (select *, size + more <= {_LIMIT} as fits from (select p.*, f.part_no, f.own, f.size, coalesce(list_sum(list_transform(list_filter(map_entries(p.m), lambda x: not list_contains(f.own, x.key)), lambda x: x.value)), 0) as more from f join p on p.source = f.source and p.k = f.k + 1)))"""


@query(_FOLD + f"""
select source, cast(part_no as int) as part_no, cast(min(k) as int) as first_page, cast(max(k) as int) as last_page, cast(max(size) as bigint) as n_bytes, cast(sum(alone) as bigint) as added, max(size) > {_LIMIT} as oversize from f group by source, part_no""")
def measured_parts(spark, sf_dir):
    return X.measured_parts(_placed(spark, sf_dir), "source", _MB)


@query(_FOLD + " select source, doc_id, cast(k as int) as page_no, cast(part_no as int) as part_no, cast(size as bigint) as grown, cast(alone as bigint) as alone from f")
def page_parts(spark, sf_dir):
    return _placed(spark, sf_dir)
