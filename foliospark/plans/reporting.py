"""The audit report of the letters; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boilerplate as B
from ..operators import reporting as X
from ..operators import verdict as D
from ..sources.kept import kept
from .letters import _GIVEN, letters
from .registry import c, query
from .vehicles import sql


def _fixed(x: str, digits: int) -> str:
    n = f"cast(round_even(({x}) * {10**digits}.0, 0) as bigint)"
    return f"(cast({n} // {10**digits} as varchar) || '.' || lpad(cast({n} % {10**digits} as varchar), {digits}, '0'))"


_SECTIONS = f"""
hd as (select file_id, concat('file ', file_id) as name, count(distinct page_id) as pages, cast(sum(case when kind = 'T' then n_chars else 0 end) as bigint) as chars from el group by file_id),
lo as (select file_id, page_id, reason, sum(case when kind = 'T' then n_chars else 0 end) as chars, sum(case when kind = 'I' then greatest(0.0, (x1-x0)*(y1-y0)) / (595*842) else 0.0 end) as area, count_if(kind = 'T' and n_chars > 0) as n_texts, grouping(page_id) as whole from judged where reason is not null group by grouping sets ((file_id, page_id, reason), (file_id, reason))),
pc as (select file_id, page_id, sum(n_chars) as page_chars from el where kind = 'T' group by all),
pg as (select lo.*, coalesce(page_chars, 0) as page_chars from lo left join pc using (file_id, page_id) where whole = 0),
nt as (select * from pg where chars > 0 or area >= 0.01),
ps as (select file_id, reason, count(*) as n, string_agg(cast(page_id as varchar), ', ' order by page_id) filter (k <= 20) as p from (select *, row_number() over (partition by file_id, reason order by page_id) as k from nt) group by all),
tt as (select lo.*, hd.chars as doc_chars, coalesce(p, '') || case when n > 20 then ' ...' else '' end as told, row_number() over (partition by lo.file_id order by lo.chars + 1000 * area desc, lo.reason) as place from lo join hd using (file_id) left join ps using (file_id, reason) where whole = 1),
xl as (select file_id, page_id, txt as line from judged where kind = 'T' and reason is not null and n_chars > 0),
ln as (select file_id, page_id, count(*) as n from xl group by all),
rp as (
  select file_id, 0 as section, 0 as k1, 0 as k2, 0 as k3, concat('# Relatório de auditoria', chr(10), chr(10), '**Arquivo:** `', name, '` · **Páginas:** ', pages, chr(10)) as line from hd
  union all select file_id, 1, 0, 0, 0, concat('## 1. Ranking global — perda por motivo', chr(10), chr(10), '| motivo | chars removidos | % do texto | área (págs equiv.) | páginas |', chr(10), '| --- | ---: | ---: | ---: | --- |') from hd
  union all select file_id, 1, place, 0, 0, concat('| ', concat_ws(' | ', concat('`', reason, '`'), chars, concat({_fixed('chars / greatest(doc_chars, 1) * 100.0', 2)}, '%'), {_fixed('area', 2)}, told), ' |') from tt
  union all select file_id, 2, 0, 0, 0, concat(chr(10), '## 2. Perda por página e por motivo', chr(10), chr(10), '| pág | chars da pág | motivo | chars removidos | % da pág | área |', chr(10), '| ---: | ---: | --- | ---: | ---: | ---: |') from hd
  union all select file_id, 2, 1, page_id, row_number() over (partition by file_id, page_id order by chars desc, reason), concat('| ', concat_ws(' | ', page_id, page_chars, concat('`', reason, '`'), chars, concat({_fixed('chars / greatest(page_chars, 1) * 100.0', 1)}, '%'), concat({_fixed('area * 100.0', 1)}, '%')), ' |') from nt
  union all select file_id, 3, 0, 0, 0, concat(chr(10), '## 3. Texto efetivamente removido, por motivo') from hd
  union all select file_id, 3, place, 0, 0, concat(chr(10), '### Motivo `', reason, '` — ', n_texts, ' linha(s) removida(s)', chr(10)) from tt where n_texts > 0
  union all select file_id, 3, place, k, 0, concat('- (pág ', page_id, ') `', substring(txt, 1, 160), '`') from (select j.*, place, row_number() over (partition by j.file_id, j.reason order by j.page_id, j.el_ix) as k from judged j join tt on tt.file_id = j.file_id and tt.reason = j.reason where kind = 'T' and j.n_chars > 0) where k <= 120
  union all select file_id, 3, place, 121, 0, concat('- ... e mais ', n_texts - 120, ' linha(s)') from tt where n_texts > 120
  union all select file_id, 4, 0, 0, 0, concat(chr(10), '## 4. Linhas do original que não aparecem no limpo', chr(10), chr(10), case when t.n is null then 'Nenhuma linha perdida.' else concat(t.n, ' linha(s).') end) from hd left join (select file_id, cast(sum(n) as bigint) as n from ln group by all) t using (file_id)
  union all select file_id, 4, 1, page_id, 0, concat(chr(10), '### Página ', page_id, ' — ', n, ' linha(s) perdida(s)', chr(10)) from ln
  union all select file_id, 4, 1, page_id, k, concat('- `', substring(line, 1, 160), '`') from (select *, row_number() over (partition by file_id, page_id order by line) as k from xl) where k <= 80
  union all select file_id, 4, 1, page_id, 81, concat('- ... e mais ', n - 80) from ln where n > 80
  union all select file_id, 5, 0, 0, 0, concat(chr(10), '## 5. Cortes de régua por página', chr(10), chr(10), '| pág | cut_topo (pt) | cut_topo/H | cut_base (pt) | cut_base/H |', chr(10), '| ---: | ---: | ---: | ---: | ---: |') from hd
  union all select file_id, 5, 1, page_id, 0, concat('| ', concat_ws(' | ', page_id, coalesce({_fixed('cut_top', 1)}, '—'), coalesce({_fixed('cut_top / 842.0', 3)}, '—'), coalesce({_fixed('cut_base', 1)}, '—'), coalesce({_fixed('cut_base / 842.0', 3)}, '—')), ' |') from allcuts)"""


@query(sql("judged", "@", _GIVEN).replace(" @", f", {_SECTIONS} select file_id, string_agg(line, chr(10) order by section, k1, k2, k3) || chr(10) as text from rp group by file_id"))
def audit_report(spark, sf_dir):
    e = letters(spark, sf_dir)
    judged = kept(D.reasons(e))  # every section reads it
    lost = judged.where("kind = 'T' and reason is not null and n_chars > 0").select("file_id", "page_id", c("txt").alias("line"))
    cuts = kept(B.short_document_cuts(e).withColumn("H", F.lit(842.0)))
    heads = e.groupBy("file_id").agg(F.countDistinct("page_id").alias("pages"), F.sum(F.when(c("kind") == "T", c("n_chars")).otherwise(0)).alias("chars")).withColumn("name", F.concat(F.lit("file "), c("file_id").cast("string")))
    return X.as_text(X.audit_report(judged, cuts, lost, heads))
