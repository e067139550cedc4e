"""Tables that the registered queries read: documents as pages of files (their sources), and page elements derived
from lineitem by plain arithmetic, so that any engine gets the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

#: Runs as it is on Spark and DuckDB.
BOXES = """
with b as (
  select l_orderkey % 500 as page_id, (l_orderkey % 500) % 20 as file_id,
    case when (l_orderkey % 500) % 50 = 0 then 'P' when l_returnflag = 'A' then 'T' when l_returnflag = 'N' then 'P' else 'I' end as kind,
    (l_orderkey % 500) % 50 = 0 as sig, *
  from lineitem),
s as (
  select *, case when sig then 'sig' when kind = 'P' and l_partkey % 25 = 0 then 'ruler' when kind = 'I' and l_partkey % 3 = 0 then 'print'
                 when l_partkey % 5 = 0 then 'flat' else 'tall' end as shape
  from b),
g as (
  select *,
    cast(case shape when 'sig' then 560 when 'ruler' then 80 else (l_partkey*7) % 595 end as double) as x0,
    cast(case when shape = 'ruler' then case when l_linenumber % 2 = 0 then 760 else 56 end else (l_suppkey*97 + l_linenumber*13) % 842 end as double) as y0,
    cast(case shape when 'sig' then 3 when 'ruler' then 430 when 'print' then l_quantity*10 when 'flat' then l_quantity*12 else l_quantity end as double) as w,
    cast(case shape when 'sig' then 6 when 'ruler' then 1 when 'print' then l_quantity*12 when 'flat' then l_linenumber else l_linenumber*20 end as double) as h
  from s)
select page_id, file_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, kind, shape, x0, y0, x0 + w as x1, y0 + h as y1,
  (not sig and l_linestatus = 'F' and l_partkey % 11 = 0) as rot,
  case when shape = 'ruler' or (shape <> 'sig' and l_partkey % 2 = 0) then 'S' else 'f' end as paint_op,
  cast(case when shape = 'sig' then 12 else 4 + l_linenumber % 4 end as int) as n_pts,
  case when kind = 'T' then concat('Folha ', cast(l_partkey % 4 as string), ' do item ', cast(l_linenumber as string)) end as txt,
  cast(case when kind = 'T' and l_partkey % 37 <> 0 then 20 + l_quantity else 0 end as bigint) as n_chars,
  cast(595 as double) as W, cast(842 as double) as H
from g
"""
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    d = spark.sql(BOXES.replace("from lineitem", "from {lines}"), lines=lines)
    w = Win.partitionBy("file_id", "page_id").orderBy(F.desc("y0"), "x0", *ORDER)
    d = d.withColumn("el_ix", F.row_number().over(w)).withColumn("key", G.element_key(T.key_text(F.col("txt"))))
    return d.select("file_id", "page_id", "el_ix", "kind", "shape", "x0", "y0", "x1", "y1", "rot", "paint_op", "n_pts", "txt", "n_chars", "key", "W", "H")


#: The same for DuckDB, as common table expressions by name with those they need.
CTE = {
    "boxes": ("", BOXES),
    "el": ("boxes", """
select file_id, page_id, cast(row_number() over (partition by page_id order by y0 desc, x0, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as int) as el_ix, kind, shape, x0, y0, x1, y1, rot, paint_op, n_pts, txt, n_chars, W, H,
  case kind when 'T' then concat_ws('|', 'T', cast(round_even(y0/4, 0) as int), substring(lower(trim(regexp_replace(txt, '[0-9]', '#', 'g'))), 1, 14))
    when 'P' then concat_ws('|', 'P', cast(round_even(x0/3, 0) as int), cast(round_even(y0/3, 0) as int), cast(round_even(x1/3, 0) as int), cast(round_even(y1/3, 0) as int), n_pts, paint_op)
    else concat_ws('|', kind, cast(round_even(x0/3, 0) as int), cast(round_even(x1/3, 0) as int), case when y0 >= 842*0.7 then 'T' when y1 <= 842*0.12 then 'B' else 'M' end) end as key
from boxes"""),
    "sizes": ("el", "select file_id, count(distinct page_id) as n_pages from el group by file_id"),
    "keys": ("el sizes", """
select file_id, key, kind, pages, y0 from (
  select file_id, key, kind, count(distinct page_id) as pages, arg_max(y0, page_id * 1000000 + el_ix) as y0 from el
  where not rot and case when kind = 'P' then y1 <= 84.2 else (y0 >= 842*0.7 or y1 <= 842*0.12) end group by file_id, key, kind) join sizes using (file_id)
where pages >= greatest(3, ceil(n_pages * 0.25))"""),
    "rulers": ("el", """
select * from (select *, case when x1-x0 >= 0.45*595 and y1-y0 <= 3.5 then case when y0 >= 842*0.85 then 'topo' when y1 <= 842*0.11 then 'base' end end as side from el where kind = 'P' and not rot) r
where side is not null and not (
  exists (select 1 from el v where v.file_id = r.file_id and v.page_id = r.page_id and v.kind = 'P' and not v.rot and v.x1-v.x0 <= 3.5 and v.y1-v.y0 >= 10 and (v.paint_op = 'S' or v.n_pts <= 6)
    and abs((v.x0+v.x1)/2 - r.x0) <= 5 and v.y0 <= (r.y0+r.y1)/2 + 5 and v.y1 >= (r.y0+r.y1)/2 - 5 and ((r.y0+r.y1)/2 - v.y0 >= 10 or v.y1 - (r.y0+r.y1)/2 >= 10))
  and exists (select 1 from el v where v.file_id = r.file_id and v.page_id = r.page_id and v.kind = 'P' and not v.rot and v.x1-v.x0 <= 3.5 and v.y1-v.y0 >= 10 and (v.paint_op = 'S' or v.n_pts <= 6)
    and abs((v.x0+v.x1)/2 - r.x1) <= 5 and v.y0 <= (r.y0+r.y1)/2 + 5 and v.y1 >= (r.y0+r.y1)/2 - 5 and ((r.y0+r.y1)/2 - v.y0 >= 10 or v.y1 - (r.y0+r.y1)/2 >= 10)))"""),
    "cuts": ("rulers sizes", """
select file_id, page_id, min(case when side = 'topo' then y0 end) as cut_top, max(case when side = 'base' then y1 end) as cut_base from rulers
where (file_id, side, round_even(y0/6, 0)) in (select (file_id, side, b) from (select file_id, side, round_even(y0/6, 0) as b, count(distinct page_id) as n from rulers group by all) join sizes using (file_id) where n >= greatest(3, ceil(n_pages * 0.25)))
group by file_id, page_id"""),
    "bands": ("keys", """
select file_id, min(y0) - 2.0 as lo, max(y0) + 1.2 as hi from (
  select *, sum(fresh) over (partition by file_id order by y0, key) as band from (
    select *, case when y0 - lag(y0) over (partition by file_id order by y0, key) > 3 then 1 else 0 end as fresh from keys where kind = 'P'))
group by file_id, band having count(*) >= 5"""),
    "small": ("el", "select *, row_number() over (partition by file_id, page_id order by y0 desc, x0, el_ix) as k from el where kind = 'P' and not rot and y0 >= 842*(1-0.30) and y1-y0 <= 16"),
    "folded": ("small", """
select file_id, page_id, k, y0 as y, 0 as line, el_ix, x0, x1, n_pts from small where k = 1
union all
select s.file_id, s.page_id, s.k, case when abs(f.y - s.y0) <= 3.5 then f.y else s.y0 end, f.line + case when abs(f.y - s.y0) <= 3.5 then 0 else 1 end, s.el_ix, s.x0, s.x1, s.n_pts
from folded f join small s on s.file_id = f.file_id and s.page_id = f.page_id and s.k = f.k + 1"""),
    "clusters": ("folded", """
select file_id, page_id, line, min(y) as y, min(x0) as x0, max(x1) as x1, count(*) as n, sum(n_pts) as pts,
  concat_ws('|', 'PL', cast(round_even(min(y)/4, 0) as int), cast(round_even(min(x0)/4, 0) as int), cast(round_even(max(x1)/4, 0) as int), count(*), sum(n_pts) % 99991) as key
from folded group by file_id, page_id, line having count(*) >= 3"""),
    "lines": ("clusters sizes", "select * from clusters where (file_id, key) in (select (file_id, key) from (select file_id, key, count(distinct page_id) as n from clusters group by all) join sizes using (file_id) where n >= greatest(3, ceil(n_pages * 0.25)))"),
    "own0": ("rulers", "select file_id, page_id, min(case when side = 'topo' then y0 end) as top, max(case when side = 'base' then y1 end) as base from rulers group by file_id, page_id"),
    "own": ("own0 clusters", """
select file_id, page_id, coalesce(low, top) as cut_top, base as cut_base from own0 left join (
  select file_id, page_id, min(ly) - 4 as low from (
    select *, max(far) over (partition by file_id, page_id order by ly desc, line rows unbounded preceding) as broken from (
      select o.file_id, o.page_id, c.y as ly, c.line, case when coalesce(lag(c.y) over (partition by o.file_id, o.page_id order by c.y desc, c.line), o.top) - c.y > 22 then 1 else 0 end as far
      from own0 o join clusters c on c.file_id = o.file_id and c.page_id = o.page_id where c.y < o.top)) where broken = 0 group by file_id, page_id) using (file_id, page_id)"""),
    "allcuts": ("el cuts own", """
select * from (
  select p.file_id, p.page_id, case when n <= 4 then coalesce(least(c.cut_top, o.cut_top), 842*(1-0.072)) else c.cut_top end as cut_top, case when n <= 4 then coalesce(greatest(c.cut_base, o.cut_base), 842*0.075) else c.cut_base end as cut_base
  from (select distinct file_id, page_id from el) p join (select file_id, count(distinct page_id) as n from el group by file_id) using (file_id)
  left join cuts c on c.file_id = p.file_id and c.page_id = p.page_id left join own o on o.file_id = p.file_id and o.page_id = p.page_id)
where cut_top is not null or cut_base is not null"""),
    "drawn": ("el", "select * from el where kind = 'P' and not rot and (paint_op = 'S' or n_pts <= 6)"),
    "grid": ("drawn", """
select *, row_number() over (order by file_id, page_id, flat, x0, y0, x1, y1) as i from (
  select file_id, page_id, true as flat, x0, y0, x1, y1 from drawn where y1-y0 <= 3.5 and x1-x0 >= 24
  union all select file_id, page_id, false, x0, y0, x1, y1 from drawn where not (y1-y0 <= 3.5 and x1-x0 >= 24) and x1-x0 <= 3.5 and y1-y0 >= 12
  union all select file_id, page_id, unnest([true, true, false, false]), unnest([x0, x0, x0, x1]), unnest([y0, y1, y0, y0]), unnest([x1, x1, x0, x1]), unnest([y0, y1, y1, y1]) from drawn
    where not (y1-y0 <= 3.5 and x1-x0 >= 24) and not (x1-x0 <= 3.5 and y1-y0 >= 12) and paint_op = 'S' and x1-x0 >= 16 and y1-y0 >= 16 and n_pts <= 6 and (x1-x0)*(y1-y0) < 595*842*0.85)"""),
    "touch": ("grid", "select a.i as a, b.i as b from grid a join grid b on a.file_id = b.file_id and a.page_id = b.page_id and a.x0 <= b.x1 + 3 and b.x0 <= a.x1 + 3 and a.y0 <= b.y1 + 3 and b.y0 <= a.y1 + 3"),
    "reach": ("touch", "select a, b from touch union select r.a, t.b from reach r join touch t on t.a = r.b"),
    "zones": ("grid reach", """
select file_id, page_id, count_if(flat) as n_flat, count_if(not flat) as n_tall, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1
from grid join (select a as i, min(b) as root from reach group by a) using (i) group by file_id, page_id, root having count_if(flat) >= 2 and count_if(not flat) >= 2"""),
    "inzone": ("el zones", "select distinct e.file_id, e.page_id, el_ix from el e join zones z on e.file_id = z.file_id and e.page_id = z.page_id and (e.x0+e.x1)/2 between z.x0+0.75 and z.x1-0.75 and (e.y0+e.y1)/2 between z.y0+0.75 and z.y1-0.75"),
    "strips": ("el", """
select file_id, page_id, sum(part) as coverage, sum(part) >= 842*0.8 as protect from (
  select file_id, page_id, island, max(y1) - min(y0) as part from (
    select *, sum(fresh) over (partition by file_id, page_id order by y0, y1, el_ix) as island from (
      select *, case when y0 > max(y1) over (partition by file_id, page_id order by y0, y1, el_ix rows between unbounded preceding and 1 preceding) + 2 then 1 else 0 end as fresh
      from el where kind = 'I' and not rot and x1-x0 >= 595*0.8)) group by file_id, page_id, island) group by file_id, page_id"""),
    "signature": ("el", """
select file_id, page_id, min(col)*4.0 - 6 as sig_x0, max(col)*4.0 + 10 as sig_x1 from (
  select file_id, page_id, floor((x0+x1)/2/4) as col, count(*) as n, max((y0+y1)/2) - min((y0+y1)/2) as span from el
  where kind = 'P' and not rot and ((x0+x1)/2 >= 595*0.78 or (x0+x1)/2 <= 595*0.22) group by all having n >= 25 and span >= 842*0.55 and n/span*100.0 >= 12)
group by file_id, page_id"""),
    "members": ("lines folded", "select f.file_id, f.page_id, f.el_ix from folded f join lines l on l.file_id = f.file_id and l.page_id = f.page_id and l.line = f.line"),
    "judged0": ("el keys lines members allcuts signature strips bands inzone", """
select e.*, cut_top, cut_base, sig_x0, sig_x1, coalesce(protect, false) as strips,
  (e.file_id, e.key) in (select (file_id, key) from keys) as repeats,
  (e.file_id, e.page_id, e.el_ix) in (select (file_id, page_id, el_ix) from members) as in_line,
  e.kind = 'P' and e.y0 >= 842*(1-0.30) and exists (select 1 from lines l where l.file_id = e.file_id and l.page_id = e.page_id and l.x0 - 12 <= e.x0 and e.x1 <= l.x1 + 12 and abs(e.y0 - l.y) <= 7) as orphan,
  e.kind = 'P' and e.y1 <= 842*0.12 and exists (select 1 from bands b where b.file_id = e.file_id and e.y0 between b.lo and b.hi) as in_band,
  (e.file_id, e.page_id, e.el_ix) in (select (file_id, page_id, el_ix) from inzone) as in_table
from el e left join allcuts c on c.file_id = e.file_id and c.page_id = e.page_id left join signature s on s.file_id = e.file_id and s.page_id = e.page_id left join strips t on t.file_id = e.file_id and t.page_id = e.page_id"""),
    "judged1": ("judged0", """
select *, case when in_line then 'cluster_topo' when rot then 'assinatura_rotacionada' when kind = 'P' and x0 >= sig_x0 and x1 <= sig_x1 then 'assinatura_vetorial'
  when kind = 'T' then case when repeats then 'boiler_texto' when y0 >= cut_top - 1 then 'corte_topo' when y1 <= cut_base + 1 then 'corte_base' when y0 >= 842-78 then 'faixa_fixa_topo_txt' when y1 <= 70 then 'faixa_fixa_base_txt' when y0 >= 842-95 and x0 >= 400 then 'canto_direito' end
  when orphan then 'glifo_orfao'
  when kind = 'I' and x1-x0 >= 595*0.8 and (y1-y0 >= 842*0.8 or (strips and not rot)) then null
  when kind = 'P' and paint_op = 'S' and x1 <= 200 and y0 >= 842-230 then 'carimbo_copia' when kind = 'I' and repeats then 'boiler_imagem' when kind = 'P' and repeats then 'boiler_path'
  when y1 >= cut_top - 2 and (y0+y1)/2 >= cut_top - 2 then 'corte_topo' when y1 >= cut_top - 2 and x1-x0 <= 20 and y1-y0 >= 421 and (x0 >= 595*(1-0.12) or x1 <= 595*0.12) then 'tarja_margem'
  when y0 <= cut_base + 2 and (y0+y1)/2 <= cut_base + 2 then 'corte_base' when y0 <= cut_base + 2 and x1-x0 <= 20 and y1-y0 >= 421 and (x0 >= 595*(1-0.12) or x1 <= 595*0.12) then 'tarja_margem'
  when in_band then 'faixa_base_vetorial' end as raw from judged0"""),
    "judged": ("judged1", "select * exclude (raw), case when (in_table and raw not in ('assinatura_rotacionada', 'assinatura_vetorial', 'carimbo_copia', 'tarja_margem')) or (kind = 'T' and n_chars = 0) then null else raw end as reason from judged1"),
    "loss": ("judged", """
select *, (chars >= 200 and text_loss > 0.35) or area_loss > 0.10 as rolled_back from (
  select *, case when chars > 0 then chars_lost / chars else 0.0 end as text_loss, area_lost / (595*842) as area_loss from (
    select file_id, page_id, sum(case when kind = 'T' then n_chars else 0 end) as chars, sum(case when kind = 'T' and soft then n_chars else 0 end) as chars_lost, sum(case when kind = 'I' and soft then greatest(0.0, (x1-x0)*(y1-y0)) else 0.0 end) as area_lost
    from (select *, coalesce(reason not in ('assinatura_rotacionada', 'assinatura_vetorial', 'carimbo_copia', 'tarja_margem'), false) as soft from judged) group by file_id, page_id))"""),
    "verdict": ("judged loss", "select j.* exclude (reason), case when not rolled_back then reason end as reason from judged j join loss l on l.file_id = j.file_id and l.page_id = j.page_id"),
}


def sql(names: str, select: str, given: dict[str, tuple[str, str]] | None = None) -> str:
    """A statement over these common table expressions and all that they need; `given` are used in place of those of that name."""
    order, known = [], CTE | (given or {})

    def add(name: str) -> None:
        for x in known[name][0].split():
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "with recursive " + ", ".join(f"{x} as ({known[x][1]})" for x in order) + f" {select}"
