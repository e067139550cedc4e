"""Queries over drawn tables; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables as X
from .registry import c, query
from .vehicles import sql, table

_X = (60, 180, 340, 460, 540)
_ROWS = 6


def _line(where: str, x0, y0, x1, y1) -> tuple[str, dict[str, str]]:
    """A line; every ninth customer's are filled boxes of many points, which are no lines of a table."""
    return where, {"kind": "'P'", "txt": "cast(null as string)", "paint_op": "case when c_custkey % 9 = 4 then 'f' else 'S' end"} | {k: f"cast({v} as double)" for k, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))}


def _word(where: str, txt: str, x, y) -> tuple[str, dict[str, str]]:
    """A text of 40 by 12 points with its middle at x, y."""
    return where, {"kind": "'T'", "txt": txt, "paint_op": "cast(null as string)"} | {k: f"cast({v} as double)" for k, v in zip(("x0", "y0", "x1", "y1"), (f"{x} - 20", f"{y} - 6", f"{x} + 20", f"{y} + 6"))}


#: Customers in tables of six rows and four columns, two tables on a page. Some cells are merged with the one at their right (no line
#: between columns 1 and 2) or above (no line over column 0), some texts lie on a line, some cells hold two texts or none.
_DRAWN = [
    *(_line("true", a, "y", z, "y + 1") for a, z in zip(_X[1:], _X[2:])),
    _line("not (r % 4 = 3)", _X[0], "y", _X[1], "y + 1"),
    *(_line("final", a, "y - 30", z, "y - 29") for a, z in zip(_X, _X[1:])),
    *(_line("not (r % 5 = 3)" if k == 2 else "true", x, "y - 30", f"{x} + 1", "y") for k, x in enumerate(_X)),
    _word("true", "concat('Nr ', cast(c_custkey as string))", 100, "y - 15"),
    _word("c_custkey % 8 <> 1", "c_name", "case when r % 5 = 2 then 180.5 else 220 end", "case when r % 5 = 4 then y + 0.5 else y - 10 end"),
    _word("c_custkey % 7 = 3", "'e | mais'", 260, "y - 22"),
    _word("true", "c_mktsegment", 400, "y - 15"),
    _word("c_custkey % 6 <> 5", "concat(' ', cast(cast(floor(c_acctbal) as bigint) as string), '  R$ ')", 500, "y - 15"),
    _word("r = 2", "'fora da tabela'", 30, "y - 15"),
]
CUSTOMERS = f"""with q as (select *, cast(c_custkey % {_ROWS} as int) as r, c_custkey = max(c_custkey) over (partition by floor(c_custkey / {_ROWS})) as final,
  cast(floor(c_custkey / {2 * _ROWS}) % 7 as int) as file_id, cast(floor(c_custkey / {2 * _ROWS}) as int) as page_id, cast(780 - 30 * (c_custkey % {_ROWS}) - 400 * (floor(c_custkey / {_ROWS}) % 2) as double) as y from customer)
"""
_REST = "false as rot, cast(4 as int) as n_pts, cast(0 as bigint) as n_chars, cast(595 as double) as W, cast(842 as double) as H"
_EL = f"""select file_id, page_id, cast(row_number() over (partition by page_id order by y0 desc, x0, x1, kind, txt) as int) as el_ix, kind, txt, paint_op, x0, y0, x1, y1, {_REST} from (""" + CUSTOMERS + " union all ".join(f"select file_id, page_id, {', '.join(f'{x} as {n}' for n, x in cols.items())} from q where {where}" for where, cols in _DRAWN) + ")"


def drawn_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.sql(CUSTOMERS.replace("from customer", "from {customer}") + "select * from q", customer=table(spark, sf_dir, "customer"))
    rows = ", ".join(f"if({where}, named_struct({', '.join(f'{n!r}, {x}' for n, x in cols.items())}), null)" for where, cols in _DRAWN)
    d = q.select("file_id", "page_id", F.expr(f"inline(array_compact(array({rows})))"))
    return d.selectExpr("file_id", "page_id", "cast(row_number() over (partition by page_id order by y0 desc, x0, x1, kind, txt) as int) as el_ix", "kind", "txt", "paint_op", "x0", "y0", "x1", "y1", *_REST.split(", "))


_INSIDE = "g.file_id = z.file_id and g.page_id = z.page_id and g.x0 >= z.x0 and g.x1 <= z.x1 and g.y0 >= z.y0 and g.y1 <= z.y1"
_GIVEN = {
    "el": ("", _EL),
    "drawn": ("el", "select * from el where kind = 'P' and not rot and paint_op = 'S'"),
    "tz": ("zones", "select *, row_number() over (partition by file_id, page_id order by y1 desc, x0, y0, x1) as zone from zones where n_flat >= 3 and n_tall >= 3"),
    "ln": ("tz grid", f"select * from (select g.*, z.zone, row_number() over (partition by g.file_id, g.page_id, g.flat, g.x0, g.y0, g.x1, g.y1 order by (z.x1-z.x0)*(z.y1-z.y0), z.zone) as pick from (select distinct file_id, page_id, flat, x0, y0, x1, y1 from grid) g join tz z on {_INSIDE}) where pick = 1"),
    "ix": ("ln", """select *, cast(coalesce(sum(fresh) over (partition by file_id, page_id, zone, flat order by p), 0) as int) as ix from (
  select *, case when p - lag(p) over (partition by file_id, page_id, zone, flat order by p) > 3 then 1 else 0 end as fresh from (select *, case when flat then -(y0+y1)/2 else (x0+x1)/2 end as p from ln))"""),
    "tx": ("el tz", """select * from (select t.*, z.zone, row_number() over (partition by t.file_id, t.page_id, t.el_ix order by (z.x1-z.x0)*(z.y1-z.y0), z.zone) as pick
  from (select *, (x0+x1)/2 as cx, (y0+y1)/2 as cy from el where kind = 'T' and not rot and trim(coalesce(txt, '')) <> '') t join tz z on t.file_id = z.file_id and t.page_id = z.page_id and cx between z.x0+0.75 and z.x1-0.75 and cy between z.y0+0.75 and z.y1-0.75) where pick = 1"""),
    "pl": ("tx ix", """select t.file_id, t.page_id, t.zone, t.el_ix, t.txt, t.x0, t.cy, max(case when i.flat and -p >= cy and cx between i.x0-3 and i.x1+3 then ix end) as "row", max(case when not i.flat and p <= cx and cy between i.y0-3 and i.y1+3 then ix end) as col
  from tx t join ix i on i.file_id = t.file_id and i.page_id = t.page_id and i.zone = t.zone group by all"""),
    "nn": ("ix", "select file_id, page_id, zone, max(ix) filter (flat) as n_rows, max(ix) filter (not flat) as n_cols from ix group by file_id, page_id, zone"),
    "cl": ("pl nn", """select file_id, page_id, zone, n_rows, n_cols, "row", col, replace(trim(regexp_replace(string_agg(txt, ' ' order by cy desc, x0, el_ix), '\\s+', ' ', 'g')), '|', '\\|') as cell
  from pl join nn using (file_id, page_id, zone) where "row" < n_rows and col < n_cols group by all"""),
    "rw": ("cl", """select file_id, page_id, zone, n_rows, n_cols, "row", concat('| ', string_agg(coalesce(cell, ''), ' | ' order by k), ' |') as line from (select distinct file_id, page_id, zone, n_rows, n_cols, "row", unnest(range(0, n_cols)) as k from cl) r
  left join cl on cl.file_id = r.file_id and cl.page_id = r.page_id and cl.zone = r.zone and cl."row" = r."row" and cl.col = r.k group by all""".replace("select file_id, page_id, zone, n_rows, n_cols, \"row\", concat", "select r.file_id, r.page_id, r.zone, r.n_rows, r.n_cols, r.\"row\", concat")),
    "md": ("rw", """select file_id, page_id, zone, n_rows, n_cols, string_agg(case when k = 1 then concat(line, chr(10), '|', repeat(' --- |', n_cols)) else line end, chr(10) order by "row") as markdown
  from (select *, row_number() over (partition by file_id, page_id, zone order by "row") as k from rw) group by file_id, page_id, zone, n_rows, n_cols having count(*) >= 2 and n_cols >= 2"""),
}


@query(sql("md", "select page_id, zone, n_rows, n_cols, markdown from md", _GIVEN))
def page_tables(spark, sf_dir):
    return X.page_tables(drawn_tables(spark, sf_dir)).select("page_id", "zone", "n_rows", "n_cols", "markdown")


@query(sql("tz pl", "select page_id, zone, \"row\", col, count(*) as n, string_agg(el_ix :: varchar, ',' order by el_ix) as texts from pl group by page_id, zone, \"row\", col", _GIVEN))
def table_cells(spark, sf_dir):
    """The cells of all texts in a zone, those without a cell too."""
    from pyspark.sql import Window as Win

    e = drawn_tables(spark, sf_dir)
    z = X.Z.table_zones(e, True, X.LEAST_LINES, X.LEAST_LINES).withColumn("zone", F.row_number().over(Win.partitionBy("file_id", "page_id").orderBy(F.desc("y1"), "x0", "y0", "x1")))
    z = z.select("file_id", "page_id", "zone", *(c(x).alias(f"_{x}") for x in ("x0", "y0", "x1", "y1")))
    d = X.placed_texts(e, z, X.boundaries(e, z))
    return d.groupBy("page_id", "zone", "row", "col").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("el_ix")), lambda x: x.cast("string")), ",").alias("texts"))
