"""Queries over drawing operations and what they draw; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import streams as E
from .registry import c, query, r6
from .vehicles import BOXES, table

_N = ["null"] * 6


def _row(k: int, op: str, nums=(), where: str = "true", text: str = "null", name: str = "null", sub: str = "null") -> tuple[str, dict[str, str]]:
    """Where an element has this operation, and its columns as expressions."""
    nums = [*(str(x) for x in nums), *_N][:6]
    said = op if op == "paint_op" or op.startswith(("case", "cast")) else f"'{op}'"
    cols = {"i": f"cast(n * 16 + {k} as bigint)", "op": said} | {n: f"cast({x} as double)" for n, x in zip("abcdef", nums)}
    return where, cols | {n: f"cast({x} as string)" for n, x in (("text", text), ("name", name), ("sub", sub))}


_T, _P, _I = "kind = 'T' and ", "kind = 'P' and ", "kind = 'I' and "
_Z = (0, 0, 0, 0, 0, 0)
#: Operations that draw the boxes of the elements' vehicle, in all the ways that the machine knows; runs on Spark and DuckDB.
_BOXED = f"""with e as (select *, l_partkey % 4 as v, case when l_partkey % 4 = 1 then 0.5 else 1.0 end as z,
  row_number() over (partition by page_id order by y0 desc, x0, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as n from ({BOXES}) as boxes)
"""
_ROWS = [
    _row(1, "BT", where=_T + "true"),
    _row(2, "Tm", ("case when rot then 0 else 1 end", "case when rot then 1 else 0 end", "case when rot then -1 else 0 end", "case when rot then 0 else 1 end", "x0", "y0 + 2"), _T + "(v < 2 or rot)"),
    _row(2, "Td", ("x0", "y0 + 2"), _T + "v = 2 and not rot"),
    _row(2, "TD", ("x0", "y0 + 2"), _T + "v = 3 and not rot"),
    _row(3, "TL", (12,), _T + "v <> 3"),
    _row(4, "TD", (0, -12), _T + "v = 3"),
    _row(5, "case v when 2 then 'TJ' when 3 then chr(39) else 'Tj' end", where=_T + "n_chars > 0", text="txt"),
    _row(6, "T*", where=_T + "l_linenumber % 2 = 0"),
    _row(7, '"', where=_T + "l_partkey % 5 = 0 and n_chars > 0", text="'Nota 7'"),
    _row(8, "q", where=_T + "l_partkey % 6 = 0"),  # within a text it means nothing
    _row(9, "ET", where=_T + "true"),
    _row(1, "q", where=_P + "v = 1"),
    _row(2, "cm", (2, 0, 0, 2, 0, 0), _P + "v = 1"),
    _row(3, "re", ("x0 * z", "y0 * z", "(x1 - x0) * z", "(y1 - y0) * z"), _P + "v < 2"),
    _row(3, "m", ("x0", "y0"), _P + "v >= 2"),
    _row(4, "l", ("x1", "y0"), _P + "v >= 2"),
    _row(5, "c", ("x1", "y0", "x1", "y1", "x1", "y1"), _P + "v = 2"),
    _row(6, "l", ("x0", "y1"), _P + "v >= 2"),
    _row(7, "h", where=_P + "v >= 2"),
    _row(8, "W", where=_P + "l_partkey % 41 = 0"),
    _row(9, "case when l_partkey % 41 = 0 then 'n' else paint_op end", where=_P + "true"),
    _row(10, "Q", where=_P + "v = 1"),
    _row(11, "q", where=_P + "l_partkey % 53 = 0"),
    _row(12, "Q", where=_P + "l_partkey % 59 = 0"),
    _row(1, "q", where=_I + "true"),
    _row(2, "cm", ("case when rot then 0 else x1 - x0 end", "case when rot then y1 - y0 else 0 end", "case when rot then x0 - x1 else 0 end", "case when rot then 0 else y1 - y0 end", "case when rot then x1 else x0 end", "y0"), _I + "true"),
    _row(3, "Do", where=_I + "l_partkey % 7 <> 0", name="case when l_partkey % 29 = 0 then concat('Fm', cast(l_partkey % 3 as string)) when l_partkey % 31 = 0 then 'Gone' else 'Im' end", sub="case when l_partkey % 29 = 0 then 'Form' when l_partkey % 31 = 0 then null else 'Image' end"),
    _row(3, "BI", where=_I + "l_partkey % 7 = 0"),
    _row(4, "Q", where=_I + "true"),
    # pages that couldn't be read
    _row(15, "cast(null as string)", where="page_id % 61 = 7 and n = 3"),
]
OPERATIONS = _BOXED + "\nunion all ".join(f"select file_id, page_id, {', '.join(f'{x} as {n}' for n, x in cols.items())} from e where {where}" for where, cols in _ROWS)
#: Forms in forms: Fm0 to Fm5 each draw a frame, shrink, and call the next; Fm2 draws an image too, Fm5 calls Fm0 (a cycle).
FORMS = "\nunion all ".join(
    f"select 'Fm{k}' as form, {i} as i, '{op}' as op, " + ", ".join(f"cast({x} as double) as {n}" for n, x in zip("abcdef", [*map(str, nums), *_N])) + f", cast({text} as string) as text, cast({name} as string) as name, cast({sub} as string) as sub"
    for k in range(6)
    for i, (op, nums, text, name, sub) in enumerate(
        [("cm", (0.5, 0, 0, 0.5, 0.125 * k, 0.25), "null", "null", "null"), ("re", (0, 0, 1, 1), "null", "null", "null"), ("S", (), "null", "null", "null")]
        + [("Do", (), "null", "'Im'", "'Image'"), ("BT", (), "null", "null", "null"), ("Tj", (), "'Selo 12'", "null", "null"), ("ET", (), "null", "null", "null")] * (k == 2)
        + [("Do", (), "null", f"'Fm{(k + 1) % 6}'", "'Form'")]
    )
)


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.sql(_BOXED.replace("from lineitem", "from {lines}") + "select * from e", lines=table(spark, sf_dir, "lineitem"))
    row = lambda where, cols: f"if({where}, named_struct({', '.join(f'{n!r}, {x}' for n, x in cols.items())}), null)"
    # an element is looked at for the operations of its kind alone
    of = {k: ", ".join(row(*r) for r in _ROWS if not r[0].startswith("kind = ") or r[0].startswith(k)) for k in (_T, _P, _I)}
    kinds = " ".join(f"when {k.removesuffix(' and ')} then array_compact(array({rows}))" for k, rows in of.items())
    return boxes.select("file_id", "page_id", F.expr(f"inline(case {kinds} end)"))


def _mul(m: list[str], n: list[str]) -> str:
    a, b, cc, d, e, f = m
    return f"[{a}*{n[0]} + {b}*{n[2]}, {a}*{n[1]} + {b}*{n[3]}, {cc}*{n[0]} + {d}*{n[2]}, {cc}*{n[1]} + {d}*{n[3]}, {e}*{n[0]} + {f}*{n[2]} + {n[4]}, {e}*{n[1]} + {f}*{n[3]} + {n[5]}]"


def _list(name: str) -> list[str]:
    return [f"{name}[{k}]" for k in range(1, 7)]


_ONE = "[1.0, 0.0, 0.0, 1.0, 0.0, 0.0] :: double[]"
_M = ["s.a", "s.b", "s.c", "s.d", "s.e", "s.f"]
_KEY_TEXT = "substring(lower(trim(regexp_replace(coalesce({0}, ''), '[0-9]', '#', 'g'))), 1, 14)"
_PT = lambda m, x, y: (f"({m}[1]*({x}) + {m}[3]*({y}) + {m}[5])", f"({m}[2]*({x}) + {m}[4]*({y}) + {m}[6])")


def _points(axis: int) -> str:
    corner = [_PT("r.ctm", x, y)[axis] for x, y in (("s.a", "s.b"), ("s.a + s.c", "s.b"), ("s.a", "s.b + s.d"), ("s.a + s.c", "s.b + s.d"))]
    pair = [_PT("r.ctm", x, y)[axis] for x, y in (("s.a", "s.b"), ("s.c", "s.d"), ("s.e", "s.f"))]
    return f"case when s.op = 're' then [{', '.join(corner)}] when s.op in ('m', 'l', 'c', 'v', 'y') then list_filter([{', '.join(pair)}], lambda x: x is not null) end"


def _fold(ops: str, order: str) -> str:
    """The machine as a recursive fold; ops: a relation of operations, order: what its pages are ordered by."""
    unit = {f"{n}{k}": _PT("r.ctm", x, y)[n == "y"] for n in "xy" for k, (x, y) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))}
    box = lambda f, n: f"{f}({unit[n + '0']}, {unit[n + '3']}, case when s.op = 'Do' then {unit[n + '1']} end, case when s.op = 'Do' then {unit[n + '2']} end)"
    return f"""
s0 as (select *, row_number() over (partition by page_id order by {order}) as k from {ops} where page_id not in (select page_id from {ops} where op is null)),
r as (
  select file_id, page_id, cast(0 as bigint) as k, {_ONE} as ctm, [] :: double[][] as st, false as bt, {_ONE} as tlm, cast(0 as double) as tl, false as rot, [] :: double[] as tx, [] :: double[] as ty, '' as words, cast(0 as bigint) as n_chars,
    [] :: double[] as px, [] :: double[] as py, false as clip, cast(null as string) as kind, cast(null as double) as x0, cast(null as double) as y0, cast(null as double) as x1, cast(null as double) as y1, false as erot, cast(0 as bigint) as n_pts, cast(null as string) as paint_op, cast(null as string) as ewords, cast(0 as bigint) as echars
  from (select distinct file_id, page_id from s0)
  union all
  select file_id, page_id, k, ctm, st, case when bt then op <> 'ET' else op = 'BT' end, tlm1, tl1,
    case when bt and shows then rot or abs({_mul(_list("tlm1"), _list("ctm0"))}[2]) > 0.01 or abs({_mul(_list("tlm1"), _list("ctm0"))}[3]) > 0.01 when bt then rot else false end,
    case when bt and shows then list_append(tx, {_mul(_list("tlm1"), _list("ctm0"))}[5]) when bt then tx else [] :: double[] end, case when bt and shows then list_append(ty, {_mul(_list("tlm1"), _list("ctm0"))}[6]) when bt then ty else [] :: double[] end,
    case when bt and shows and words = '' then {_KEY_TEXT.format("text")} when bt then words else '' end, case when bt and shows then n_chars + coalesce(length(text), 0) when bt then n_chars else 0 end,
    case when bt then px when painted then [] :: double[] when nx is not null then list_concat(px, nx) else px end, case when bt then py when painted then [] :: double[] when ny is not null then list_concat(py, ny) else py end,
    case when bt then clip when painted then false else clip or op in ('W', 'W*') end,
    case when bt and op = 'ET' then 'T' when bt then null when painted and len(px) > 0 and not clip then 'P' when op = 'Do' and sub = 'Image' then 'I' when op = 'BI' then 'II' end,
    case when bt then coalesce(list_min(tx), 0.0) when painted then list_min(px) else ix0 end, case when bt then coalesce(list_min(ty) - 2, 0.0) when painted then list_min(py) else iy0 end,
    case when bt then coalesce(list_max(tx) + 4, 0.0) when painted then list_max(px) else ix1 end, case when bt then coalesce(list_max(ty) + 10, 0.0) when painted then list_max(py) else iy1 end,
    bt and rot, case when not bt and painted then len(px) else 0 end, case when not bt and painted then op end, case when bt then words end, case when bt then n_chars else 0 end
  from (select s.file_id, s.page_id, s.k, s.op, s.text, s.sub, r.bt, r.rot, r.tx, r.ty, r.words, r.n_chars, r.px, r.py, r.clip, r.ctm as ctm0,
      case when r.bt then r.ctm when s.op = 'Q' then coalesce(r.st[-1], {_ONE}) when s.op = 'cm' and s.f is not null then {_mul(_M, _list("r.ctm"))} else r.ctm end as ctm,
      case when r.bt then r.st when s.op = 'q' then list_append(r.st, r.ctm) when s.op = 'Q' then r.st[1:len(r.st) - 1] else r.st end as st,
      case when not r.bt then {_ONE} when s.op = 'Tm' and s.f is not null then [{", ".join(_M)}] when s.op in ('Td', 'TD') and s.b is not null then {_mul(["1", "0", "0", "1", "s.a", "s.b"], _list("r.tlm"))}
        when s.op in ('T*', '''', '"') then {_mul(["1", "0", "0", "1", "0", "(-r.tl)"], _list("r.tlm"))} else r.tlm end as tlm1,
      case when not r.bt then 0.0 when s.op = 'TD' and s.b is not null then -s.b when s.op = 'TL' and s.a is not null then s.a else r.tl end as tl1,
      s.op in ('Tj', 'TJ', '''', '"') as shows, s.op in ('S', 's', 'f', 'F', 'f*', 'B', 'B*', 'b', 'b*', 'n') as painted, {_points(0)} as nx, {_points(1)} as ny,
      {box("least", "x")} as ix0, {box("least", "y")} as iy0, {box("greatest", "x")} as ix1, {box("greatest", "y")} as iy1
    from r join s0 s on s.page_id = r.page_id and s.k = r.k + 1)),
els as (select *, cast(row_number() over (partition by page_id order by k) as int) as el_ix from r where kind is not null)"""


_ELS = """select file_id, page_id, el_ix, kind, round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1, erot as rot, cast(n_pts as int) as n_pts, paint_op, ewords as key_text, echars as n_chars,
  case kind when 'T' then concat_ws('|', 'T', cast(round_even(y0/4, 0) as int), ewords)
    when 'P' then concat_ws('|', 'P', cast(round_even(x0/3, 0) as int), cast(round_even(y0/3, 0) as int), cast(round_even(x1/3, 0) as int), cast(round_even(y1/3, 0) as int), n_pts, paint_op)
    else concat_ws('|', kind, cast(round_even(x0/3, 0) as int), cast(round_even(x1/3, 0) as int), case when y0 >= 842*0.7 then 'T' when y1 <= 842*0.12 then 'B' else 'M' end) end as key from els"""
_KEYS = ["file_id", "page_id"]


def _shown(e: DataFrame) -> DataFrame:
    e = e.withColumns({"W": F.lit(595.0), "H": F.lit(842.0)})
    return e.select(*_KEYS, "el_ix", "kind", *(r6(x, x) for x in ("x0", "y0", "x1", "y1")), "rot", "n_pts", "paint_op", "key_text", "n_chars", G.element_key(c("key_text")).alias("key"))


@query(f"with recursive ops as ({OPERATIONS}), {_fold('ops', 'i')} {_ELS}")
def page_elements(spark, sf_dir):
    return _shown(E.elements_of(operations(spark, sf_dir), _KEYS, "i"))


_EXPANDED = f"""ops as ({OPERATIONS}), forms as ({FORMS}),
x as (select file_id, page_id, [i] as i, 0 as level, op, a, b, c, d, e, f, text, name, sub from ops
  union all select x.file_id, x.page_id, list_concat(x.i, [1, g.i]), level + 1, g.op, g.a, g.b, g.c, g.d, g.e, g.f, g.text, g.name, g.sub from x join forms g on x.op = 'Do' and x.sub = 'Form' and g.form = x.name where level < 4),
flat as (select * from x where not coalesce(op = 'Do' and sub = 'Form' and name is not null and level < 4, false)
  union all select file_id, page_id, list_append(i, unnest([0, 2])), level, unnest(['q', 'Q']), null, null, null, null, null, null, null, null, null from x where op = 'Do' and sub = 'Form' and name is not null and level < 4)"""


@query(f"with recursive {_EXPANDED}, {_fold('flat', 'i')} {_ELS}")
def form_elements(spark, sf_dir):
    ops = E.with_forms(operations(spark, sf_dir), spark.sql(FORMS), "i")
    return _shown(E.elements_of(ops, _KEYS, "i"))


@query(f"""with recursive ops as ({OPERATIONS}), {_fold('ops', 'i')},
span as (select e.file_id, e.page_id, e.kind, e.k as last, case e.kind when 'T' then (select max(k) from s0 b where b.page_id = e.page_id and b.op = 'BT' and b.k < e.k)
  when 'P' then coalesce((select max(k) from s0 b where b.page_id = e.page_id and b.op in ('S', 's', 'f', 'F', 'f*', 'B', 'B*', 'b', 'b*', 'n') and b.k < e.k), 0) + 1 else e.k end as first
  from els e where e.y0 >= 842*0.7 or e.y1 <= 842*0.12),
gone as (select distinct s.page_id, s.k from s0 s join span e on s.page_id = e.page_id and s.k between e.first and e.last where e.kind <> 'P' or s.op in ('m', 'l', 'c', 'v', 'y', 're', 'h', 'W', 'W*', 'S', 's', 'f', 'F', 'f*', 'B', 'B*', 'b', 'b*', 'n')),
kept as (select * from ops where page_id in (select page_id from ops where op is null) union all select s.* exclude (k) from s0 s left join gone g on g.page_id = s.page_id and g.k = s.k where g.k is null)
select file_id, page_id, count(*) as n_ops, count_if(op = 'ET') as n_texts, count_if(op in ('S', 'f', 'n')) as n_paints, count_if(op in ('Do', 'BI')) as n_images, count_if(op = 'q') as n_saves, count_if(op = 'Q') as n_restores, cast(sum(i) as bigint) as places from kept group by file_id, page_id""")
def rewritten_pages(spark, sf_dir):
    ops = operations(spark, sf_dir)
    e = E.elements_of(ops, _KEYS, "i").withColumn("H", F.lit(842.0)).where(G.in_edge_zone())
    n = lambda *names: F.count_if(c("op").isin(*names))
    return E.rewritten(ops, e, _KEYS, "i").groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_ops"), n("ET").alias("n_texts"), n("S", "f", "n").alias("n_paints"), n("Do", "BI").alias("n_images"), n("q").alias("n_saves"), n("Q").alias("n_restores"), F.sum("i").alias("places"))
