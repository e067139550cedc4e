"""Queries over letters: pages on which every rule of removal has something to remove; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import boilerplate as B
from ..operators import verdict as D
from ..sources.kept import kept
from .registry import ORACLE, QUERIES, c, query, r6
from .vehicles import CTE, sql, table


def _el(where: str, kind: str, x0, y0, w, h, n_pts="9", op="'f'", txt="null", n_chars="0", rot="false", each: str | None = None) -> tuple[str, dict[str, str]]:
    """An element of a letter; each: a number of copies, told apart by k."""
    cols = {"kind": f"'{kind}'", "x0": f"cast({x0} as double)", "y0": f"cast({y0} as double)", "x1": f"cast({x0} as double) + {w}", "y1": f"cast({y0} as double) + {h}", "n_pts": f"cast({n_pts} as int)", "paint_op": op, "txt": f"cast({txt} as string)", "n_chars": f"cast({n_chars} as bigint)", "rot": rot}
    return where if each is None else f"({where}) and k < {each}", cols | {"many": each or ""}


#: A word of its own for each page; digits would be masked.
_NAME = "translate(cast(p * 7919 as string), '0123456789', 'abcdefghij')"
_RULED, _FOOT = "p % 5 < 3", "p % 7 < 4"
_LETTER = [
    # a printed letterhead of small shapes, and a shape beside it that isn't in its line
    _el("p % 2 = 0", "P", "100 + 12 * k", "800 + k % 2", 10, 12, "8 + k", each="5"),
    _el("p % 4 = 0", "P", "104 + p % 3", "806", 9, 8, "12 + p % 5"),
    # rulers over and under the body
    _el(_RULED, "P", 80, 760, 430, 1, "4", "'S'"),
    _el(_FOOT, "P", 80, 80, 430, 1, "4", "'S'"),
    # a logo, a mark at the foot, and a band of marks
    _el("p % 3 = 0", "I", 450, 700, 60, 40),
    _el("p % 3 <> 1", "P", 300, 60, 60, 4),
    _el("p % 3 <> 2", "P", "150 + 30 * k", "40 + 2 * k", 20, 1, "7", each="6"),
    _el("p % 2 = 1", "P", "20 + 9 * (p % 61)", "45", 7, 2, "11"),
    # signature bars that cross a cut, a dense column of glyphs, a stamp of a copy
    _el("p % 5 = 1", "I", 560, 330, 15, 436),
    _el("p % 7 = 2", "I", 10, 70, 15, 450),
    _el("p % 20 = 3", "P", "560 + k % 2", "110 + 8 * k", 2, 5, "8", each="70"),
    _el("p % 6 = 4", "P", 60, 640, 90, 30, "9", "'S'"),
    # texts: repeated, over and under cuts or strips, in a corner, turned, a body
    _el("p % 3 <> 2", "T", 80, 790, 120, 12, txt="concat('Oficio ', cast(p as string))", n_chars="10"),
    _el("true", "T", "90 + p % 40", "770 + p % 11", 60, 12, txt=f"concat('Carta ', {_NAME})", n_chars="14"),
    _el("p % 4 <> 1", "T", "410 + p % 60", "750 + p % 7", 60, 9, txt=f"concat('ref ', {_NAME})", n_chars="9"),
    _el("true", "T", "100 + p % 70", "52 + p % 5", 60, 9, txt=f"concat('pe ', {_NAME})", n_chars="9"),
    _el("p % 8 = 5", "T", 580, 300, 10, 200, txt="'assinado'", n_chars="40", rot="true"),
    _el("p % 9 = 2", "T", 90, 780, 50, 10, txt="'estado'", n_chars="0"),
    _el("true", "T", 80, "200 + 40 * k", 400, 20, txt="concat('corpo ', cast(k as string))", n_chars="90", each="8"),
    # drawings over the top cut and under the foot
    _el("p % 10 = 7", "P", "300 + p % 50", 775, 40, 20, "13"),
    _el("p % 7 = 1", "I", "200 + p % 90", 20, 40, 45),
    # a page whose heading is most of it, and one with a large picture over its foot: both are rolled back
    _el("p % 25 = 12", "T", 80, "785", 400, 20, txt="concat('edital ', cast(p as string))", n_chars="900"),
    _el("p % 25 = 21", "I", 20, 1, 500, 150),
]
#: Pages of one size but for scanning: parts of a point apart.
_SIZES = "595 + 0.2 * (p % 3 - 1) as W, 842 - 0.3 * (p % 2) as H"



_COLS = list(_LETTER[0][1])
_EACH = 70
_LETTERS_SQL = "select cast(p % 4 as int) as file_id, cast(p as int) as page_id, cast(null as string) as shape, " + ", ".join(x for x in _COLS if x != "many") + f", {_SIZES} from (" + " union all ".join(
    f"select p, k, {', '.join(f'{x} as {n}' for n, x in cols.items() if n != 'many')} from (select *, s_suppkey as p, unnest(range(0, {_EACH})) as k from supplier) where ({where}) and {'true' if cols['many'] else 'k = 0'}" for where, cols in _LETTER
) + ")"
_GIVEN = {"el": ("", CTE["el"][1].replace("y0 desc, x0, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate", "y0 desc, x0, x1, y1, kind, n_pts, txt").replace("from boxes", f"from ({_LETTERS_SQL})").replace(", W, H,", ", 595.0 as W, 842.0 as H,"))}


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = lambda cols: [x for x in cols.items() if x[0] != "many"]
    # pages are few and small: they are dealt out before each becomes its elements
    pages = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as p", "0 as k").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p")
    rows = ", ".join(f"if({where}, named_struct({', '.join(f'{n!r}, {x}' for n, x in fields(cols))}), null)" for where, cols in _LETTER if not cols["many"])
    several = [f"transform(filter(sequence(0, {cols['many']} - 1), k -> {where}), k -> named_struct({', '.join(f'{n!r}, {x}' for n, x in fields(cols))}))" for where, cols in _LETTER if cols["many"]]
    d = pages.select("p", F.expr(f"inline(concat(array_compact(array({rows})), {', '.join(several)}))")).selectExpr("cast(p % 4 as int) as file_id", "cast(p as int) as page_id", *(x for x in _COLS if x != "many"), *(f"cast({x.split(' as ')[0]} as double) as {x.split(' as ')[1]}" for x in _SIZES.split(", ")))
    w = Win.partitionBy("file_id", "page_id").orderBy(F.desc("y0"), "x0", "x1", "y1", "kind", "n_pts", "txt")
    return kept(d.withColumn("el_ix", F.row_number().over(w)).withColumn("key", G.element_key(T.key_text(c("txt")))))


@query(sql("judged verdict", "select j.page_id, j.el_ix, j.reason, v.reason as final from judged j join verdict v using (file_id, page_id, el_ix) where j.reason is not null", _GIVEN))
def letter_reasons(spark, sf_dir):
    judged = kept(D.reasons(letters(spark, sf_dir)))
    back = D.page_loss(judged).select("file_id", "page_id", "rolled_back")
    return judged.where("reason is not null").join(back, ["file_id", "page_id"]).select("page_id", "el_ix", "reason", F.when(~c("rolled_back"), c("reason")).alias("final"))


def _bands(spark, sf_dir):
    return B.base_bands(letters(spark, sf_dir)).select("file_id", r6("lo", "lo"), r6("hi", "hi"))


# the elements' vehicle has no bands; letters do
QUERIES["base_bands"], ORACLE["base_bands"] = _bands, sql("bands", "select file_id, round(lo, 6) as lo, round(hi, 6) as hi from bands", _GIVEN)


@query(sql("loss", "select page_id, chars, chars_lost, round(area_lost, 3) as area_lost, rolled_back from loss", _GIVEN))
def letter_losses(spark, sf_dir):
    return D.page_loss(D.reasons(letters(spark, sf_dir))).select("page_id", "chars", "chars_lost", F.round("area_lost", 3).alias("area_lost"), "rolled_back")
