"""Tables of pages: texts in the cells of drawn grids.

A table is a zone of connected stroked lines with enough of them both ways. Its boundaries are the sorted places of its vertical and
horizontal lines, those closer than TOUCH as one. A text belongs to the cell whose left and upper lines it meets first, going left
and up from its middle; where a line is missing, cells are one, and its text is that of the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import values as V
from . import zones as Z
from .boilerplate import PAGE

c = F.col
#: Lines both ways that a page needs; a single box has two.
LEAST_LINES = 3
_BOX = ("x0", "y0", "x1", "y1")


def _smallest(d: DataFrame, one: list[str]) -> DataFrame:
    """Of several zones that hold a row, the smallest one (of equal ones the upper)."""
    area = (c("_x1") - c("_x0")) * (c("_y1") - c("_y0"))
    return d.withColumn("_k", F.row_number().over(Win.partitionBy(*one).orderBy(area, "zone"))).where("_k = 1").drop("_k", *(f"_{x}" for x in _BOX))


def boundaries(elements: DataFrame, zones: DataFrame) -> DataFrame:
    """(page, zone, flat, x0, y0, x1, y1, at, ix): the lines of each zone with their place (x from the left, y from the top as
    a negative number) and the number of their boundary, from 0."""
    lines = Z.grid_lines(elements, True).withColumn("_i", F.struct("flat", *_BOX)).distinct()
    inside = (c("x0") >= c("_x0")) & (c("x1") <= c("_x1")) & (c("y0") >= c("_y0")) & (c("y1") <= c("_y1"))
    d = _smallest(lines.join(zones, PAGE).where(inside), [*PAGE, "_i"]).drop("_i")
    d = d.withColumn("at", F.when(c("flat"), -(c("y0") + c("y1")) / 2).otherwise((c("x0") + c("x1")) / 2))
    w = Win.partitionBy(*PAGE, "zone", "flat").orderBy("at")
    return d.withColumn("_new", (c("at") - F.lag("at").over(w) > V.TOUCH).cast("int")).withColumn("ix", F.coalesce(F.sum("_new").over(w), F.lit(0)).cast("int")).drop("_new")


def placed_texts(elements: DataFrame, zones: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, zone, el_ix, txt, x0, cx, cy, row, col): texts with their cells. Unrotated texts whose middle lies in a zone; one on a
    boundary belongs to the right or lower cell, one without a line at its left and above to none."""
    t = elements.where((c("kind") == "T") & ~c("rot") & (T.strip(F.coalesce("txt", F.lit(""))) != ""))
    t = t.select(*PAGE, "el_ix", "txt", "x0", ((c("x0") + c("x1")) / 2).alias("cx"), ((c("y0") + c("y1")) / 2).alias("cy"))
    e = V.ZONE_EDGE
    t = _smallest(t.join(zones, PAGE).where(c("cx").between(c("_x0") + e, c("_x1") - e) & c("cy").between(c("_y0") + e, c("_y1") - e)), [*PAGE, "el_ix"])
    ln = lines.select(*PAGE, "zone", "flat", "at", "ix", *(c(x).alias(f"_{x}") for x in _BOX))
    left = ~c("flat") & (c("at") <= c("cx")) & c("cy").between(c("_y0") - V.TOUCH, c("_y1") + V.TOUCH)
    above = c("flat") & (-c("at") >= c("cy")) & c("cx").between(c("_x0") - V.TOUCH, c("_x1") + V.TOUCH)
    return t.join(ln, [*PAGE, "zone"]).groupBy(*PAGE, "zone", "el_ix", "txt", "x0", "cx", "cy").agg(F.max(F.when(above, c("ix"))).alias("row"), F.max(F.when(left, c("ix"))).alias("col"))


def matrix(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, rows): cells (key, row, col, n_cols, cell) as arrays of nullable cells; rows without a cell are left out."""
    rows = cells.groupBy(*key, "row", "n_cols").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("m"))
    one: Column = F.transform(F.sequence(F.lit(0), c("n_cols") - 1), lambda k: F.try_element_at(c("m"), k))
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("row", one.alias("cells")))).alias("r")).select(*key, c("r.cells").alias("rows"))


def page_tables(elements: DataFrame) -> DataFrame:
    """(page, zone, n_rows, n_cols, markdown): the tables of pages, numbered from the top; n_rows and n_cols as drawn. Zones whose texts
    make no table (under two rows or columns) are left out. A cell's texts are joined from the top, left to right."""
    top = Win.partitionBy(*PAGE).orderBy(F.desc("y1"), "x0", "y0", "x1")
    zones = Z.table_zones(elements, True, LEAST_LINES, LEAST_LINES).withColumn("zone", F.row_number().over(top))
    zones = zones.select(*PAGE, "zone", *(c(x).alias(f"_{x}") for x in _BOX))
    lines = boundaries(elements, zones)
    size = lines.groupBy(*PAGE, "zone").agg(F.max(F.when(c("flat"), c("ix"))).alias("n_rows"), F.max(F.when(~c("flat"), c("ix"))).alias("n_cols"))
    d = placed_texts(elements, zones, lines).join(size, [*PAGE, "zone"]).where("row < n_rows and col < n_cols")
    texts = F.sort_array(F.collect_list(F.struct((-c("cy")).alias("y"), c("x0").alias("x"), "el_ix", "txt")))
    cells = d.groupBy(*PAGE, "zone", "n_rows", "n_cols", "row", "col").agg(F.array_join(texts["txt"], " ").alias("cell"))
    out = matrix(cells, [*PAGE, "zone", "n_rows", "n_cols"])
    return out.withColumn("markdown", T.table_md(c("rows"))).where("markdown is not null").drop("rows")
