"""Protected areas of a page: tables and boxes, scanned bodies in strips, dense signature columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import values as V
from . import pagewise as P
from .boilerplate import PAGE

c = F.col


def _thin() -> tuple[Column, Column, Column]:
    """Flat lines, tall lines, boxes."""
    flat = (G.height <= V.THIN) & (G.width >= V.LINE_H)
    tall = (G.width <= V.THIN) & (G.height >= V.LINE_V)
    box = G.stroked & (G.width >= V.RECT_SIDE) & (G.height >= V.RECT_SIDE) & (c("n_pts") <= 6) & (G.width * G.height < G.W * G.H * V.RECT_MOST)
    return flat, tall, box


def drawn_as() -> Column:
    """1 for a flat line, 2 for a tall one, 3 for a box, of which each side is one, and 0 for other elements."""
    flat, tall, box = _thin()
    able = (c("kind") == "P") & ~c("rot") & (G.stroked | (c("n_pts") <= 6))
    return F.when(F.coalesce(able, F.lit(False)), F.when(flat, 1).when(tall, 2).when(box, 3).otherwise(0)).otherwise(0)


def grid_lines(elements: DataFrame, stroked_only: bool = False) -> DataFrame:
    """(file, page, flat, x0, y0, x1, y1): thin horizontal and vertical lines, and the four sides of stroked boxes."""
    drawn = G.stroked if stroked_only else G.stroked | (c("n_pts") <= 6)
    p = elements.where((c("kind") == "P") & ~c("rot") & drawn)
    flat, tall, box = _thin()
    line = lambda f, x0, y0, x1, y1: F.struct(F.lit(f).alias("flat"), c(x0).alias("x0"), c(y0).alias("y0"), c(x1).alias("x1"), c(y1).alias("y1"))
    own = ("x0", "y0", "x1", "y1")
    sides = F.array(line(True, "x0", "y0", "x1", "y0"), line(True, "x0", "y1", "x1", "y1"), line(False, "x0", "y0", "x0", "y1"), line(False, "x1", "y0", "x1", "y1"))
    return p.select(*PAGE, F.explode(F.when(flat, F.array(line(True, *own))).when(tall, F.array(line(False, *own))).when(box, sides)).alias("e")).select(*PAGE, "e.*")


def groups(page: np.ndarray, flat: np.ndarray, box: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of the components of touching lines a row of each, its flat and tall lines, and its box; pages are together."""
    label = P.touching(page, *box, V.TOUCH)
    o = np.argsort(label, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], label[o][1:] != label[o][:-1]])) if len(o) else o
    n_flat = np.add.reduceat(flat[o].astype(np.int64), at) if len(o) else o
    n_tall = np.diff(np.append(at, len(o))) - n_flat
    far = [f.reduceat(v[o], at) if len(o) else v for f, v in zip((np.minimum, np.minimum, np.maximum, np.maximum), box)]
    return o[at], n_flat, n_tall, far


def _zones(least_flat: int, least_tall: int):
    def run(table: pa.Table) -> pa.Table:
        """Components of touching lines of whole pages, with their counts and boxes."""
        at, n_flat, n_tall, far = groups(P.pages_of(table, PAGE), table.column("flat").to_numpy(), P.numbers(table, "x0", "y0", "x1", "y1"))
        kept = (n_flat >= least_flat) & (n_tall >= least_tall)
        pages = table.select(PAGE).take(pa.array(at[kept]))
        return pa.table([*pages.columns, *(pa.array(v[kept]) for v in (n_flat, n_tall, *far))], names=[*PAGE, "n_flat", "n_tall", "x0", "y0", "x1", "y1"])

    return run


def table_zones(elements: DataFrame, stroked_only: bool = False, least_flat: int = 2, least_tall: int = 2) -> DataFrame:
    """(file, page, n_flat, n_tall, box) of groups of touching lines. A page is the unit: its lines fit in a task."""
    d = grid_lines(elements, stroked_only)
    keys = ", ".join(f"{k} {d.schema[k].dataType.simpleString()}" for k in PAGE)
    return P.by_page(d, PAGE, _zones(least_flat, least_tall), f"{keys}, n_flat bigint, n_tall bigint, x0 double, y0 double, x1 double, y1 double")


def in_zones(elements: DataFrame, zones: DataFrame) -> DataFrame:
    """(file, page, el_ix) of elements whose centre is inside a zone, its edge excluded."""
    z = zones.select(*PAGE, *(c(k).alias(f"z{k}") for k in ("x0", "y0", "x1", "y1")))
    x, y, t = (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2, V.ZONE_EDGE
    return elements.join(z, PAGE).where(x.between(c("zx0") + t, c("zx1") - t) & y.between(c("zy0") + t, c("zy1") - t)).select(*PAGE, "el_ix").distinct()


def strip() -> Column:
    """Wide images."""
    return G.image & ~c("rot") & (G.width >= G.W * V.PAGE_IMAGE)


def at_side() -> Column:
    """Paths near the side margins."""
    x = (c("x0") + c("x1")) / 2
    return (c("kind") == "P") & ~c("rot") & ((x >= G.W * 0.78) | (x <= G.W * 0.22))


def scanned_strips(elements: DataFrame) -> DataFrame:
    """(file, page, coverage, protect): wide images whose united heights are the page's body."""
    s = elements.where(strip())
    w = Win.partitionBy(*PAGE).orderBy("y0", "y1", "el_ix")
    s = s.withColumn("end", F.max("y1").over(w.rowsBetween(Win.unboundedPreceding, -1)))
    s = s.withColumn("new", F.coalesce((c("y0") > c("end") + V.STRIP_GAP).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(w))
    s = s.groupBy(*PAGE, "H", "island").agg((F.max("y1") - F.min("y0")).alias("part"))
    s = s.groupBy(*PAGE, "H").agg(F.sum("part").alias("coverage"))
    return s.select(*PAGE, "coverage", (c("coverage") >= G.H * V.PAGE_IMAGE).alias("protect"))


def signature_columns(elements: DataFrame) -> DataFrame:
    """(file, page, sig_x0, sig_x1): the stretch of dense columns of paths near the side margins."""
    x = (c("x0") + c("x1")) / 2
    p = elements.where(at_side()).withColumn("col", F.floor(x / V.COLUMN)).withColumn("yc", (c("y0") + c("y1")) / 2)
    d = p.groupBy(*PAGE, "H", "col").agg(F.count(F.lit(1)).alias("n"), (F.max("yc") - F.min("yc")).alias("span"))
    d = d.where((c("n") >= V.COLUMN_LEAST) & (c("span") >= G.H * V.COLUMN_SPAN)).where(c("n") / c("span") * 100.0 >= V.COLUMN_DENSITY)
    return d.groupBy(*PAGE).agg((F.min("col") * V.COLUMN - 6).alias("sig_x0"), (F.max("col") * V.COLUMN + V.COLUMN + 6).alias("sig_x1"))
