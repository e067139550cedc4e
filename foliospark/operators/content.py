"""Content operations of pages: graphics state, text boxes, form placement, text layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import values as V

c = F.col
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def residual_matrix(ops: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, a to f): the matrix that is left after all of a page's operations in order. ops: op (q saves the matrix,
    Q restores the last saved one, or the identity where none is, cm puts its matrix m before it) and m (six numbers)."""
    one = F.array(*(F.lit(x) for x in IDENTITY))
    start = F.struct(one.alias("m"), F.array().cast("array<array<double>>").alias("saved"))

    def step(s: Column, x: Column) -> Column:
        m, saved = s["m"], s["saved"]
        after = F.array(*G.compose([x["m"][i] for i in range(6)], [m[i] for i in range(6)]))
        now = F.when(x["op"] == "Q", F.coalesce(F.try_element_at(saved, F.lit(-1)), one)).when((x["op"] == "cm") & (F.size(x["m"]) == 6), after).otherwise(m)
        kept = F.when(x["op"] == "q", F.concat(saved, F.array(m))).when(x["op"] == "Q", F.slice(saved, F.lit(1), F.greatest(F.size(saved) - 1, F.lit(0)))).otherwise(saved)
        return F.struct(now.alias("m"), kept.alias("saved"))

    pages = ops.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(c(order).alias("o"), "op", "m"))).alias("ops"))  # one page's
    pages = pages.select(*key, F.aggregate("ops", start, step)["m"].alias("m"))
    return pages.select(*key, *(c("m")[i].alias(n) for i, n in enumerate("abcdef")))


def text_boxes(shows: DataFrame, key: list[str]) -> DataFrame:
    """(key, x0, y0, x1, y1, rot): the padded box of the points at which a text object shows something, zeros where it
    shows nothing; rotated if any matrix has a part off its diagonal. shows: x, y, b, c and shown."""
    at = lambda f, x, pad: F.coalesce(f(F.when(c("shown"), c(x))) + pad, F.lit(0.0))
    rot = F.max((F.abs("b") > V.ROT_TOL) | (F.abs("c") > V.ROT_TOL))
    return shows.groupBy(*key).agg(at(F.min, "x", 0.0).alias("x0"), at(F.min, "y", -2.0).alias("y0"), at(F.max, "x", 4.0).alias("x1"), at(F.max, "y", 10.0).alias("y1"), rot.alias("rot"))


def form_scans(forms: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, x0, y0, x1, y1): the box of a page's first form that holds a large image and, by its matrix, covers most of
    the page in both directions. forms: corner points bx0 to by1, matrix m, large, W and H."""
    m = [c("m")[i] for i in range(6)]
    xs, ys = zip(*(G.apply(m, c(x), c(y)) for x in ("bx0", "bx1") for y in ("by0", "by1")))
    box = {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}
    d = forms.withColumns(box).where(c("large") & (c("x1") - c("x0") >= V.PAGE_IMAGE * c("W")) & (c("y1") - c("y0") >= V.PAGE_IMAGE * c("H")))
    first = d.groupBy(*key).agg(F.min_by(F.struct(*box), order).alias("s"))
    return first.select(*key, "s.*")


def grid_pages(pages: DataFrame, zones: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """Pages worth a table search: those with a drawn grid of enough lines both ways, and those that could not be parsed.
    pages: key, parse_ok; zones: key, n_flat, n_tall."""
    grid = zones.where((c("n_flat") >= least) & (c("n_tall") >= least)).select(*key)
    return pages.where(~c("parse_ok")).select(*key).unionByName(pages.where("parse_ok").join(grid, key, "left_semi").select(*key))


def text_layer(elements: DataFrame, key: list[str]) -> DataFrame:
    """(key, shown, left): characters that a page's texts show, and the elements left without its text layer. Paths that
    only clip aren't elements."""
    e = elements.where(~F.coalesce((c("kind") == "P") & c("paint_op").isin("W", "W*", "n"), F.lit(False)))
    return e.groupBy(*key).agg(F.coalesce(F.sum(F.when(c("kind") == "T", c("n_chars"))), F.lit(0)).alias("shown"), F.count_if(c("kind") != "T").alias("left"))
