"""Geometry over columns: boxes are columns x0, y0, x1, y1 (origin at the bottom left), pages have W and H."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

c = F.col
def _width() -> Column:
    return c("x1") - c("x0")


def _height() -> Column:
    return c("y1") - c("y0")


def _stroked() -> Column:
    return c("paint_op").isin(*V.STROKES)


def _image() -> Column:
    return c("kind").isin("I", "II")


_NAMES = {"W": lambda: c("W"), "H": lambda: c("H"), "width": _width, "height": _height, "stroked": _stroked, "image": _image}


def __getattr__(name: str) -> Column:
    """geometry.W and the like; made on use, as columns need a session."""
    if name in _NAMES:
        return _NAMES[name]()
    raise AttributeError(name)


def compose(m: list[Column], n: list[Column]) -> list[Column]:
    """The affine map m, then n: (a, b, c, d, e, f) each."""
    return [m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5]]


def apply(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def inverse(m: list[Column]) -> list[Column]:
    """Nulls where the determinant is as good as zero."""
    det = m[0] * m[3] - m[1] * m[2]
    d = F.when(F.abs(det) >= 1e-9, det)
    return [m[3] / d, -m[1] / d, -m[2] / d, m[0] / d, (m[2] * m[5] - m[3] * m[4]) / d, (m[1] * m[4] - m[0] * m[5]) / d]


def unit_box(m: list[Column]) -> dict[str, Column]:
    """The box of the unit square's _image()."""
    xs, ys = zip(*(apply(m, F.lit(x), F.lit(y)) for x in (0.0, 1.0) for y in (0.0, 1.0)))
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def in_edge_zone() -> Column:
    return (c("y0") >= c("H") * (1 - V.TOP_ZONE)) | (c("y1") <= c("H") * V.BASE_ZONE)


def ruler_side() -> Column:
    wide = (_width() >= V.RULER_WIDTH * c("W")) & (_height() <= V.RULER_HEIGHT)
    return F.when(wide & (c("y0") >= c("H") * V.RULER_TOP), "topo").when(wide & (c("y1") <= c("H") * V.RULER_BASE), "base")


def thin_vertical() -> Column:
    return (c("kind") == "P") & ~c("rot") & (_width() <= V.THIN) & (_height() >= V.BOX_REACH) & (_stroked() | (c("n_pts") <= 6))


def signature_bar() -> Column:
    return (_width() <= V.BAR_WIDTH) & (_height() >= c("H") * V.BAR_HEIGHT) & ((c("x0") >= c("W") * (1 - V.BAR_MARGIN)) | (c("x1") <= c("W") * V.BAR_MARGIN))


def page_image() -> Column:
    return _image() & (_width() >= c("W") * V.PAGE_IMAGE) & (_height() >= c("H") * V.PAGE_IMAGE)


def area_fraction() -> Column:
    return F.greatest(F.lit(0.0), _width() * _height()) / F.when(c("W") * c("H") == 0, 1.0).otherwise(c("W") * c("H"))


def region_candidate() -> Column:
    return _image() & ~c("rot") & (_width() > 0) & (_height() > 0) & (area_fraction() >= V.REGION_LEAST) & (area_fraction() < V.PAGE_IMAGE) & (c("y0") < c("H") * (1 - V.REGION_HEADER))


def zone() -> Column:
    return F.when(c("y0") >= c("H") * (1 - V.TOP_ZONE), "T").when(c("y1") <= c("H") * V.BASE_ZONE, "B").otherwise("M")


def _q(x: str, step: int) -> Column:
    return F.rint(c(x) / step).cast("int").cast("string")


def element_key(text_key: Column) -> Column:
    """What two elements on different pages have in common if they repeat."""
    return (
        F.when(c("kind") == "T", F.concat_ws("|", F.lit("T"), _q("y0", 4), text_key))
        .when(c("kind") == "P", F.concat_ws("|", F.lit("P"), _q("x0", 3), _q("y0", 3), _q("x1", 3), _q("y1", 3), c("n_pts").cast("string"), c("paint_op")))
        .when(_image(), F.concat_ws("|", c("kind"), _q("x0", 3), _q("x1", 3), zone()))
    )


def box_key() -> Column:
    return F.concat_ws(":", c("kind"), *(F.rint(c(x)).cast("int").cast("string") for x in ("x0", "y0", "x1", "y1")))


def scale(w: Column, h: Column) -> Column:
    return F.least(F.lit(V.DPI / 72), V.LONGEST_PIXELS / F.greatest(w, h))
