"""Page classes, recognition decisions and origin labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import values as V
from .boilerplate import PAGE

c = F.col


def density(text: Column, ink: Column) -> Column:
    """Visible characters for 1000 inked pixels; infinite where there is no ink."""
    return F.when(F.coalesce(ink, F.lit(0)) <= 0, F.lit(float("inf"))).otherwise(F.length(T.solid(text)) / ink * 1000.0)


def page_class(text: Column, scan: Column) -> Column:
    ok = T.usable(text)
    long = F.length(T.strip(F.coalesce(text, F.lit("")))) >= V.TEXT_LEAST
    return F.when(ok & ~scan, V.NATIVE).when(ok, V.HYBRID).when(long, V.CORRUPT).otherwise(V.IMAGE_ONLY)


def deficient(kind: Column, dense: Column, least: float = V.DENSITY_LEAST) -> Column:
    return (kind == V.HYBRID) & (dense < least)


def decision(kind: Column, poor: Column, regions: Column, policy: str = "auto") -> Column:
    """pular, regioes:N or pagina; policy is auto, nunca or sempre."""
    some = F.when(regions > 0, F.concat(F.lit("regioes:"), regions.cast("string")))
    hybrid = {"sempre": F.lit("pagina"), "nunca": F.coalesce(some, F.lit("pular")), "auto": F.coalesce(some, F.when(poor, "regioes:1"), F.lit("pular"))}[policy]
    return F.when(kind == V.NATIVE, F.coalesce(some, F.lit("pular"))).when(kind == V.HYBRID, hybrid).otherwise("pagina")


def origin(kind: Column, poor: Column, policy: str = "auto") -> Column:
    again = {"sempre": F.lit(True), "auto": poor, "nunca": F.lit(False)}[policy]
    o = V.ORIGINS
    return F.when(kind == V.NATIVE, o["native"]).when((kind == V.HYBRID) & ~again, F.when(poor, o["incomplete"]).otherwise(o["reused"])).otherwise(o["ocr"])


def planned_for_ocr(text: Column, dense: Column, kind: Column, least: float = V.DENSITY_LEAST, long: int = 600) -> Column:
    """The planner's cascade, cheapest test first."""
    poor = (kind == V.HYBRID) & (dense < least)
    return F.when(~T.usable(text), True).when(F.length(T.strip(text)) > long, False).when(dense >= least, False).otherwise(poor)


def region_candidates(elements: DataFrame) -> DataFrame:
    """Images worth recognising, with their crop in pixels (origin at the top) at the page's scale."""
    s = G.scale(G.W, G.H)
    pw, ph = F.floor(G.W * s), F.floor(G.H * s)
    d = elements.where(G.region_candidate()).withColumns(
        {
            "cx0": F.greatest(F.lit(0), (c("x0") * s).cast("int")), "cx1": F.least(pw, F.ceil(c("x1") * s)).cast("int"),
            "cy0": F.greatest(F.lit(0), ((G.H - c("y1")) * s).cast("int")), "cy1": F.least(ph, F.ceil((G.H - c("y0")) * s)).cast("int"),
        }
    )
    return d.where((c("cx1") - c("cx0") >= V.CROP_LEAST) & (c("cy1") - c("cy0") >= V.CROP_LEAST))


def handwritten(texts: DataFrame, elements: DataFrame) -> DataFrame:
    """(file, page, handwritten): hardly any text and a large upright image. texts: (file, page, text)."""
    large = elements.where(G.image & ~c("rot") & (G.width * G.height / F.when(G.W * G.H == 0, 1.0).otherwise(G.W * G.H) >= V.HAND_IMAGE)).select(*PAGE).distinct().withColumn("_i", F.lit(True))
    few = F.length(T.strip(F.coalesce(c("text"), F.lit("")))) < V.HAND_TEXT
    return texts.join(large, PAGE, "left").select(*PAGE, (few & F.coalesce("_i", F.lit(False))).alias("handwritten"))
