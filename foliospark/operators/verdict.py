"""Which elements go, and why: an ordered chain of rules, protections, and a rollback where a page would lose too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import values as V
from . import boilerplate as B
from . import framing as R
from .boilerplate import GROUP, PAGE

c = F.col


def context(elements: DataFrame, fraction: float = V.REPEAT_FRACTION) -> DataFrame:
    """Elements with all that the rules ask of their page and file."""
    all_ = R.framed(elements).persist()
    pages, rules, clusters, keys = (d.persist() for d in R.facts(all_, fraction))
    d = all_.where("fact is null").select(*elements.columns, "in_table", "line")
    lines = B.repeated_clusters(pages, fraction, clusters).groupBy(*PAGE).agg(F.collect_list(F.struct("line", "x0", "x1", "y")).alias("lines"))
    bands = B.base_bands(pages, fraction, keys).groupBy("file_id").agg(F.collect_list(F.struct("W", "H", "lo", "hi")).alias("bands"))
    known = pages.groupBy(*PAGE).agg(*(F.max(x).alias(x) for x in ("sig_x0", "sig_x1", "strips")))
    known = known.join(B.short_document_cuts(pages, fraction, rules, clusters), PAGE, "left").join(lines, PAGE, "left").join(bands, "file_id", "left")
    repeats = keys.select(*GROUP, "key").distinct().withColumn("repeats", F.lit(True))
    d = d.join(known, PAGE, "left").join(repeats, [*GROUP, "key"], "left")
    beside = lambda s: (s["x0"] - 12 <= c("x0")) & (c("x1") <= s["x1"] + 12) & (F.abs(c("y0") - s["y"]) <= 7)
    found = {
        "in_line": c("line").isNotNull() & F.exists("lines", lambda s: s["line"] == c("line")),
        "orphan": (c("kind") == "P") & (c("y0") >= G.H * (1 - V.TOP_ZONE)) & F.exists("lines", beside),
        "in_band": (c("kind") == "P") & (c("y1") <= G.H * V.BASE_ZONE) & F.exists("bands", lambda b: (b["W"] == c("W")) & (b["H"] == c("H")) & c("y0").between(b["lo"], b["hi"])),
        "in_table": c("in_table"),
        "repeats": c("repeats"),
    }
    return d.withColumns({name: F.coalesce(x, F.lit(False)) for name, x in found.items()}).drop("line", "lines", "bands")


def raw_reason() -> Column:
    """The first rule that fits, over the columns of `context`."""
    text, path = c("kind") == "T", c("kind") == "P"
    y = (c("y0") + c("y1")) / 2
    scan = G.page_image() | (G.image & ~c("rot") & (G.width >= G.W * V.PAGE_IMAGE) & F.coalesce("strips", F.lit(False)))
    top, base = c("y1") >= c("cut_top") - 2, c("y0") <= c("cut_base") + 2
    return (
        F.when(c("in_line"), "cluster_topo")
        .when(c("rot"), "assinatura_rotacionada")
        .when(path & (c("x0") >= c("sig_x0")) & (c("x1") <= c("sig_x1")), "assinatura_vetorial")
        .when(text & c("repeats"), "boiler_texto")
        .when(text & (c("y0") >= c("cut_top") - 1), "corte_topo")
        .when(text & (c("y1") <= c("cut_base") + 1), "corte_base")
        .when(text & (c("y0") >= G.H - V.TOP_STRIP), "faixa_fixa_topo_txt")
        .when(text & (c("y1") <= V.BASE_STRIP), "faixa_fixa_base_txt")
        .when(text & (c("y0") >= G.H - V.CORNER_Y) & (c("x0") >= V.CORNER_X), "canto_direito")
        .when(text, None)
        .when(c("orphan"), "glifo_orfao")
        .when(scan, None)
        .when(path & G.stroked & (c("x1") <= V.STAMP_X) & (c("y0") >= G.H - V.STAMP_Y), "carimbo_copia")
        .when(G.image & c("repeats"), "boiler_imagem")
        .when(path & c("repeats"), "boiler_path")
        .when(top & (y >= c("cut_top") - 2), "corte_topo")
        .when(top & G.signature_bar(), "tarja_margem")
        .when(base & (y <= c("cut_base") + 2), "corte_base")
        .when(base & G.signature_bar(), "tarja_margem")
        .when(c("in_band"), "faixa_base_vetorial")
    )


@B.whole_points
def reasons(elements: DataFrame, fraction: float = V.REPEAT_FRACTION) -> DataFrame:
    """Elements with `reason`: calibrated reasons hold in tables, and text that shows nothing never goes."""
    d = context(elements, fraction).withColumn("reason", raw_reason())
    keep = (c("in_table") & ~c("reason").isin(*V.CALIBRATED)) | ((c("kind") == "T") & (c("n_chars") == 0))
    return d.withColumn("reason", F.when(~keep, c("reason")))


def page_loss(judged: DataFrame) -> DataFrame:
    """Per page what the heuristic reasons take, and whether that is too much."""
    soft = c("reason").isNotNull() & ~c("reason").isin(*V.CALIBRATED)
    text = c("kind") == "T"
    d = judged.groupBy(*PAGE, "W", "H").agg(
        F.sum(F.when(text, c("n_chars")).otherwise(0)).alias("chars"),
        F.sum(F.when(text & soft, c("n_chars")).otherwise(0)).alias("chars_lost"),
        F.sum(F.when(G.image & soft, F.greatest(F.lit(0.0), G.width * G.height)).otherwise(0.0)).alias("area_lost"),
    )
    text_loss = F.when(c("chars") > 0, c("chars_lost") / c("chars")).otherwise(0.0)
    area_loss = c("area_lost") / F.when(G.W * G.H == 0, 1.0).otherwise(G.W * G.H)
    return d.withColumns({"text_loss": text_loss, "area_loss": area_loss}).withColumn("rolled_back", ((c("chars") >= V.LOSS_LEAST_CHARS) & (c("text_loss") > V.LOSS_TEXT)) | (c("area_loss") > V.LOSS_IMAGE))


def verdicts(elements: DataFrame, fraction: float = V.REPEAT_FRACTION) -> DataFrame:
    """Elements with the final `reason`: none on pages that are rolled back."""
    judged = reasons(elements, fraction).persist()
    d = judged.join(page_loss(judged).select(*PAGE, "rolled_back"), PAGE)
    return d.withColumn("reason", F.when(~c("rolled_back"), c("reason")))
