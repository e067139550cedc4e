"""Repetition across pages: boilerplate keys, rulers, cuts and bands. Elements have file_id, page_id, el_ix, kind,
the box, rot, n_pts, paint_op, key, W and H; pages of one size, in whole points, in a file are a group (W, H)."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import values as V
from . import pagewise as P

GROUP = ["file_id", "W", "H"]
PAGE = ["file_id", "page_id"]
c = F.col


def whole_points(f):
    """Page sizes are rounded first (half to even), so that pages scanned a little apart are one group."""

    @functools.wraps(f)
    def run(elements: DataFrame, *args, **more) -> DataFrame:
        return f(elements.withColumns({"W": F.rint("W"), "H": F.rint("H")}), *args, **more)

    return run


def threshold(pages: Column, fraction: float = V.REPEAT_FRACTION) -> Column:
    return F.greatest(F.lit(V.REPEAT_LEAST), F.ceil(pages * F.lit(fraction)))


@whole_points
def group_sizes(elements: DataFrame) -> DataFrame:
    return elements.groupBy(*GROUP).agg(F.countDistinct("page_id").alias("n_pages"))


def can_repeat() -> Column:
    """Elements whose keys are compared."""
    return ~c("rot") & F.when(c("kind") == "P", c("y1") <= 0.10 * G.H).otherwise(G.in_edge_zone())


@whole_points
def repeated_keys(elements: DataFrame, fraction: float = V.REPEAT_FRACTION) -> DataFrame:
    """(group, key, kind, pages, y0): keys on enough distinct pages of their group. Texts and images count in the
    edge zones only, paths at the foot; rotated elements don't. y0 is that of the last occurrence."""
    n = elements.where(can_repeat()).groupBy(*GROUP, "key", "kind").agg(F.countDistinct("page_id").alias("pages"), F.max_by("y0", F.struct("page_id", "el_ix")).alias("y0"))
    return n.join(group_sizes(elements), GROUP).where(c("pages") >= threshold(c("n_pages"), fraction)).drop("n_pages")


def repeated_facts(keys: DataFrame, pages: DataFrame, fraction: float = V.REPEAT_FRACTION) -> DataFrame:
    """repeated_keys of rows (page, W, H, kind, key, y0) with each key once a page, y0 that of its last place on it."""
    n = keys.groupBy(*GROUP, "key", "kind").agg(F.count(F.lit(1)).alias("pages"), F.max("page_id").alias("page_id"))
    n = n.join(group_sizes(pages), GROUP).where(c("pages") >= threshold(c("n_pages"), fraction)).drop("n_pages")
    return n.join(keys.select(*GROUP, "key", "kind", "page_id", "y0"), [*GROUP, "key", "kind", "page_id"]).drop("page_id")


def repeated_values(rows: DataFrame, group: list[str], page: str, value: str, fraction: float = V.REPEAT_FRACTION) -> DataFrame:
    """The same rule for any value, such as the lines of documents."""
    sizes = rows.groupBy(*group).agg(F.countDistinct(page).alias("n_pages"))
    n = rows.groupBy(*group, value).agg(F.countDistinct(page).alias("pages"))
    return n.join(sizes, group).where(c("pages") >= threshold(c("n_pages"), fraction)).drop("n_pages")


@whole_points
def rulers(elements: DataFrame) -> DataFrame:
    """(file, page, el_ix, W, H, box, side): wide thin rules at head or foot that aren't the edge of a box, as not both ends have a
    thin vertical there."""
    d = elements.where((c("kind") == "P") & ~c("rot")).withColumn("side", G.ruler_side()).where(F.col("side").isNotNull() | G.thin_vertical())
    d = d.select(*PAGE, *({"el_ix"} & set(d.columns)), "W", "H", *(c(x).cast("double").alias(x) for x in _BOX), "side")
    return P.by_page(d, PAGE, open_rulers, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema))


_BOX = ("x0", "y0", "x1", "y1")


def open_rulers(table: pa.Table) -> pa.Table:
    """Of whole pages' rulers (side isn't null) and thin verticals, the rulers that lack a vertical at an end."""
    page, ruler = P.pages_of(table, PAGE), table.column("side").is_valid().to_numpy()
    x0, y0, x1, y1 = P.numbers(table, *_BOX)
    v = page[~ruler], ((x0 + x1) / 2)[~ruler], y0[~ruler], y1[~ruler]
    y = ((y0 + y1) / 2)[ruler]
    both = np.logical_and(*(P.beside(page[ruler], x[ruler], y, *v, V.BOX_TOL, V.BOX_REACH) for x in (x0, x1)))
    return table.take(pa.array(np.flatnonzero(ruler)[~both]))


@whole_points
def page_cuts(elements: DataFrame, fraction: float = V.REPEAT_FRACTION, rules: DataFrame | None = None) -> DataFrame:
    """(file, page, cut_top, cut_base) from rulers at a height that enough pages of the group share."""
    # which elements they are isn't asked, so those of a page need no numbers here
    r = (rulers(elements.drop("el_ix")) if rules is None else rules).withColumn("bucket", F.rint(c("y0") / 6))
    n = r.groupBy(*GROUP, "side", "bucket").agg(F.countDistinct("page_id").alias("pages")).join(group_sizes(elements), GROUP)
    n = n.where(c("pages") >= threshold(c("n_pages"), fraction)).select(*GROUP, "side", "bucket")
    r = r.join(n, [*GROUP, "side", "bucket"], "left_semi")
    return r.groupBy(*PAGE).agg(F.min(F.when(c("side") == "topo", c("y0"))).alias("cut_top"), F.max(F.when(c("side") == "base", c("y1"))).alias("cut_base"))


@whole_points
def base_bands(elements: DataFrame, fraction: float = V.REPEAT_FRACTION, keys: DataFrame | None = None) -> DataFrame:
    """(group, lo, hi): heights at the foot where several repeated paths lie close together."""
    y = (repeated_keys(elements, fraction) if keys is None else keys).where("kind = 'P'")
    w = Win.partitionBy(*GROUP).orderBy("y0", "key")
    y = y.withColumn("new", F.coalesce((c("y0") - F.lag("y0").over(w) > V.BAND_GAP).cast("int"), F.lit(0)))
    y = y.withColumn("band", F.sum("new").over(w))
    return y.groupBy(*GROUP, "band").agg(F.min("y0").alias("a"), F.max("y0").alias("z"), F.count(F.lit(1)).alias("n")).where(c("n") >= V.BAND_LEAST).select(*GROUP, (c("a") - V.BAND_LOW).alias("lo"), (c("z") + V.BAND_HIGH).alias("hi"))


def in_top_line() -> Column:
    """Small paths that may be of a line in the top zone."""
    return (c("kind") == "P") & ~c("rot") & (c("y0") >= G.H * (1 - V.TOP_ZONE)) & (G.height <= V.CLUSTER_HEIGHT)


def with_cluster_key(lines: DataFrame) -> DataFrame:
    q = lambda x: F.rint(c(x) / 4).cast("int").cast("string")
    return lines.withColumn("key", F.concat_ws("|", F.lit("PL"), q("y"), q("x0"), q("x1"), c("n").cast("string"), (c("pts") % V.CLUSTER_MOD).cast("string")))


@whole_points
def top_clusters(elements: DataFrame) -> DataFrame:
    """Lines of small paths in the top zone. A path joins the line whose first member is within the gap; a fold over
    each page's paths, from the top down."""
    p = elements.where(in_top_line())
    row = F.struct(c("el_ix").cast("int").alias("el_ix"), "y0", "x0", "x1", c("n_pts").cast("bigint").alias("n_pts"))
    p = p.groupBy(*PAGE, "W", "H").agg(F.collect_list(row).alias("m"), F.sort_array(F.collect_set("y0"), asc=False).alias("ys"))
    # the fold keeps where lines start alone, a few values, however many paths a page has
    starts = F.aggregate("ys", F.array().cast("array<double>"), lambda acc, y: F.when(F.coalesce(F.abs(F.try_element_at(acc, F.lit(-1)) - y) <= V.CLUSTER_GAP, F.lit(False)), acc).otherwise(F.concat(acc, F.array(y))))
    place = lambda e: F.size(F.filter("starts", lambda s: s >= e["y0"]))
    placed = F.transform("m", lambda e: F.struct((place(e) - 1).alias("line"), F.element_at("starts", place(e)).alias("y"), *(e[x].alias(x) for x in ("el_ix", "x0", "x1", "n_pts"))))
    m = p.withColumn("starts", starts).select(*PAGE, "W", "H", F.explode(placed).alias("e")).select(*PAGE, "W", "H", "e.*")
    line = m.groupBy(*PAGE, "W", "H", "line").agg(F.min("y").alias("y"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n"), F.sum("n_pts").alias("pts"), F.sort_array(F.collect_list("el_ix")).alias("members")).where(c("n") >= V.CLUSTER_LEAST)
    return with_cluster_key(line)


@whole_points
def repeated_clusters(elements: DataFrame, fraction: float = V.REPEAT_FRACTION, clusters: DataFrame | None = None) -> DataFrame:
    """Lines of top_clusters whose key repeats on enough pages of the group."""
    lines = top_clusters(elements) if clusters is None else clusters
    n = lines.groupBy(*GROUP, "key").agg(F.countDistinct("page_id").alias("pages")).join(group_sizes(elements), GROUP)
    return lines.join(n.where(c("pages") >= threshold(c("n_pages"), fraction)), [*GROUP, "key"], "left_semi")


@whole_points
def own_page_cuts(elements: DataFrame, rules: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """(file, page, cut_top, cut_base) from a page's own rulers; the top cut goes down over header lines that follow closely."""
    r = (rulers(elements) if rules is None else rules).groupBy(*PAGE, "W", "H").agg(F.min(F.when(c("side") == "topo", c("y0"))).alias("top"), F.max(F.when(c("side") == "base", c("y1"))).alias("base"))
    lines = (top_clusters(elements) if clusters is None else clusters).select(*PAGE, c("y").alias("ly"), c("line"))
    below = r.join(lines, PAGE).where("ly < top")
    w = Win.partitionBy(*PAGE).orderBy(F.desc("ly"), "line")
    below = below.withColumn("far", (F.coalesce(F.lag("ly").over(w), c("top")) - c("ly") > V.HEADER_GAP).cast("int"))
    below = below.withColumn("broken", F.max("far").over(w)).where("broken = 0").groupBy(*PAGE).agg((F.min("ly") - V.HEADER_DROP).alias("low"))
    return r.join(below, PAGE, "left").select(*PAGE, F.coalesce("low", "top").alias("cut_top"), c("base").alias("cut_base"))


@whole_points
def short_document_cuts(elements: DataFrame, fraction: float = V.REPEAT_FRACTION, rules: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """Cuts of all pages: in files of few pages own rulers count too, and where there is none a fixed strip."""
    if rules is None or clusters is None:  # both come from few of the elements, which are numbered once
        part = (c("kind") == "P") & ~c("rot") & (G.ruler_side().isNotNull() | G.thin_vertical() | ((c("y0") >= G.H * (1 - V.TOP_ZONE)) & (G.height <= V.CLUSTER_HEIGHT)))
        framing = elements.where(part).select(*PAGE, "el_ix", "kind", "rot", *_BOX, "n_pts", "paint_op", "W", "H").persist()
        rules, clusters = rules or rulers(framing).persist(), clusters or top_clusters(framing)
    pages = elements.select(*PAGE, "W", "H").distinct()
    short = pages.groupBy("file_id").agg((F.countDistinct("page_id") <= V.SHORT_DOC).alias("short"))
    own = own_page_cuts(elements, rules, clusters).select(*PAGE, c("cut_top").alias("ot"), c("cut_base").alias("ob"))
    d = pages.join(short, "file_id").join(page_cuts(elements, fraction, rules), PAGE, "left").join(own, PAGE, "left")
    top = F.when(c("short"), F.coalesce(F.least("cut_top", "ot"), G.H * (1 - V.SHORT_TOP))).otherwise(c("cut_top"))
    base = F.when(c("short"), F.coalesce(F.greatest("cut_base", "ob"), G.H * V.SHORT_BASE)).otherwise(c("cut_base"))
    return d.select(*PAGE, top.alias("cut_top"), base.alias("cut_base")).where("cut_top is not null or cut_base is not null")
