"""From pages and recognised words to Markdown files: classes, decisions, blocks, sections, documents.

Pages are numbered through their whole file (page_no from 1, see `numbering`). What recognition says of a page is joined by that
number, whichever part the page is in, and parts keep the numbers of the whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import markdown as M
from . import pages as P
from . import recognition as O

c = F.col
#: The region of words that were read from a whole page.
WHOLE_PAGE = -1
_BLOCKS = "array<struct<text:string,conf:double>>"


def decided(pages: DataFrame, policy: str = "auto", least: float = V.DENSITY_LEAST) -> DataFrame:
    """Adds class, density, deficient, decision, origin and handwritten. pages: text, scan (a full-page image), ink, regions (images
    worth recognising) and large_image (an upright image of a quarter of the page)."""
    d = pages.withColumns({"class": P.page_class(c("text"), c("scan")), "density": P.density(F.coalesce("text", F.lit("")), c("ink"))})
    d = d.withColumn("deficient", P.deficient(c("class"), c("density"), least))
    few = F.length(T.strip(F.coalesce("text", F.lit("")))) < V.HAND_TEXT
    return d.withColumns({"decision": P.decision(c("class"), c("deficient"), c("regions"), policy), "origin": P.origin(c("class"), c("deficient"), policy), "handwritten": few & F.coalesce("large_image", F.lit(False))})


def page_info(decided_pages: DataFrame, words: DataFrame, file: str) -> DataFrame:
    """(file, page_no, blocks, read): what was recognised on each page that has anything, in the order of regions.

    words: file, page_no, region, word_ix, text, conf. Words of the whole page count where the decision is to read it (region
    WHOLE_PAGE), those of regions where it is to read regions. A region whose words the page's text has already gives nothing.
    blocks are quoted; read is text that joins the page's own, of a whole page, or of the scan under a deficient layer when the
    page has no other image."""
    asked = decided_pages.select(c(file).alias("_f"), c("page_no").alias("_p"), c("text").alias("page_text"), "decision", (c("deficient") & (c("regions") == 0)).alias("_scan"))
    keys = ["_f", "_p"]
    w = O.accepted(words.select(c(file).alias("_f"), c("page_no").alias("_p"), "region", "word_ix", "text", "conf"))
    b = w.groupBy(*keys, "region").agg(F.sort_array(F.collect_list(F.struct("word_ix", "text"))).alias("w"), F.avg("conf").alias("conf"))
    b = b.select(*keys, "region", F.array_join("w.text", " ").alias("text"), "conf")
    b = b.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("region", "text", "conf"))).alias("b"))  # one page's
    d = asked.join(b, keys)
    whole = F.filter("b", lambda x: x["region"] == WHOLE_PAGE)
    page_words = T.long_words(F.coalesce("page_text", F.lit("")))
    new = F.filter("b", lambda x: (x["region"] != WHOLE_PAGE) & ~T.contained_words(T.long_words(x["text"]), c("_own")))
    said = F.transform("_new", lambda x: F.struct(x["text"].alias("text"), x["conf"].alias("conf"))).cast(_BLOCKS)
    none = F.array().cast(_BLOCKS)
    regions = c("decision").startswith("regioes")
    d = d.withColumn("_own", page_words).withColumn("_new", F.when(regions, new).when(c("decision") == "pagina", whole))
    read = F.when((c("decision") == "pagina") | c("_scan"), F.array_join("_new.text", "\n"))
    return d.select(c("_f").alias(file), c("_p").alias("page_no"), F.when(regions & ~c("_scan"), said).otherwise(none).alias("blocks"), F.when(read != "", read).alias("read"))


def final_text(d: DataFrame) -> DataFrame:
    """Puts what was read into `text`: in place of a corrupt layer (or of one that was to be read again), else after it."""
    replaced = (c("decision") == "pagina") & c("class").isin(V.CORRUPT, V.HYBRID)
    own = F.when(replaced, F.lit("")).otherwise(T.strip(F.coalesce("text", F.lit(""))))
    return d.withColumn("text", F.concat_ws("\n", F.when(own != "", own), c("read")))


def sections(pages: DataFrame, info: DataFrame, tables: DataFrame, file: str, policy: str = "auto", least: float = V.DENSITY_LEAST) -> DataFrame:
    """(file, page_no, total, class, decision, text, section): pages with what was recognised on them, as Markdown.
    tables: file, page_no, zone, markdown."""
    t = tables.groupBy(c(file).alias("_f"), c("page_no").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("zone", "markdown"))).alias("_t"))
    i = info.select(c(file).alias("_fi"), c("page_no").alias("_pi"), "blocks", "read")
    d = decided(pages, policy, least)
    d = d.join(i, d[file].eqNullSafe(i["_fi"]) & (d["page_no"] == i["_pi"]), "left").join(t, d[file].eqNullSafe(t["_f"]) & (d["page_no"] == t["_p"]), "left")
    section = M.section(c("page_no"), c("total"), c("text"), c("origin"), c("handwritten"), c("blocks"), c("_t.markdown"))
    return final_text(d).select(file, "page_no", "total", "class", "decision", "text", section.alias("section"))


def documents(done: DataFrame, placed: DataFrame, file: str) -> DataFrame:
    """(file, part_no, first_page, n_pages, markdown): one Markdown a part. done: what `sections` gives; placed: file, page_no,
    part_no. A file of one part keeps its name, others get _parteNN, which the title leaves out. The metadata come from
    the first two pages of the part. Parts are of bounded size, so one is one row."""
    p = placed.select(c(file).alias("_f"), c("page_no").alias("_p"), "part_no")
    d = done.join(p, done[file].eqNullSafe(p["_f"]) & (done["page_no"] == p["_p"])).select(file, "part_no", "page_no", "total", "text", "section")
    own = F.sort_array(F.collect_list(F.struct("page_no", "section")))
    first = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), 1, 2), lambda x: x["text"]), "\n")
    g = d.groupBy(file, "part_no", "total").agg(own.alias("s"), first.alias("sample"), F.min("page_no").alias("first_page"), F.count(F.lit(1)).cast("int").alias("n_pages"))
    head = M.header(F.concat(F.coalesce(c(file).cast("string"), F.lit("")), F.format_string("_parte%02d", c("part_no"))), c("sample"), c("total"))
    return g.select(file, "part_no", "first_page", "n_pages", F.concat(head, F.lit("\n\n"), F.array_join("s.section", "\n\n"), F.lit("\n")).alias("markdown"))
