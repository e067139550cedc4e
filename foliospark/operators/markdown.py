"""Markdown of cleaned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

c = F.col
_BLOCKS = "array<struct<text:string,conf:double>>"


def header(name: Column, sample: Column, total: Column) -> Column:
    """Title and metadata: case number and unit if the sample (the first two pages) has them, and the page count."""
    case = F.nullif(F.regexp_extract(sample, V.CASE_NUMBER, 0), F.lit(""))
    unit = F.nullif(T.strip(F.regexp_replace(F.regexp_extract(sample, V.UNIT_LINE, 0), r"(?U)\s+", " ")), F.lit(""))
    parts = F.concat_ws(" · ", F.concat(F.lit("**Processo:** "), case), F.concat(F.lit("**Unidade:** "), unit), F.concat(F.lit("**Total de páginas:** "), total.cast("string")))
    return F.concat(F.lit("# "), F.regexp_replace(name, r"_parte\d+$", ""), F.lit("\n\n"), parts)


def body(text: Column, label: Column, has_blocks: Column, handwritten: Column, blocks: Column | None = None) -> Column:
    """The page's text without what is said elsewhere: its label at the end, and before that the texts of the blocks."""
    t = T.strip(text)
    t = F.coalesce(T.without_suffix(t, label), t)
    if blocks is not None:
        t = F.aggregate(F.reverse(F.coalesce(blocks, F.array().cast(_BLOCKS))), t, lambda acc, b: F.coalesce(T.without_suffix(acc, b["text"]), acc))
    bad = ((t == "") & ~has_blocks) | ((t != "") & ~T.usable(t) & ~has_blocks & ~handwritten)
    return F.when(bad, V.NO_TEXT).otherwise(T.mark_headings(t))


def quoted(page: Column, blocks: Column) -> Column:
    """Quotes of recognised blocks (array of text, conf), with a note under low confidence."""
    lines = lambda b: F.transform(F.filter(F.split(b["text"], "\n"), lambda x: T.strip(x) != ""), lambda x: F.concat(F.lit("> "), x))
    none = F.array().cast("array<string>")
    one = lambda b: F.concat(F.array(F.lit(""), F.concat(F.lit("> **[Texto extraído de imagem na página "), page.cast("string"), F.lit("]**"))), lines(b), F.when(b["conf"] < V.BLOCK_CONFIDENCE, F.array(F.lit(V.LOW_NOTE))).otherwise(none))
    return F.flatten(F.transform(F.coalesce(blocks, F.array().cast(_BLOCKS)), one))


def section(page: Column, total: Column, text: Column, origin: Column, handwritten: Column, blocks: Column, tables: Column) -> Column:
    """One page's section."""
    none = F.array().cast("array<string>")
    hand = F.coalesce(handwritten, F.lit(False))
    some = F.coalesce(F.size(blocks) > 0, F.lit(False))
    head = F.array(F.concat(F.lit("## Página "), page.cast("string"), F.lit(" de "), total.cast("string")), F.lit(""))
    return F.array_join(
        F.concat(
            head,
            F.when(origin.isNotNull(), F.array(F.concat(F.lit("_["), origin, F.lit("]_")), F.lit(""))).otherwise(none),
            F.when(hand, F.array(F.lit(V.HAND_BANNER), F.lit(""))).otherwise(none),
            F.array(body(text, T.page_label(page, total), some, hand, blocks)),
            F.flatten(F.transform(F.coalesce(tables, none), lambda t: F.array(F.lit(""), t))),
            quoted(page, blocks),
        ),
        "\n",
    )


def document(sections: DataFrame, key: str, page: str, text: str, head: DataFrame) -> DataFrame:
    """(key, markdown): header and sections of a file in page order. A file is one output, as it is read as one."""
    s = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(c(page).alias("p"), c(text).alias("t")))).alias("s"))
    return s.join(head, key).select(key, F.concat(c("header"), F.lit("\n\n"), F.array_join("s.t", "\n\n"), F.lit("\n")).alias("markdown"))
