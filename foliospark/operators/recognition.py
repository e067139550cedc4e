"""Recognised words: filtering, normalisation, layout; blocks that aren't in the page's text yet.

Recognition itself is a provider: a callable that maps an iterator of pandas frames of tasks to frames of words.
None is built in, as no imaging library is needed by anything else here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

c = F.col
WORDS = "file_id bigint, page_id bigint, region int, word_ix int, text string, conf string, left double, top double, width double, height double"


def recognise(tasks: DataFrame, provider: Callable, parts: int) -> DataFrame:
    """Words of the tasks' images; tasks are dealt out evenly, each worker keeps its own provider."""
    return tasks.repartition(parts).mapInPandas(provider, WORDS)


def unpacked(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each word from parallel arrays text, conf, left, top, width, height."""
    names = ("text", "conf", "left", "top", "width", "height")
    return arrays.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("word_ix", "w")).select(*keys, "word_ix", "w.*")


def accepted(words: DataFrame) -> DataFrame:
    """Words that aren't empty and have the confidence; an unreadable confidence is -1."""
    d = words.withColumn("conf", _confidence(c("conf"))).where(c("conf") >= V.WORD_CONFIDENCE)
    return d.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where(c("text") != "").withColumn("text", T.fix_ordinals(c("text")))


def _confidence(conf: Column) -> Column:
    return F.coalesce(conf.try_cast("double"), F.lit(-1.0)).cast("int")


def layout(words: DataFrame, sx: float, sy: float, page_h: float, x0: float = 0.0, y0: float = 0.0, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Place, font size and horizontal scale of each accepted word in page points."""
    wide, high = F.greatest(c("width") * sx, F.lit(1.0)), F.greatest(c("height") * sy, F.lit(4.0))
    size = F.greatest(high / 0.72, F.lit(4.0))
    natural = F.greatest(T.helvetica_width(c("text")) * size, F.lit(0.1))
    return words.withColumns(
        {"x": x0 + (c("left") + dx) * sx, "y": y0 + page_h - (c("top") + dy + c("height")) * sy + high * 0.18, "font_size": size, "stretch": F.greatest(F.lit(1.0), F.least(F.lit(1000.0), wide / natural * 100.0))}
    )


def blocks(words: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region, text, conf): words of each region in order with their mean confidence, without regions whose
    words the page's text already has. texts: (keys, page_text)."""
    b = words.groupBy(*keys, "region").agg(F.sort_array(F.collect_list(F.struct("word_ix", "text"))).alias("w"), F.avg("conf").alias("conf"))
    b = b.select(*keys, "region", F.array_join("w.text", " ").alias("text"), "conf")
    # the page's words are found once for a page, not for each region
    t = texts.select(*keys, T.long_words(c("page_text")).alias("_page"))
    return b.join(t, keys, "left").where(~T.contained_words(T.long_words(c("text")), F.coalesce("_page", F.array().cast("array<string>")))).drop("_page")


def page_blocks(pages: DataFrame, keys: list[str], regions: str, page_text: str) -> DataFrame:
    """(keys, region, text, conf): what `blocks` gives, of pages that have their regions in one row, so that nothing is shuffled.
    regions: an array of arrays of words (text, conf), both in order; region is the place of the first kind, from 0."""
    ok = lambda r: F.filter(r, lambda w: _confidence(w["conf"]) >= V.WORD_CONFIDENCE)
    word = lambda w: F.struct(T.strip(F.coalesce(w["text"], F.lit(""))).alias("text"), _confidence(w["conf"]).alias("conf"))
    some = lambda r: F.filter(F.transform(ok(r), word), lambda w: w["text"] != "")
    mean = lambda w: F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + x["conf"]) / F.size(w)
    # signs that touch letters do so within a word, so that a block's text is mended as one
    text = lambda w: _once(F.array_join(w["text"], " "), T.fix_ordinals)
    named = lambda i, t, m: F.struct(i.alias("region"), t.alias("text"), m.alias("conf"), T.long_words(t).alias("_own"))
    block = lambda r, i: _once(some(r), lambda w: F.when(F.size(w) > 0, _once(text(w), lambda t: named(i, t, mean(w)))))
    found = F.filter(F.transform(regions, block), lambda b: b.isNotNull())
    # blocks are held against what the page lacks, which is found once and is short
    known = lambda own, lacks: F.when(F.size(own) == 0, False).otherwise((F.size(own) - F.size(F.array_intersect(own, lacks))) / F.size(own) >= V.CONTAINED)
    lacking = lambda blocks: F.array_except(F.flatten(blocks["_own"]), T.long_words(c(page_text)))
    new = _once(found, lambda blocks: _once(lacking(blocks), lambda lacks: F.filter(blocks, lambda b: ~known(b["_own"], lacks))))
    return pages.select(*keys, F.inline(new)).drop("_own")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x made once for a row, however often f reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))
