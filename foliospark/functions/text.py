"""Text functions over columns: quality, normalisation, headings, tables, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def solid(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, r"(?U)\s", "")


#: All characters of (?U)\\s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def alnum_fraction(text: Column) -> Column:
    n = F.length(solid(text))
    return F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / n)


def junk_fraction(text: Column) -> Column:
    """Control, private-use and unassigned characters among those that aren't white space."""
    n = F.length(solid(text))
    return F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(solid(text), r"[^\x00-\x1f\p{Co}\p{Cn}]", "")) / n)


def usable(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return (F.length(t) >= V.TEXT_LEAST) & (junk_fraction(t) <= V.JUNK_MOST) & (alnum_fraction(t) >= V.ALNUM_LEAST)


def long_words(text: Column) -> Column:
    """Distinct runs of four or more word characters, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w{4,})"), F.lit(1)))


def plain_words(text: Column) -> Column:
    """Distinct space-separated words of four or more letters and digits only, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w.rlike(r"^[\p{L}\p{N}]{4,}$")))


def contained(small: Column, large: Column, least: float = V.CONTAINED) -> Column:
    return contained_words(long_words(small), long_words(large), least)


def contained_words(small: Column, large: Column, least: float = V.CONTAINED) -> Column:
    """The same of arrays of distinct words."""
    return F.when(F.size(small) == 0, False).otherwise(F.size(F.array_intersect(small, large)) / F.size(small) >= least)


def fix_ordinals(text: Column) -> Column:
    """Ordinal signs that touch a letter are a and o that were misread; those at digits stay."""
    fixed = text
    for sign, letter in (("ª", "a"), ("º", "o")):
        # twice each, as a sign becomes a letter that the next sign may touch
        for found, put in ((f"([A-Za-zÀ-ÿ]){sign}", f"$1{letter}"), (f"{sign}([A-Za-zÀ-ÿ])", f"{letter}$1")):
            fixed = F.regexp_replace(F.regexp_replace(fixed, found, put), found, put)
    # few texts have one, and to look for it takes no regular expression
    return F.when(F.contains(text, F.lit("ª")) | F.contains(text, F.lit("º")), fixed).otherwise(text)


def heading(line: Column) -> Column:
    """The line (spaces collapsed) if it opens a document part, else null."""
    s = strip(F.regexp_replace(F.coalesce(line, F.lit("")), r"(?U)\s+", " "))
    starts = s.rlike(f"^(?:{'|'.join(V.HEADINGS)})(?:$|\\P{{L}})")
    return F.when((F.length(s) > 0) & (F.length(s) <= V.HEADING_MOST) & (s == F.upper(s)) & starts, s)


def mark_headings(text: Column) -> Column:
    """A rule and a heading line for each line that opens a part, after a blank line unless one is there."""
    none = F.array().cast("array<string>")
    blank = lambda acc: F.when((F.size(acc) > 0) & (strip(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) != ""), F.array(F.lit(""))).otherwise(none)
    part = lambda line: F.array(F.lit("---"), F.lit(""), F.concat(F.lit("### "), heading(line)), F.lit(""))
    step = lambda acc, line: F.concat(acc, F.when(heading(line).isNull(), F.array(line)).otherwise(F.concat(blank(acc), part(line))))
    return F.array_join(F.aggregate(F.split(text, "\n"), F.array().cast("array<string>"), step), "\n")


def table_md(rows: Column) -> Column:
    """Markdown of an array of rows of nullable cells; null under two rows or two columns."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))
    n = F.array_max(F.transform(kept, F.size))
    cell = lambda c: F.replace(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), n - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(kept, line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), n))
    body = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when((F.size(kept) >= 2) & (n >= 2), body)


def without_suffix(text: Column, suffix: Column) -> Column:
    """The text without this ending, where white space doesn't count; null if it doesn't end so."""
    chars = F.transform(F.filter(F.split(solid(suffix), ""), lambda x: x != ""), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E")))
    tail = F.concat(F.lit(r"(?U)\s*"), F.array_join(chars, r"\s*"), F.lit(r"\s*$"))
    return F.when(F.regexp_like(text, tail), F.regexp_replace(text, tail, F.lit("")))


def key_text(text: Column) -> Column:
    """What names a text element: digits masked, printable, stripped, lower case, 14 characters."""
    t = F.regexp_replace(text, r"[\p{Nd}²³¹]", "#")
    return F.substring(F.lower(strip(F.regexp_replace(t, r"[\p{C}\p{Zl}\p{Zp}]", ""))), 1, 14)


def helvetica_width(text: Column) -> Column:
    """Natural width at font size 1."""
    # a look-up for each character; all that have a width of their own are below U+0100
    known = {ord(x): width for width, chars in V.WIDTHS.items() for x in chars}
    widths = F.expr(f"cast(split('{','.join(str(known.get(i, 556)) for i in range(256))}', ',') as array<int>)")
    one = lambda x: F.when(x == "", 0).otherwise(F.coalesce(F.get(widths, F.ascii(x)), F.lit(556)))
    return F.aggregate(F.split(text, ""), F.lit(0), lambda total, x: total + one(x)) / 1000.0


def escape_pdf(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\()])", r"\\$1")


def page_label(page: Column, total: Column) -> Column:
    return F.format_string("[Pagina %d de %d]", page.cast("int"), total.cast("int"))


def clock(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("int"))
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def remaining(seconds: Column) -> Column:
    short = F.greatest(F.lit(10), (seconds / 10).cast("int") * 10)
    return F.when(seconds < 90, F.format_string("resta ~%d s", short)).otherwise(F.format_string("restam ~%d min", F.rint(seconds / 60).cast("int")))
