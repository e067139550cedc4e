"""A report as one text a file: sections of several tables, whose lines are put in order at the end.

Each section gives lines (file, section, k1, k2, k3, line), so that a report is a sort and not a walk over the pages; totals and
parts of the removals come from one pass with grouping sets. `as_lines` leaves the lines in order over partitions sorted by range,
for files of any size; `as_text` makes one row a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import geometry as G

c = F.col
KEYS = ("k1", "k2", "k3")
NOTED, FIRST_PAGES, MOST_SNIPPETS, MOST_LOST, WIDTH = 0.01, 20, 120, 80, 160


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after its point, rounded half to even."""
    n, ten = F.rint(x * float(10**digits)).cast("bigint"), 10**digits
    return F.concat(F.floor(n / ten).cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(ten)).cast("string"), digits, "0"))


def _lines(d: DataFrame, section: int, line: Column, *keys) -> DataFrame:
    ks = [*(k if isinstance(k, Column) else F.lit(k) for k in keys), *[F.lit(0)] * 3][:3]
    return d.select("file_id", F.lit(section).alias("section"), *(k.cast("bigint").alias(n) for k, n in zip(ks, KEYS)), line.alias("line"))


def losses(judged: DataFrame) -> DataFrame:
    """(file_id, page_id, reason, chars, area, n_texts): what each reason takes from each page, and with a null page from the whole
    file, and its place in the file's order. From one pass with grouping sets."""
    d = judged.where("reason is not null").select("file_id", "page_id", "reason", F.when(c("kind") == "T", c("n_chars")).otherwise(0).alias("n"), F.when(G.image, G.area_fraction()).otherwise(0.0).alias("a"), ((c("kind") == "T") & (c("n_chars") > 0)).cast("int").alias("t"))
    return d.groupingSets([["file_id", "page_id", "reason"], ["file_id", "reason"]], "file_id", "page_id", "reason").agg(F.sum("n").alias("chars"), F.sum("a").alias("area"), F.sum("t").alias("n_texts"), F.grouping("page_id").alias("whole"))


def audit_report(judged: DataFrame, cuts: DataFrame, lost: DataFrame, heads: DataFrame) -> DataFrame:
    """(file_id, section, k1, k2, k3, line). judged: elements with their reasons; cuts: file_id, page_id, cut_top, cut_base, H; lost:
    file_id, page_id, line; heads: file_id, name, pages, chars (characters of each file). A section without rows has its heading
    alone. Lines of one page or reason are shown up to a number, with how many more there are."""
    all_ = losses(judged)
    page = all_.where("whole = 0").join(judged.where("kind = 'T'").groupBy("file_id", "page_id").agg(F.sum("n_chars").alias("page_chars")), ["file_id", "page_id"], "left")
    noted = (c("chars") > 0) | (c("area") >= NOTED)
    pages = page.where(noted).groupBy("file_id", "reason").agg(F.sort_array(F.collect_list("page_id")).alias("p"))  # pages of one reason
    rank = Win.partitionBy("file_id").orderBy(F.desc(c("chars") + 1000 * c("area")), "reason")
    total = all_.where("whole = 1").join(pages, ["file_id", "reason"], "left").withColumn("place", F.row_number().over(rank)).join(heads.select("file_id", c("chars").alias("doc_chars")), "file_id")
    told = F.concat(F.array_join(F.transform(F.slice(F.coalesce("p", F.array().cast("array<int>")), 1, FIRST_PAGES), lambda x: x.cast("string")), ", "), F.when(F.size("p") > FIRST_PAGES, " ...").otherwise(""))
    quoted = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    row = lambda *x: F.concat(F.lit("| "), F.concat_ws(" | ", *x), F.lit(" |"))
    share = lambda n, of, digits: F.concat(fixed(n / F.greatest(of, F.lit(1)) * 100.0, digits), F.lit("%"))
    out = [
        _lines(heads, 0, F.concat(F.lit("# Relatório de auditoria\n\n**Arquivo:** "), quoted(c("name")), F.lit(" · **Páginas:** "), c("pages").cast("string"), F.lit("\n"))),
        _lines(heads, 1, F.lit("## 1. Ranking global — perda por motivo\n\n| motivo | chars removidos | % do texto | área (págs equiv.) | páginas |\n| --- | ---: | ---: | ---: | --- |")),
        _lines(total, 1, row(quoted(c("reason")), c("chars").cast("string"), share(c("chars"), c("doc_chars"), 2), fixed(c("area"), 2), told), c("place")),
        _lines(heads, 2, F.lit("\n## 2. Perda por página e por motivo\n\n| pág | chars da pág | motivo | chars removidos | % da pág | área |\n| ---: | ---: | --- | ---: | ---: | ---: |")),
    ]
    of_page = page.where(noted).withColumn("k", F.row_number().over(Win.partitionBy("file_id", "page_id").orderBy(F.desc("chars"), "reason")))
    size = F.coalesce("page_chars", F.lit(0))
    out.append(_lines(of_page, 2, row(c("page_id").cast("string"), size.cast("string"), quoted(c("reason")), c("chars").cast("string"), share(c("chars"), size, 1), F.concat(fixed(c("area") * 100.0, 1), F.lit("%"))), 1, c("page_id"), c("k")))
    out.append(_lines(heads, 3, F.lit("\n## 3. Texto efetivamente removido, por motivo")))
    places = total.select("file_id", "reason", "place", "n_texts").where("n_texts > 0")
    out.append(_lines(places, 3, F.concat(F.lit("\n### Motivo "), quoted(c("reason")), F.lit(" — "), c("n_texts").cast("string"), F.lit(" linha(s) removida(s)\n")), c("place")))
    w = Win.partitionBy("file_id", "reason").orderBy("page_id", "el_ix")
    cut = judged.where("reason is not null and kind = 'T' and n_chars > 0").withColumn("k", F.row_number().over(w)).where(c("k") <= MOST_SNIPPETS).join(places, ["file_id", "reason"])
    out.append(_lines(cut, 3, F.concat(F.lit("- (pág "), c("page_id").cast("string"), F.lit(") "), quoted(F.substring("txt", 1, WIDTH))), c("place"), c("k")))
    out.append(_lines(places.where(c("n_texts") > MOST_SNIPPETS), 3, F.concat(F.lit("- ... e mais "), (c("n_texts") - MOST_SNIPPETS).cast("string"), F.lit(" linha(s)")), c("place"), MOST_SNIPPETS + 1))
    n = lost.groupBy("file_id", "page_id").agg(F.count(F.lit(1)).alias("n"))
    whole = heads.join(n.groupBy("file_id").agg(F.sum("n").alias("n")), "file_id", "left")
    out.append(_lines(whole, 4, F.concat(F.lit("\n## 4. Linhas do original que não aparecem no limpo\n\n"), F.when(c("n").isNull(), F.lit("Nenhuma linha perdida.")).otherwise(F.concat(c("n").cast("string"), F.lit(" linha(s)."))))))
    out.append(_lines(n, 4, F.concat(F.lit("\n### Página "), c("page_id").cast("string"), F.lit(" — "), c("n").cast("string"), F.lit(" linha(s) perdida(s)\n")), 1, c("page_id")))
    gone = lost.withColumn("k", F.row_number().over(Win.partitionBy("file_id", "page_id").orderBy("line"))).where(c("k") <= MOST_LOST)
    out.append(_lines(gone, 4, F.concat(F.lit("- "), quoted(F.substring("line", 1, WIDTH))), 1, c("page_id"), c("k")))
    out.append(_lines(n.where(c("n") > MOST_LOST), 4, F.concat(F.lit("- ... e mais "), (c("n") - MOST_LOST).cast("string")), 1, c("page_id"), MOST_LOST + 1))
    out.append(_lines(heads, 5, F.lit("\n## 5. Cortes de régua por página\n\n| pág | cut_topo (pt) | cut_topo/H | cut_base (pt) | cut_base/H |\n| ---: | ---: | ---: | ---: | ---: |")))
    pt = lambda x, digits: F.coalesce(fixed(x, digits), F.lit("—"))
    h = F.when(c("H") == 0, 1.0).otherwise(c("H"))
    out.append(_lines(cuts, 5, row(c("page_id").cast("string"), pt(c("cut_top"), 1), pt(c("cut_top") / h, 3), pt(c("cut_base"), 1), pt(c("cut_base") / h, 3)), 1, c("page_id")))
    return reduce(DataFrame.unionByName, out)


def as_lines(report: DataFrame) -> DataFrame:
    """The lines in their order, over partitions sorted by range."""
    order = ["file_id", "section", *KEYS]
    return report.repartitionByRange(*order).sortWithinPartitions(*order)


def as_text(report: DataFrame) -> DataFrame:
    """(file_id, text): a report is read as one, so it is one row."""
    s = report.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("section", *KEYS, "line"))).alias("s"))
    return s.select("file_id", F.concat(F.array_join("s.line", "\n"), F.lit("\n")).alias("text"))

