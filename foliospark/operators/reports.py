"""What reports show: lost lines, word differences, budgets, hot spots, totals, gates over page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources.kept import kept

c = F.col
STAGES = ("analysis", "cleaning", "ocr", "numbering", "splitting", "export")


def stage_budgets(plan: DataFrame, key: str, number: bool = True, export: bool = True, ocr: bool = True) -> DataFrame:
    """(key, stage, budget, base): work units of each file's stages, and of all files and stages before. A row for each
    file and stage; plan: key, pages, ocr_pages."""
    w, n = V.WEIGHTS, c("pages")
    none = F.lit(0.0)
    units = (0.4 * w["clean"] * n, 0.6 * w["clean"] * n, w["ocr"] * c("ocr_pages") if ocr else none, w["number"] * n if number else none, w["split"] * n, w["export"] * n if export else none)
    rows = plan.select(key, F.posexplode(F.array(*(F.struct(F.lit(s).alias("stage"), u.cast("double").alias("budget")) for s, u in zip(STAGES, units)))).alias("i", "s"))
    # totals of files first: the running sum over all of them has a row for each file
    total = rows.groupBy(key).agg(F.sum("s.budget").alias("t"))
    before = total.select(key, F.coalesce(F.sum("t").over(Win.orderBy(key).rowsBetween(Win.unboundedPreceding, -1)), none).alias("files"))
    own = F.coalesce(F.sum("s.budget").over(Win.partitionBy(key).orderBy("i").rowsBetween(Win.unboundedPreceding, -1)), none)
    return rows.withColumn("own", own).join(before, key).select(key, "s.stage", "s.budget", (c("files") + c("own")).alias("base"))


def lost_report(lost: DataFrame, key: str, most: int = 80, width: int = 160) -> DataFrame:
    """(key, n_lost, shown, more): the first lost lines of a page, cut to a width, and how many more there are."""
    w = Win.partitionBy(key).orderBy("line")
    d = lost.withColumn("place", F.row_number().over(w)).groupBy(key).agg(F.count(F.lit(1)).alias("n_lost"), F.sort_array(F.collect_list(F.when(c("place") <= most, F.struct("place", F.substring("line", 1, width).alias("t"))))).alias("s"))
    return d.select(key, "n_lost", F.array_join("s.t", "\n").alias("shown"), F.greatest(c("n_lost") - most, F.lit(0)).alias("more"))


def word_preview(rows: DataFrame, key: str, a: str, z: str, words: int = 12, pages: int = 10) -> DataFrame:
    """(key, only): of the first pages whose array a has words that z lacks, the first of those words, repeats included.
    A page may have several rows; what any of them has in z, the page has.

    The pages are found by comparing the arrays of each row; words become rows only of these pages, and of those with several rows."""
    d = rows.where(c(key).isNotNull())
    keys = d.select(c(key).alias("_k"), F.coalesce(F.size(F.array_except(a, F.coalesce(z, F.array().cast("array<string>")))) > 0, F.lit(False)).alias("_gone"))
    keys = kept(keys.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_gone").alias("_gone")).where("_gone"))
    some = keys.where("_n = 1").select("_k")
    if not keys.where("_n > 1").isEmpty():
        several = d.join(keys.where("_n > 1").select(c("_k").alias(key)), key)
        some = some.unionByName(_only(several, key, a, z).select(c(key).alias("_k")).distinct())
    first = some.orderBy("_k").limit(pages).select(c("_k").alias(key))
    gone = _only(d.join(F.broadcast(first), key), key, a, z)
    gone = gone.withColumn("place", F.row_number().over(Win.partitionBy(key).orderBy("i"))).where(c("place") <= words)
    return gone.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w")).select(key, F.array_join("w.word", " ").alias("only"))


def _only(rows: DataFrame, key: str, a: str, z: str) -> DataFrame:
    """(key, i, word): the words of a that z lacks on all rows of the key."""
    own = rows.select(key, F.posexplode(a).alias("i", "word"))
    return own.join(rows.select(key, F.explode(z).alias("word")).distinct(), [key, "word"], "left_anti")


def additive_gate(pages: DataFrame, key: str, frame: str, least_conf: float = V.WORD_CONFIDENCE, sample: list | None = None) -> DataFrame:
    """(key, chars and words before and after, frame_kept, ok): recognition must add and never take: no fewer characters,
    the frame's text still there, and a mean confidence (if any) that is high enough. pages: key, a, z, conf."""
    d = pages if sample is None else pages.where(c(key).isin(sample))
    size = lambda x: F.length(T.solid(c(x)))
    d = d.select(key, size("a").alias("chars_a"), size("z").alias("chars_z"), F.size(T.long_words(c("a"))).alias("words_a"), F.size(T.long_words(c("z"))).alias("words_z"), (~F.contains("a", F.lit(frame)) | F.contains("z", F.lit(frame))).alias("frame_kept"), "conf")
    ok = (c("chars_z") >= c("chars_a")) & c("frame_kept") & F.coalesce(c("conf") >= least_conf, F.lit(True))
    return d.withColumn("ok", ok).drop("conf")


def passed(gate: DataFrame) -> DataFrame:
    return gate.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed"), F.count(F.lit(1)).alias("pages"), F.count_if(~c("ok")).alias("failed"))


def hot_spots(profile: DataFrame, name: str, cumulative: str, wanted: Column, most: int = 25) -> DataFrame:
    """The functions of interest with the largest cumulative times."""
    return profile.where(wanted).orderBy(F.desc(cumulative), name).limit(most)


def by_density(pages: DataFrame, kind: str = V.HYBRID) -> DataFrame:
    """Pages of a class, thinnest text first."""
    return pages.where(c("class") == kind).orderBy("density", "page_id")


def clean_totals(judged: DataFrame, loss: DataFrame) -> DataFrame:
    """One row: pages from which something goes, and pages kept whole because too much would have gone."""
    page = ["file_id", "page_id"]
    some = judged.where("reason is not null").select(*page).distinct().withColumn("some", F.lit(True))
    d = loss.select(*page, "rolled_back").join(some, page, "left")
    return d.agg(F.count_if(F.coalesce("some", F.lit(False)) & ~c("rolled_back")).alias("changed"), F.count_if("rolled_back").alias("protected"))


def digits_only(key: Column) -> Column:
    """Text keys without a letter: page numbers and rules, which may stand in for other texts."""
    return key.rlike(r"^T\|-?[0-9]+\|[^\p{L}\p{N}_]*$")
