"""File listings, pages of text, and a guarded PDF source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

c = F.col
CLEANED = "_limpo"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length) of files under the folder, without cleaned ones; contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return d.where(~stem.contains(CLEANED)).orderBy("path")


def collect_inputs(listed: DataFrame) -> DataFrame:
    """(path, out_dir) with the first mention of each path. listed: (entry_no, entry, is_dir, path)."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    parent = F.regexp_replace("entry", r"/[^/]*$", "")
    d = listed.where(~stem.contains(CLEANED)).withColumn("out_dir", F.concat(F.when(c("is_dir"), c("entry")).otherwise(parent), F.lit("/LIMPOS")))
    w = Win.partitionBy("path").orderBy("entry_no")
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("path", "out_dir")


def output_path(path: str, out: str | None = None) -> str:
    """Where a cleaned file goes: the given place, or beside the input."""
    if out and not any(x in out for x in "\0\n"):
        return out
    folder, _, name = path.rpartition("/")
    return f"{folder or '.'}/{'LIMPOS/' if out else ''}{name.rsplit('.', 1)[0]}{CLEANED}.pdf"


def first_pages(pages: DataFrame, key: str, page: str, n: int) -> DataFrame:
    return pages if n <= 0 else pages.where(c(page) < n)


def pdf_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, page_no, text) of PDFs. Needs the optional library pypdf on all machines; nothing else here does."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("pypdf isn't installed; give pages as a table instead") from e

    def read(batches):
        import io

        import pandas as pd
        import pypdf

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                pages = pypdf.PdfReader(io.BytesIO(content)).pages
                yield pd.DataFrame({"path": path, "page_no": range(len(pages)), "text": [p.extract_text() for p in pages]})

    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder)
    return d.select("path", "content").mapInPandas(read, "path string, page_no int, text string")


def xobject_scans(objects: DataFrame, depth: int = 4, pixels: int = 300_000) -> DataFrame:
    """(root): forms that hold, at most `depth` levels down, an image of that many pixels. objects: (parent, child, subtype, w, h)."""
    big = objects.where((c("subtype") == "Image") & (c("w") * c("h") >= pixels)).select(c("parent").alias("root")).distinct()
    found = big
    for _ in range(depth - 1):
        big = objects.where("subtype = 'Form'").join(big.withColumnRenamed("root", "child"), "child").select(c("parent").alias("root")).distinct()
        found = found.unionByName(big).distinct()
    return found
