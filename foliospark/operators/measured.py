"""Parts of files by measured size, where sizes don't add up: what pages share is stored once in each part.

A part's size is a fixed overhead and the bytes of the distinct objects that its pages use, so a page costs only what the part
doesn't have yet. Pages are taken in order; a page that would go over the limit opens the next part, one that is too
large by itself is a part of its own. The state of a file is the set of objects in its open part, so a file may be of
any length: its pages come to one task in order and pass as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

c = F.col
OVERHEAD = 1024


class _Part:
    """The open part of a file."""

    def __init__(self, limit: int, overhead: int) -> None:
        self.limit, self.overhead, self.no = limit, overhead, 0
        self.pages, self.size, self.own = 0, 0, set()

    def take(self, page: dict) -> int:
        """Adds a page's objects (name: bytes), in a new part if they don't fit. Returns the part's size from now on."""
        more = sum(b for o, b in page.items() if o not in self.own)
        if not self.pages or (self.limit and self.size + more > self.limit):
            self.no, self.pages, self.own = self.no + 1, 0, set()
            self.size, more = self.overhead, sum(page.values())
        self.pages += 1
        self.size += more
        self.own.update(page)
        return self.size


def _parts(limit: int, overhead: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, k = None, None, 0
        for batch in batches:
            out = []
            for file, page, objects in zip(*(batch.column(x).to_pylist() for x in ("_file", "_page", "_objects"))):
                if part is None or file != now:
                    part, now, k = _Part(limit, overhead), file, 0
                k += 1
                sized: dict = {}
                for o in objects or ():
                    if o["name"] is not None:
                        sized[o["name"]] = max(sized.get(o["name"], 0), o["bytes"] or 0)
                size = part.take(sized)
                out.append((file, page, k, part.no, size, overhead + sum(sized.values())))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

    return run


def page_parts(pages: DataFrame, objects: DataFrame, file: str, page: str, *, name: str = "name", size: str = "bytes", most_mb: float = V.MOST_MB, overhead: int = OVERHEAD) -> DataFrame:
    """(file, page, page_no, part_no, grown, alone) for each page: its number in the file from 1, its part, the part's size once
    it is in, and its size if it were alone. pages: the pages of files, repeated ones counting again; objects: what each page uses.

    An object that a page names several times counts once, at its largest size; null or negative sizes and nameless objects
    count nothing, pages without objects cost nothing. A limit of zero or less means one part."""
    limit = int(max(most_mb, 0) * 1024 * 1024 * V.SIZE_MARGIN)
    used = objects.select(c(file).alias("_f"), c(page).alias("_p"), F.struct(c(name).cast("string").alias("name"), F.greatest(c(size).cast("bigint"), F.lit(0)).alias("bytes")).alias("_o"))
    used = used.groupBy("_f", "_p").agg(F.collect_list("_o").alias("_objects"))
    d = pages.select(c(file).alias("_file"), c(page).alias("_page"))
    d = d.join(used, d["_file"].eqNullSafe(used["_f"]) & d["_page"].eqNullSafe(used["_p"]), "left").select("_file", "_page", "_objects")
    d = d.repartition("_file").sortWithinPartitions("_file", "_page")
    kind = {k: d.schema[k].dataType.simpleString() for k in ("_file", "_page")}
    kinds = f"_file {kind['_file']}, _page {kind['_page']}, page_no int, part_no int, grown bigint, alone bigint"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(d.sparkSession.createDataFrame([], kinds).schema)
    return d.mapInArrow(_parts(limit, overhead, schema), kinds).withColumnsRenamed({"_file": file, "_page": page})


def measured_parts(placed: DataFrame, file: str, most_mb: float = V.MOST_MB) -> DataFrame:
    """(file, part_no, first_page, last_page, n_bytes, added, oversize): the parts of page_parts. added: what its pages' sizes sum
    up to; a part over the limit has one page."""
    limit = int(max(most_mb, 0) * 1024 * 1024 * V.SIZE_MARGIN)
    d = placed.groupBy(file, "part_no").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.max("grown").alias("n_bytes"), F.sum("alone").alias("added"))
    return d.withColumn("oversize", (c("n_bytes") > limit) if limit else F.lit(False))
