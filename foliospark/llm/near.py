"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct 5-word shingles, ordered by corpus frequency, rare ones first.
Sets of Jaccard 0.75 or more share a token of their base prefixes, and l tokens of prefixes that are l - 1 tokens longer.
How many documents have each prefix token is counted, which says how many candidates a document's base prefix brings; l
grows with their mean (`matches`). A pair must share min(l) tokens of its two prefixes of that length before any text is
read and its sets are compared as a whole.

The order comes from counts over all documents in CELLS cells by hash, a table of fixed size; any order gives the same
links. Equal sets are one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .lm import packed, unpacked
from .setjoin import bitmap, hub_pairs, keys_of, left_of, live_entries, prefix_size, rest_pairs, size_of, with_texts
from .shared import forget, release, saved
from .words import NOT_SPACE, gram_hashes, mix, slices, words_of

NUM, DEN, SHINGLE = 3, 4, 5
CELLS, CELL_BITS, RANK_BITS, PART = 1 << 22, 22, 8, 1 << 16
HEAVY = 1000
#: Most tokens that prefixes must share; candidates of a prefix token that are usual; one more token for each factor STEP.
MOST_MATCHES, USUAL, STEP = 4, 2, 2


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and each text's first (with the end)."""
    w = words_of(column, NOT_SPACE, lower=True)
    h = w.hashes()
    at = w.gram_rows(k)
    row, value = w.row[at], gram_hashes(h, k)[at]
    n = np.diff(w.first)
    for size in range(1, k):  # texts of fewer words: the whole sequence
        short = np.flatnonzero(n == size)
        if len(short):
            row = np.concatenate([row, short])
            value = np.concatenate([value, gram_hashes(h, size)[w.first[short]]])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(w.rows + 1))


def _row_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _signature(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set: sums of scrambled tokens, scrambled again with the size."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] ^ mix(np.diff(first).astype(np.uint64)))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc, key, n), and at the end rows of packed cell counts (n is -1, doc the part)."""
    cells = np.zeros(CELLS, np.uint32)
    for batch in slices(batches, "_text", 1 << 20):
        value, first = shingle_sets(batch.column("_text"))
        cells += np.bincount((value >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(_signature(value, first).view(np.int64)), pa.array(np.diff(first), pa.int64()), pa.nulls(batch.num_rows, pa.binary())], names=["doc", "key", "n", "cells"])
    if cells.any():
        at = np.arange(CELLS // PART)
        parts = [packed(cells[i * PART : (i + 1) * PART]) for i in at]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(at), pa.array(np.full(len(at), -1)), pa.array(parts, pa.binary())], names=["doc", "key", "n", "cells"])


def _add(table: pa.Table) -> pa.Table:
    """Frequency classes of a part's cells, and the sum of its counts."""
    total = sum(unpacked(x, "<u4").astype(np.int64) for x in table.column("cells").to_pylist())
    return pa.table({"part": pa.array([table.column("doc")[0].as_py()], pa.int64()), "ranks": pa.array([_ranks(total).tobytes()], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Frequency classes 0 to 255, four to a doubling."""
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def _ordered(value: np.ndarray, first: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The same sets with tokens that sort by frequency class, then hash (its lower bits are kept)."""
    token = (ranks[(value >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63 - RANK_BITS)) | (mix(value) >> np.uint64(1 + RANK_BITS))
    order = np.lexsort((token, _row_of(first)))
    return token[order]


def _base(n: np.ndarray) -> np.ndarray:
    return n - -(-NUM * n // DEN) + 1


def _entries(ranks_b, limit: int, common: dict[int, int], most: int):
    """Tokens of each document's longest prefix, of `most` - 1 tokens more than the base prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_b.value
        hot = np.array(sorted(common), np.int64)
        for batch in slices(batches, "_text", 1 << 20):
            value, first = shingle_sets(batch.column("_text"))
            ids = np.asarray(batch.column("_id"), np.int64)
            key = _signature(value, first).view(np.int64)
            n = np.diff(first)
            take = n > 0
            for i in np.flatnonzero(np.isin(key, hot)).tolist() if len(hot) else ():
                take[i] &= ids[i] == common[int(key[i])]
            token = _ordered(value, first, ranks)
            size = np.where(take, np.minimum(n, _base(n) + most - 1), 0)
            row = np.repeat(np.arange(len(n)), size)
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            t = token[first[:-1][row] + pos]
            heavy = (t >> np.uint64(63 - RANK_BITS)) > limit
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(ids[row]), pa.array(n[row] << 32 | pos), pa.array(heavy)], names=["token", "key", "at", "heavy"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar enough."""
    for batch in slices(batches, "x_text", 1 << 20):
        (a, fa), (b, fb) = (shingle_sets(batch.column(name)) for name in ("x_text", "y_text"))
        row, value = np.concatenate([_row_of(fa), _row_of(fb)]), np.concatenate([a, b])
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
        both = np.bincount(row[1:][twice], minlength=batch.num_rows)
        ok = DEN * both >= NUM * (np.diff(fa) + np.diff(fb) - both)
        yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(ok)), batch.column("y").filter(pa.array(ok))], names=["x", "y"])


def matches(live: DataFrame, most: int = MOST_MATCHES) -> DataFrame:
    """(key, l) of documents whose prefixes are lengthened (l over 1): one token more for each factor STEP by which the mean
    number of candidates of a base prefix token is over USUAL. No more than similar sets must share in any case."""
    n, pos = size_of(F.col("at")), size_of(F.col("at")) - left_of(F.col("at"))
    base = prefix_size(n, NUM, DEN)
    cost = live.where(pos < base).groupBy("key").agg(F.sum(F.col("c") - 1).alias("cost"), F.min(n).alias("n"))
    base = prefix_size(F.col("n"), NUM, DEN)
    l = 1 + F.floor(F.log(F.greatest(F.lit(1.0), F.col("cost") / (base * USUAL))) / math.log(STEP)).cast("int")  # noqa: E741
    return cost.select("key", F.least(l, F.lit(most), F.col("n") - base + 1).alias("l")).where("l > 1")


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_matches: int = MOST_MATCHES) -> DataFrame:
    """A row for each row of `docs`: the id, n_shingles and component_id, the smallest id reachable by links.

    Documents link when their sets have Jaccard 0.75 or more. Without words (or with a null text) the set is
    empty and the document its own component. Ids are integers; a row with a null id takes the component of a
    document with the same set, and links with no other. Repeated rows stay repeated and have one component. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    summary = saved(d.mapInArrow(_summary, "doc bigint, key bigint, n bigint, cells binary"), "summary")
    own = summary.where("n >= 0").drop("cells")
    classes = own.where("n > 0").groupBy("key").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("c"))
    ranks, total = np.zeros(CELLS, np.uint8), 0
    for r in summary.where("n = -1").select("doc", "cells").groupBy("doc").applyInArrow(_add, "part bigint, ranks binary, total bigint").toLocalIterator():  # CELLS bytes
        ranks[r[0] * PART : (r[0] + 1) * PART] = np.frombuffer(r[1], np.uint8)
        total += r[2]
    n_docs = own.count()
    limit = int(_ranks(np.array([2 * total / CELLS + n_docs / HEAVY + 1]))[0])
    # of classes with a thousandth of the documents, a thousand at most, only the first document gives entries
    common = {r[0]: r[1] for r in classes.where((F.col("c") > max(8, n_docs // HEAVY)) & F.col("first").isNotNull()).select("key", "first").collect()}
    ranks_b = spark.sparkContext.broadcast(ranks)  # CELLS bytes
    named = d.where("_id is not null")
    entries = named.mapInArrow(_entries(ranks_b, limit, common, most_matches), "token bigint, key bigint, at bigint, heavy boolean")
    live = saved(live_entries(entries, central=True), "prefixes")
    more_tokens = saved(matches(live, most_matches), "matches")
    release(spark)

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs, "pairs")
        test = bitmap(keys_of(pairs).withColumnRenamed("key", "_id"), "_id")
        if test is None:
            return pairs
        texts = named.where(test).select(F.col("_id").alias("key"), F.col("_text").alias("text"))
        return saved(with_texts(pairs, texts).mapInArrow(_similar, "x bigint, y bigint").distinct(), "links")

    copies = own.join(classes.where("c > 1 and first is not null").select("key", "first"), "key").where("doc <> first").select(F.col("doc").alias("x"), F.col("first").alias("y"))
    links = similar(hub_pairs(live, NUM, DEN, more_tokens)).unionByName(copies)
    group = components(links, "x", "y")
    more = similar(rest_pairs(live, group.withColumnsRenamed({"node": "key", "root": "g"}), NUM, DEN, more_tokens))
    if more.take(1):
        group = components(group.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(more), "x", "y")
    group = group.select(F.col("node").alias("_node"), F.col("root").alias("component_id"))
    unnamed = own.where("doc is null").join(classes.select("key", F.col("first").alias("_node")), "key", "left").join(group, "_node", "left").select("doc", "n", F.coalesce("component_id", "_node").alias("component_id"))
    found = own.where("doc is not null").join(group, F.col("doc") == F.col("_node"), "left").select("doc", "n", F.coalesce("component_id", "doc").alias("component_id"))
    return found.unionByName(unnamed).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that have their component's smallest id, with all columns. Rows without an id stay;
    rows of one id stay or go together."""
    found = near_components(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), id_col="id", text_col="text")
    gone = saved(found.where("id <> component_id").select("id").distinct(), "gone")
    test = bitmap(gone, "id")
    if test is None:
        return docs
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id"))
    test = F.coalesce(test, F.lit(False))
    out = d.where(~test).unionByName(d.where(test).join(gone, "id", "left_anti").select("row", "id"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
