"""Mergeable quantile summaries with deterministic weighted collapses (Manku, Rajagopalan and Lindsay), and their check.

A summary is a sorted list of weighted points of its rows' values, the number of rows and a bound on the error of its
ranks. Summaries of different rows merge by putting their points together; beyond BUDGET points they collapse: the
line of all ranks is cut into stretches of w ranks, and the point at the same offset of each stands for the stretch, with
its weight. For even w the offset alternates between the two middle ranks, from one collapse to the next. A collapse adds half
of w to the error, at most.

Values are counted first (stream, grp, batch, x, how often), then sorted by range into blocks. What a block holds
of a group is a piece: sorted values with their counts. Pieces of a very large group lie in many blocks, so no task holds
a group. A piece gives a summary; those of one group merge in rounds of FAN pieces. Summaries of batches merge into that of
the group (batch WHOLE) and nothing else does.

For the check the groups' own values are counted too, as pieces of batch WHOLE. Answers go to the pieces of their
group through the pieces' heads (block, group, rows before), in a join on block and group, and each piece counts its
values below and up to each answer. Joins are by shuffle on purpose: all sides grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import saved

#: Permille of rows that a rank may be off; points of a summary at least and at most; parts of which quantiles are asked;
#: rows from which they are.
PERMILLE, LEAST, BUDGET, PARTS, LEAST_ROWS = 50, 200 // 50, 20000 // 50, 10, 20
WHOLE, BATCHES = -1, 8
#: Points of a piece's summary before the last prune; pieces merged at once; distinct values in a block, about.
ROOM, FAN, BLOCK_VALUES = 8 * BUDGET, 16, 1 << 18
GROUP = ["stream", "grp", "batch"]


def batch_of(name: str) -> Column:
    """The batch of an id; a null one counts as empty text."""
    return (F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % BATCHES).cast("int")


def scaled(name: str) -> Column:
    return (F.floor(100 * F.col(name) + 0.5) + 1000 * F.col("batch")).cast("long")


def shop_values(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """(stream, grp, batch, x, n): how often each value occurs. `value`: the first arrival of each click_id; `price`: lines with
    their item. Lines are counted by item and batch before they meet their item, so that a very common item is a few rows.
    Rows without item, group or money are left out, and such whose money is no finite number."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e13)
    first = clicks.groupBy("click_id").agg(F.min(F.struct("arrived_at", "client_id", "value")).alias("r"))
    value = first.select(F.lit("value").alias("stream"), F.col("r.client_id").cast("string").alias("grp"), batch_of("click_id").alias("batch"), F.col("r.value").cast("double").alias("money"), F.lit(1).cast("long").alias("n"))
    lines = sale_lines.where("item_id is not null").groupBy("item_id", batch_of("vendor_id").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    goods = items.where("item_id is not null").select("item_id", F.lit("price").alias("stream"), F.col("brand").cast("string").alias("grp"), F.col("price").cast("double").alias("money"))
    price = lines.join(goods.hint("merge"), "item_id").select("stream", "grp", "batch", "money", "n")
    rows = value.unionByName(price).where(F.col("grp").isNotNull() & finite("money"))
    return rows.withColumn("x", scaled("money")).groupBy(*GROUP, "x").agg(F.sum("n").alias("n"))


# Summaries of many groups at once: group g has the elements edges[g] to edges[g + 1] of points and weights.


def runs(*columns: pa.Array) -> np.ndarray:
    """Edges of runs of equal rows."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), n)


def collapsed(points: np.ndarray, weights: np.ndarray, most: int, odd: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """At most `most` of sorted weighted points, their weights (the same in sum) and the error that this adds."""
    total = np.cumsum(weights)
    n = int(total[-1])
    w = -(-n // most)
    begin = np.arange(0, n, w)
    size = np.minimum(w, n - begin)
    # the middle of each stretch; of two, the lower or the upper one by turns
    at = begin + np.where(size % 2 == 1, size // 2, size // 2 - (0 if odd else 1))
    return points[np.searchsorted(total, at, "right")], size, w // 2


def merged(edges: np.ndarray, points: np.ndarray, weights: np.ndarray, error: np.ndarray, collapses: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Each group's elements in order, equal points as one, and collapsed to `most` if there are more. error and collapses: of
    each group so far. The same five arrays come back."""
    sizes = np.diff(edges)
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((points, group))
    points, weights, group = points[order], weights[order], group[order]
    if len(points):
        first = np.flatnonzero(np.concatenate([[True], (points[1:] != points[:-1]) | (group[1:] != group[:-1])]))
        points, weights, group = points[first], np.add.reduceat(weights, first), group[first]
    edges = np.searchsorted(group, np.arange(len(sizes) + 1))
    sizes = np.diff(edges)
    large = np.flatnonzero(sizes > most)
    if len(large):
        error, collapses, done = error.copy(), collapses.copy(), 0
        new_points, new_weights = [], []
        for g in large.tolist():
            a, z = edges[g], edges[g + 1]
            p, w, more = collapsed(points[a:z], weights[a:z], most, bool(collapses[g] % 2))
            new_points += [points[done:a], p]
            new_weights += [weights[done:a], w]
            sizes[g], done = len(p), z
            error[g] += more
            collapses[g] += 1
        points, weights = np.concatenate([*new_points, points[done:]]), np.concatenate([*new_weights, weights[done:]])
        edges = np.concatenate([[0], np.cumsum(sizes)])
    return edges, points, weights, error, collapses


def estimates(edges: np.ndarray, points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each group, and its answers: the points whose stretches hold the ranks ceil(i n / PARTS), for i in 1..PARTS-1."""
    total = np.concatenate([[0], np.cumsum(weights)])
    n = total[edges[1:]] - total[edges[:-1]]
    rank = -(-np.arange(1, PARTS)[None, :] * n[:, None] // PARTS)
    at = np.searchsorted(total, (total[edges[:-1]][:, None] + rank).ravel(), "left") - 1
    return n, points[np.clip(at, 0, max(len(points) - 1, 0))].reshape(len(n), PARTS - 1) if len(points) else np.zeros((len(n), PARTS - 1), np.int64)


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int64()))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py(), column.flatten().to_numpy()


_PIECES = "block int, edge boolean, stream string, grp string, batch int, n bigint, xs array<bigint>, ns array<bigint>"


def _columns(t: pa.Table) -> dict[str, pa.Array]:
    return {c: t.column(c).combine_chunks() for c in t.column_names}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all values that a block holds of a group; edge: the first or last group of its block, which other blocks may
    have too. The rows of a block come sorted, and it fits in a task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    cols = _columns(pa.Table.from_batches(held))
    edges = runs(*(cols[c] for c in GROUP))
    n, first, edge = cols["n"].to_numpy(), pa.array(edges[:-1]), np.zeros(len(edges) - 1, bool)
    edge[[0, -1]] = True
    total = np.concatenate([[0], np.cumsum(n)])
    rows = [cols["block"].take(first), pa.array(edge), *(cols[c].take(first) for c in GROUP), pa.array(total[edges[1:]] - total[edges[:-1]]), _lists(cols["x"].to_numpy(), edges), _lists(n, edges)]
    whole = pa.RecordBatch.from_arrays(rows, names=["block", "edge", *GROUP, "n", "xs", "ns"])
    for i in range(0, whole.num_rows, 10000):
        yield whole.slice(i, 10000)


def pieces_of(counted: DataFrame, blocks: int) -> DataFrame:
    """(block, edge, stream, grp, batch, n, xs, ns): the counted values by block and group, batches and groups (WHOLE)."""
    both = counted.select(*GROUP, "x", "n").unionByName(counted.groupBy("stream", "grp", "x").agg(F.sum("n").alias("n")).withColumn("batch", F.lit(WHOLE)))
    return both.repartitionByRange(blocks, *GROUP, "x").sortWithinPartitions(*GROUP, "x").select(F.spark_partition_id().alias("block"), *GROUP, "x", "n").mapInArrow(_pieces, _PIECES)


_SUMMARY = "stream string, grp string, batch int, place bigint, n bigint, points array<bigint>, weights array<bigint>, error bigint, collapses bigint"


def _summary(keys: list[pa.Array], edges, points, weights, error, collapses) -> pa.RecordBatch:
    total = np.concatenate([[0], np.cumsum(weights)])
    rows = [pa.array(total[edges[1:]] - total[edges[:-1]]), _lists(points, edges), _lists(weights, edges), pa.array(error), pa.array(collapses)]
    return pa.RecordBatch.from_arrays([*keys, *rows], names=[*GROUP, "place", "n", "points", "weights", "error", "collapses"])


def _of_pieces(most: int):
    """A summary of each piece; its place is its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (edges, points), (_, weights) = _flat(batch.column("xs")), _flat(batch.column("ns"))
            none = np.zeros(batch.num_rows, np.int64)
            yield _summary([*(batch.column(c) for c in GROUP), batch.column("block").cast(pa.int64())], *merged(edges, points, weights, none, none, most))

    return run


def _merge(keys: list[str], most: int, whole: bool = False):
    """Merges rows that have the same keys and come one after the other, up to FAN of them; whole: the result is that of a group.
    The last keys of a batch wait for the next batch."""

    def made(t: pa.Table) -> pa.RecordBatch:
        cols = _columns(t)
        rows = runs(*(cols[c] for c in keys))
        (edges, points), (_, weights) = _flat(cols["points"]), _flat(cols["weights"])
        added = [np.add.reduceat(cols[c].to_numpy(), rows[:-1]) for c in ("error", "collapses")]
        names = [cols[c].take(pa.array(rows[:-1])) for c in (*GROUP, "place")]
        if whole:
            names[2:] = [pa.array(np.full(len(rows) - 1, WHOLE, np.int32)), pa.array(np.zeros(len(rows) - 1, np.int64))]
        return _summary(names, *merged(edges[rows], points, weights, *added, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            last = int(runs(*(t.column(c).combine_chunks() for c in keys))[-2])
            held = t.slice(last)
            if last:
                yield made(t.slice(0, last))
        if held is not None:
            yield made(held)

    return run


def summaries(pieces: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The summaries of batches, written as a table, and those of groups (batch WHOLE), merged from the former alone.

    A group that is no edge of its block has one piece. The others merge in rounds, FAN neighbouring blocks at a time, until one is
    left; the number of rounds follows from that of the blocks.
    """
    own = pieces.where(F.col("batch") != WHOLE)
    few = own.where("not edge").mapInArrow(_of_pieces(BUDGET), _SUMMARY)
    level, left = own.where("edge").mapInArrow(_of_pieces(ROOM), _SUMMARY), blocks
    while True:
        left, keys = -(-left // FAN), [*GROUP, "place"]
        level = level.withColumn("place", F.floor(F.col("place") / FAN)).repartition(*keys).sortWithinPartitions(*keys)
        level = level.mapInArrow(_merge(keys, ROOM if left > 1 else BUDGET), _SUMMARY)
        if left <= 1:
            break
    batches, keys = saved(few.unionByName(level), "batches"), ["stream", "grp"]
    return batches, batches.repartition(*keys).sortWithinPartitions(*GROUP).mapInArrow(_merge(keys, BUDGET, True), _SUMMARY)


_ANSWERS = "stream string, grp string, batch int, total bigint, points bigint, tracked_error bigint, answers array<bigint>"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (edges, points), (_, weights) = _flat(batch.column("points")), _flat(batch.column("weights"))
        n, found = estimates(edges, points, weights)
        every = np.arange(len(n) + 1) * (PARTS - 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in GROUP), pa.array(n), pa.array(np.diff(edges)), batch.column("error"), _lists(found.ravel(), every)], names=[*GROUP, "total", "points", "tracked_error", "answers"])


_CHECKED = f"{_ANSWERS}, below array<bigint>, upto array<bigint>, exact array<bigint>"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a piece knows of its group's answers: its rows below and up to each, and the exact values whose ranks lie in it."""
    for batch in batches:
        (edges, xs), (_, ns) = _flat(batch.column("xs")), _flat(batch.column("ns"))
        rows = batch.num_rows
        answers = _flat(batch.column("answers"))[1].reshape(rows, PARTS - 1)
        row, total = np.repeat(np.arange(rows), np.diff(edges)), np.concatenate([[0], np.cumsum(ns)])
        within = lambda flags: np.diff(np.concatenate([[0], np.cumsum(ns * flags)])[edges])
        below = np.stack([within(xs < answers[row, k]) for k in range(PARTS - 1)], axis=1)
        upto = np.stack([within(xs <= answers[row, k]) for k in range(PARTS - 1)], axis=1)
        rank = -(-np.arange(1, PARTS)[None, :] * batch.column("total").to_numpy()[:, None] // PARTS) - batch.column("before").to_numpy()[:, None]
        here = (rank >= 1) & (rank <= (total[edges[1:]] - total[edges[:-1]])[:, None])
        at = np.searchsorted(total, (total[edges[:-1]][:, None] + rank).ravel(), "left") - 1
        exact = xs[np.clip(at, 0, len(xs) - 1)] if len(xs) else at
        every = np.arange(rows + 1) * (PARTS - 1)
        found = pa.ListArray.from_arrays(pa.array(every, pa.int32()), pa.array(exact, pa.int64(), mask=~here.ravel()))
        kept = [batch.column(c) for c in (*GROUP, "total", "points", "tracked_error", "answers")]
        yield pa.RecordBatch.from_arrays([*kept, _lists(below.ravel(), every), _lists(upto.ravel(), every), found], names=[*GROUP, "total", "points", "tracked_error", "answers", "below", "upto", "exact"])


def verified_quantiles(counted: DataFrame, *, blocks: int | None = None) -> DataFrame:
    """Quantiles of summaries, each checked against all rows. counted: (stream, grp, batch, x, n), n rows with the value x.

    For every batch and every group (batch WHOLE) of LEAST_ROWS rows or more and i in 1..PARTS-1: n; target, the rank asked for;
    exact_x, the value of that rank; points of the summary; answer; n_below and n_upto, rows below and up to the answer;
    rank_error, how far the target lies outside the answer's ranks; within, whether that is at most PERMILLE of n; and
    tracked_error, the bound that the summary kept itself. Null streams or groups are groups like others; rows without a value
    are left out; an empty table gives no rows.
    """
    spark = counted.sparkSession
    held = saved(counted.where("x is not null and n > 0").select(*GROUP, "x", "n"), "counted")
    if blocks is None:
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * held.count() // BLOCK_VALUES))
    pieces = saved(pieces_of(held, blocks), "pieces")
    batches, whole = summaries(pieces, blocks)
    asked = batches.unionByName(whole).where(F.col("n") >= LEAST_ROWS).select(*GROUP, "points", "weights", "error").mapInArrow(_answers, _ANSWERS)
    answers = saved(asked, "answers")

    def met(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
        """a and b where they agree in their group (null counts as equal), by shuffle."""
        other = b.withColumnsRenamed({c: f"_{c}" for c in (*more, *GROUP)})
        return a.join(other.hint("merge"), [a[c].eqNullSafe(other[f"_{c}"]) for c in (*more, *GROUP)]).drop(*(f"_{c}" for c in (*more, *GROUP)))

    alone = met(pieces.where(f"not edge and n >= {LEAST_ROWS}"), answers).withColumn("before", F.lit(0).cast("long"))
    edges = pieces.where("edge")
    earlier = W.partitionBy(*GROUP).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    heads = met(edges.select("block", *GROUP, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), answers)
    spread = met(edges, heads, "block")

    each = F.posexplode(F.arrays_zip("answers", "below", "upto", "exact")).alias("_i", "_r")
    long = lambda d: d.mapInArrow(_checked, _CHECKED).select(*GROUP, "total", "points", "tracked_error", each).select(*GROUP, "total", "points", "tracked_error", (F.col("_i") + 1).alias("i"), "_r.*")
    parts = long(spread).groupBy(*GROUP, "total", "points", "tracked_error", "i", "answers").agg(*(F.sum(c).alias(c) for c in ("below", "upto")), F.max("exact").alias("exact"))
    d = long(alone).unionByName(parts).withColumn("target", F.expr(f"(i * total + {PARTS - 1}) div {PARTS}"))
    error = F.greatest(F.lit(0), F.col("below") + 1 - F.col("target"), F.col("target") - F.col("upto")).cast("long")
    d = d.select(*GROUP, "i", F.col("total").alias("n"), "target", F.col("exact").alias("exact_x"), "points", F.col("answers").alias("answer"), F.col("below").alias("n_below"), F.col("upto").alias("n_upto"), error.alias("rank_error"), "tracked_error")
    return d.withColumn("within", 1000 * F.col("rank_error") <= PERMILLE * F.col("n"))
