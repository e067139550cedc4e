"""Work on the boxes of pages inside tasks: rows come sorted by page, many whole pages at a time, and numpy works on all of them
together, so that neither a page of very many boxes nor very many small pages cost more than n log n. A page's boxes fit in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

#: Rows that are worked on together, but for a page that has more.
CHUNK = 100_000


def _cut(table: pa.Table, keys: list[str]) -> int:
    """Where the last page of the table begins."""
    last = table.slice(table.num_rows - 1).select(keys).to_pylist()[0]
    lo, hi = 0, table.num_rows - 1
    while lo < hi:  # rows are sorted by page, so those of the last one are together
        mid = (lo + hi) // 2
        if table.slice(mid, 1).select(keys).to_pylist()[0] == last:
            hi = mid
        else:
            lo = mid + 1
    return lo


def chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole pages; batches are sorted by `keys`."""
    held, n, full = [], 0, CHUNK
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= full:
            table = pa.Table.from_batches(held)
            at = _cut(table, keys)
            if at:
                yield table.slice(0, at)
            held, n = table.slice(at).to_batches(), n - at
            full = max(CHUNK, 2 * n)  # a long page is looked at again when it has doubled
    if held:
        yield pa.Table.from_batches(held)


def by_page(d: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f over tables of whole pages. A window brings a page's rows together, without a shuffle or a sort where they already are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, keys):
            yield from f(table).to_batches()

    return d.withColumn("_of_page", F.count(F.lit(1)).over(Win.partitionBy(*keys))).mapInArrow(run, schema)


def pages_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's page, from 0."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    codes = [table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for k in keys]
    new = np.zeros(table.num_rows, bool)
    for k in codes:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _spans(page: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals as whole numbers that meet just as they do: the place of `low` among those of all pages, and the last place that
    `high` reaches on its page."""
    n = len(low)
    o = np.lexsort((np.repeat([0, 1], n), np.concatenate([low, high]), np.concatenate([page, page])))
    starts, p, v = o < n, np.concatenate([page, page])[o], np.concatenate([low, high])[o]
    new = np.zeros(2 * n, bool)
    at = np.flatnonzero(starts)
    new[at] = np.concatenate([[True], (p[at][1:] != p[at][:-1]) | (v[at][1:] != v[at][:-1])]) if n else True
    place = np.empty(2 * n, np.int64)
    place[o] = np.cumsum(new) - 1
    return place[:n], place[n:]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (of every row that of its component's least one) after edges between rows a and b."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nearer := label[label], label):
            label = nearer


def touching(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, gap: float) -> np.ndarray:
    """A label for each box, equal for boxes of a page that are joined by boxes no more than `gap` apart both ways.

    Boxes lie in the nodes of a segment tree over heights; two of them meet in height if they have a node in common or one's lies
    under the other's. The boxes of a node (they all meet in height) fall into runs along x; one that only goes through a node
    joins the runs that it meets there, which follow each other. So the edges are n log n, however many boxes touch."""
    n = len(page)
    label = np.arange(n)
    low, high = _spans(page, y0, y1 + gap)
    left, right = _spans(page, x0, x1 + gap)
    wide = n + 1
    rows, first, end, level = np.arange(n), low.copy(), high + 1, 0
    while len(rows):
        own = [(first, (first & 1) == 1), (end - 1, (end & 1) == 1)]
        node, row = (np.concatenate(z) for z in zip(*((k[use], rows[use]) for k, use in own)))
        if len(row):
            key = node * wide + left[row]
            o = np.argsort(key, kind="stable")
            node, row, key = node[o], row[o], key[o]
            reach = np.maximum.accumulate(node * wide + right[row])
            new = np.concatenate([[True], key[1:] > reach[:-1]])
            heads = np.flatnonzero(new)
            head, begin, until = row[heads], key[heads], reach[np.concatenate([heads[1:], [len(row)]]) - 1]
            a, b = [row], [head[np.cumsum(new) - 1]]
            used = np.zeros(int(max(node[-1], high.max() >> level)) + 1, bool)
            used[node] = True
            steps = np.zeros(len(head) + 1, np.int64)
            through = [low >> level, high >> level]
            for side, k in enumerate(through):
                inside = ((k << level) >= low) & (((k + 1) << level) - 1 <= high)
                some = np.flatnonzero(used[k] & ~inside & (True if side == 0 else k != through[0]))
                at = k[some] * wide
                one, last = np.searchsorted(until, at + left[some]), np.searchsorted(begin, at + right[some], "right") - 1
                met = one <= last
                a.append(some[met])
                b.append(head[one[met]])
                np.add.at(steps, one[met], 1)
                np.add.at(steps, last[met], -1)
            on = np.flatnonzero(np.cumsum(steps)[:-1] > 0)
            a.append(head[on])
            b.append(head[on + 1])
            label = _joined(label, np.concatenate(a), np.concatenate(b))
        first, end, level = (first + 1) >> 1, end >> 1, level + 1
        open_ = first < end
        rows, first, end = rows[open_], first[open_], end[open_]
    return label


def first_where(lo: np.ndarray, hi: np.ndarray, holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each query the first place from lo (before hi) where a condition holds that then goes on holding, else hi."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        yes = open_ & holds(np.where(open_, mid, 0))
        hi = np.where(yes, mid, hi)
        lo = np.where(open_ & ~yes, mid + 1, lo)
    return lo


def highest(first: np.ndarray, end: np.ndarray, below: np.ndarray, rank: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """For each query the largest worth (a whole number from 0) among places first to end whose rank is less than `below`; -1 if
    there is none. A merge-sort tree, level by level; ranks are distinct."""
    n = len(rank)
    best = np.full(len(first), -1, np.int64)
    first, end, rows, level, wide = first.copy(), end.copy(), np.arange(len(first)), 0, max(n, 1) + 1
    open_ = first < end
    rows, first, end = rows[open_], first[open_], end[open_]
    while len(rows):
        block = np.arange(n) >> level
        key = block * wide + rank
        o = np.argsort(key)
        key, run = key[o], np.maximum.accumulate((block * wide + worth)[o])
        for node, use in ((first, (first & 1) == 1), (end - 1, (end & 1) == 1)):
            node, row = node[use] * wide, rows[use]
            j = np.searchsorted(key, node + below[row]) - 1
            some = (j >= 0) & (key[np.maximum(j, 0)] >= node)
            best[row[some]] = np.maximum(best[row[some]], run[j[some]] - node[some])
        first, end, level = (first + 1) >> 1, end >> 1, level + 1
        open_ = first < end
        rows, first, end = rows[open_], first[open_], end[open_]
    return best


def beside(page, x, y, v_page, vx, v0, v1, tol: float, reach: float) -> np.ndarray:
    """Whether each point (x, y) has a vertical (vx from v0 to v1) of its page at no more than `tol` that goes on from there, up or down, by
    `reach`."""
    if not len(vx):
        return np.zeros(len(x), bool)
    o = np.lexsort((vx, v_page))
    v_page, vx, v0, v1 = v_page[o], vx[o], v0[o], v1[o]
    start, stop = np.searchsorted(v_page, page), np.searchsorted(v_page, page, "right")
    first = first_where(start, stop, lambda k: vx[k] - x >= -tol)
    end = first_where(first, stop, lambda k: vx[k] - x > tol)
    o = np.lexsort((v0, v_page))
    rank, low = np.empty(len(o), np.int64), v0[o]
    rank[o] = np.arange(len(o))
    tops, worth = np.unique(v1, return_inverse=True)
    found = np.zeros(len(x), bool)
    for holds, goes in ((lambda k: ~(y - low[k] >= reach), lambda top: top >= y - tol), (lambda k: low[k] > y + tol, lambda top: top - y >= reach)):
        best = highest(first, end, first_where(start, stop, holds), rank, worth)
        found |= (best >= 0) & goes(tops[best])
    return found
