"""Substring deduplication by relative Lempel-Ziv parsing.

A word goes when it lies in a window of WINDOW words that also starts in a document with a smaller id.

1. Each window's smallest gram of GRAM words is its anchor (about one anchor for 22 words), so equal windows have
   equal anchors. Anchors of one document only are dropped; the first document of an anchor is its hub. Documents
   are told apart by their id and a hash of their text (`name`), but only the id says which is before another.
2. Hubs are cut into reference blocks of BLOCK words around their anchors, each indexed by its sorted suffixes.
   A stretch of a document is parsed against every block that one of its anchors leads to: greedily, the longest
   factor at each place. Windows in factors of WINDOW words or more are duplicates, and where two neighbours are
   that long together, the windows over their boundary are looked up.
3. A window can also start in an earlier document that isn't the hub. Those that step 2 didn't find are told
   apart by a 128-bit hash and its smallest document; they are few, as they differ from the hub's text.

Every step is a join or a sum that grows with the input; a passage in a third of all documents is one block that
is joined to its stretches, not a group in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setjoin import bitmap
from .shared import saved
from .words import NOT_SPACE, gram_hashes, slices, words_of

WINDOW, GRAM, BLOCK = 50, 8, 1024
NULL_ID = (1 << 63) - 1


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window of the words' hashes, the place of its smallest gram (the leftmost one)."""
    g = gram_hashes(h, gram)
    n, width = len(h) - window + 1, window - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(g)), 1
    while 2 * size <= width:
        left, right = at[: len(at) - size], at[size:]
        at = np.where(g[right] < g[left], right, left)
        size *= 2
    left, right = at[:n], at[width - size : width - size + n]
    return np.where(g[right] < g[left], right, left)


def _find(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            w = words_of(batch.column("_text"), NOT_SPACE)
            h = w.hashes()
            at = anchors(h, window, gram)
            at = np.unique(at[w.gram_rows(window)])
            value, row = gram_hashes(h, gram)[at] if len(at) else np.zeros(0, np.uint64), w.row[at]
            order = np.lexsort((value, row))
            same = np.zeros(len(at) + 1, bool)
            same[1:-1] = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
            again = np.zeros(len(at), bool)
            again[order] = same[1:] | same[:-1]
            doc, name = (batch.column(c).take(pa.array(row, pa.int64())) for c in ("_id", "_name"))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), doc, name, pa.array(at - w.first[row], pa.int64()), pa.array(again)], names=["anchor", "doc", "name", "pos", "again"])

    return run


def _name(words: list[bytes]) -> tuple[int, int]:
    x = blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


_CUT = "kind int, hub bigint, hub_name bigint, block bigint, doc bigint, name bigint, start bigint, text binary, at array<bigint>, h1 bigint, h2 bigint"


def _cut(window: int, gram: int, size: int):
    """kind 0: a reference block of this hub; 1: a stretch to be parsed against (hub, block), with its anchors'
    places; 2: a window of a hub whose anchor stands in it more than once, or of another text with the hub's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = window - 1
        for batch in slices(batches, "_text", 1 << 20):
            out: list[tuple] = []
            for doc, name, text, marks in zip(*(batch.column(c).to_pylist() for c in ("_id", "_name", "_text", "marks"))):
                words = (text or "").encode().split()
                blocks, ways, twice = set(), {}, set()
                for m in marks:
                    if m["hub"] == doc and m["hub_name"] != name:
                        twice.add(m["pos"])
                    elif m["hub"] == doc:
                        blocks.add(m["pos"] // size)
                        if m["again"]:
                            twice.add(m["pos"])
                    else:
                        ways.setdefault((m["hub"], m["hub_name"], m["hub_pos"] // size), []).append(m["pos"])
                for b in sorted(blocks):
                    a = max(0, b * size - side)
                    out.append((0, doc, name, b, None, None, a, b" ".join(words[a : (b + 1) * size + gram + side]), None, None, None))
                for (hub, hub_name, b), places in sorted(ways.items()):
                    places.sort()
                    lo = 0
                    for k in range(1, len(places) + 1):
                        if k == len(places) or places[k] - places[k - 1] > 2 * window:
                            a = max(0, places[lo] - side)
                            out.append((1, hub, hub_name, b, doc, name, a, b" ".join(words[a : places[k - 1] + gram + side]), [p - a for p in places[lo:k]], None, None))
                            lo = k
                if twice:
                    w = words_of(pa.array([text]), NOT_SPACE)
                    for i, p in enumerate(anchors(w.hashes(), window, gram).tolist()):
                        if p in twice:
                            out.append((2, None, None, None, doc, name, i, None, None, *_name(words[i : i + window])))
            cols = list(zip(*out)) or [()] * 11
            kinds = (pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _CUT.split(", ")])

    return run


class Reference:
    """A block of words, indexed by its suffixes in order (of which the first `window` words count)."""

    def __init__(self, words: list[bytes], window: int = WINDOW) -> None:
        self.words, self.window = words, window
        self.order = sorted(range(len(words)), key=lambda j: words[j : j + window])
        self.keys = [words[j : j + window] for j in self.order]

    def longest(self, words: list[bytes], i: int) -> int:
        """Length of the longest factor that starts at words[i]: a match of up to `window` words, then as far as it goes."""
        want = words[i : i + self.window]
        at = bisect_left(self.keys, want)
        best, place = 0, 0
        for k in (at - 1, at):
            if 0 <= k < len(self.keys):
                n = 0
                for a, b in zip(self.keys[k], want):
                    if a != b:
                        break
                    n += 1
                if n > best:
                    best, place = n, self.order[k]
        if best == self.window:
            while place + best < len(self.words) and i + best < len(words) and self.words[place + best] == words[i + best]:
                best += 1
        return best

    def windows(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Ranges (first, last) of starts of the windows that stand in the block."""
        factors, i = [], 0
        while i < len(words):
            n = max(1, self.longest(words, i))
            factors.append((i, n))
            i += n
        found = [(a, a + n - self.window) for a, n in factors if n >= self.window]
        for (a, n), (b, m) in zip(factors, factors[1:]):
            if n + m >= self.window:  # no window reaches over two boundaries: the second factor would have gone on
                found += [(p, p) for p in range(max(a, b - self.window + 1), b) if self.longest(words, p) >= self.window]
        return found


def _parse(window: int, gram: int):
    """Rows (doc, name, first, last, null, null) of windows found in the block, and (doc, name, start, start, h1, h2) of those still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, reference = None, None
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for doc, name, start, data, at, block in zip(*(part.column(c).to_pylist() for c in ("doc", "name", "start", "text", "at", "block_text"))):
                    if block != known:
                        known, reference = block, Reference(block.split(), window)
                    words = data.split()
                    found = reference.windows(words)
                    out += [(doc, name, start + a, start + z, None, None) for a, z in found]
                    places = anchors(words_of(pa.array([data.decode()]), NOT_SPACE).hashes(), window, gram)
                    mine = np.isin(places, at)
                    for a, z in found:
                        mine[a : z + 1] = False
                    out += [(doc, name, start + i, start + i, *_name(words[i : i + window])) for i in np.flatnonzero(mine).tolist()]
                cols = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "name", "first", "last", "h1", "h2"])

    return run


def _remove(window: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            n, gone, kept, spans = [], [], [], []
            for text, ranges in zip(batch.column("_text").to_pylist(), batch.column("ranges").to_pylist()):
                words = (text or "").encode().split()
                n.append(len(words))
                if not ranges:
                    gone.append(0)
                    kept.append(b" ".join(words).decode())
                    spans.append([])
                    continue
                step = np.zeros(len(words) + 1, np.int64)
                for r in ranges:
                    step[r["first"]] += 1
                    step[min(r["last"] + window, len(words))] -= 1
                out = np.cumsum(step)[:-1] > 0
                edge = np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))
                spans.append([{"start": a, "end": z} for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
                gone.append(int(out.sum()))
                kept.append(b" ".join(x for x, o in zip(words, out.tolist()) if not o).decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[*keep, "n_words", "n_removed", "kept", "spans"],
            )

    return run


def _ranges(d: DataFrame, window: int, gram: int, block: int) -> DataFrame:
    """(doc, name, first, last): ranges of starts of duplicate windows; d: (_id bigint not null, _name bigint, _text)."""
    found = d.mapInArrow(_find(window, gram), "anchor bigint, doc bigint, name bigint, pos bigint, again boolean")
    hubs = found.groupBy("anchor").agg(F.min(F.struct("doc", "name", "pos")).alias("_a"), F.max("doc").alias("_z")).where("_a.doc <> _z")
    hubs = hubs.select("anchor", F.col("_a.doc").alias("hub"), F.col("_a.name").alias("hub_name"), F.col("_a.pos").alias("hub_pos"))
    marks = found.join(hubs, "anchor").groupBy("doc", "name").agg(F.collect_set(F.struct("pos", "again", "hub", "hub_name", "hub_pos")).alias("marks"))
    marks = saved(marks, "marks")
    test = bitmap(marks.select(F.col("name").alias("_name")), "_name")
    none = d.sparkSession.createDataFrame([], "doc bigint, name bigint, first bigint, last bigint")
    if test is None:
        return none
    mine = (F.col("_id") == F.col("doc")) & (F.col("_name") == F.col("name"))
    cut = d.where(test).join(marks, mine).select("_id", "_name", "_text", "marks").mapInArrow(_cut(window, gram, block), _CUT)
    cut = saved(cut, "cut")
    blocks = cut.where("kind = 0").select("hub", "hub_name", "block", F.col("text").alias("block_text"))
    parsed = cut.where("kind = 1").join(blocks, ["hub", "hub_name", "block"]).select("doc", "name", "start", "text", "at", "block_text").mapInArrow(_parse(window, gram), "doc bigint, name bigint, first bigint, last bigint, h1 bigint, h2 bigint")
    parsed = saved(parsed, "parsed")
    rest = parsed.where("h1 is not null").unionByName(cut.where("kind = 2").select("doc", "name", F.col("start").alias("first"), F.col("start").alias("last"), "h1", "h2"))
    shared = rest.groupBy("h1", "h2").agg(F.min("doc").alias("_a"), F.max("doc").alias("_z")).where("_a <> _z").drop("_z")
    late = rest.join(shared, ["h1", "h2"]).where("doc > _a").select("doc", "name", "first", "last")
    return parsed.where("h1 is null").select("doc", "name", "first", "last").unionByName(late)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of `docs`: the id (and the columns in `keep`), n_words, n_removed, kept (the words that
    stay, joined by one space) and spans of removed words.

    Ids are integers; a row without one counts as the last of all. A null or empty text has no words. Windows
    are judged on the input. Rows of one id (or none) aren't before one another, whether their texts are equal or
    not: each keeps its text unless an earlier id has it. An empty table gives no rows.
    """
    names = [id_col, *(keep or [])]
    inner = [f"_k{i}" for i in range(len(names))]
    d = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)), F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID)).alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).withColumn("_name", F.xxhash64("_text"))
    kinds = ", ".join(f"{i} {d.schema[i].dataType.simpleString()}" for i in inner)
    ranges = _ranges(d.select("_id", "_name", "_text"), window, gram, block)
    ranges = saved(ranges.groupBy("doc", "name").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
    test = bitmap(ranges.select(F.col("name").alias("_name")), "_name")
    bare = F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("ranges")
    if test is None:
        both = d.select(*inner, "_text", bare)
    else:
        both = d.where(~test).select(*inner, "_text", bare).unionByName(d.where(test).join(ranges, (F.col("_id") == F.col("doc")) & (F.col("_name") == F.col("name")), "left").select(*inner, "_text", "ranges"))
    out = both.mapInArrow(_remove(window, inner), f"{kinds}, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>")
    return out.withColumnsRenamed(dict(zip(inner, names)))
