"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of `window` consecutive words of a benchmark item; an item with fewer words is one
shorter pattern. Patterns of one length share a table set: SHIFT says, for the block of the last two words
under the cursor, how many words can be skipped; a shift of 0 selects, by the same block as suffix, a bucket
of patterns; the hash of a pattern's first words and then the words themselves are compared. The cursors of
a slice of documents advance together, so that each step is one numpy operation.

The benchmark is read in blocks of at most BLOCK_BYTES of item text. Each block is its own broadcast, and a
worker holds one block's tables at a time, so a benchmark of any size works with bounded memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, Words, mix, slices, sums, words_of

WINDOW = 13
BLOCK_BYTES = 8 << 20
_A = np.uint64(0x9E3779B97F4A7C15)


def _block(h: np.ndarray, last: np.ndarray, size: int, bits: int) -> np.ndarray:
    x = h[last] if size == 1 else mix(h[last - 1] * _A) ^ h[last]
    return (mix(x) >> np.uint64(64 - bits)).astype(np.int64)


def tables(items: list[tuple[object, str]], window: int = WINDOW) -> list[dict]:
    """One table set for each pattern length that the items have."""
    w = words_of(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
    h = w.hashes()
    found: dict[int, dict[bytes, tuple[int, list[int]]]] = {}
    for i in range(len(items)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if a == b:
            continue
        m = min(window, b - a)
        own = [w.word(k) for k in range(a, b)]
        for k in range(b - a - m + 1):
            at, names = found.setdefault(m, {}).setdefault(b" ".join(own[k : k + m]), (a + k, []))
            if not names or names[-1] != i:
                names.append(i)
    out = []
    for m, patterns in sorted(found.items()):
        size = min(2, m)
        bits = max(10, min(22, int(np.ceil(np.log2(len(patterns) * m * 16 + 1)))))
        first = np.array([at for at, _ in patterns.values()], np.int64)
        words = h[first[:, None] + np.arange(m)]
        shift = np.full(1 << bits, m - size + 1, np.uint8 if m < 255 else np.int32)
        for j in range(size - 1, m):
            np.minimum.at(shift, _block(h, first + j, size, bits), m - 1 - j)
        suffix = _block(h, first + m - 1, size, bits)
        order = np.argsort(suffix, kind="stable")
        blocks, begin = np.unique(suffix[order], return_index=True)
        texts = list(patterns)
        names = [patterns[texts[k]][1] for k in order]
        out.append({"m": m, "size": size, "bits": bits, "shift": shift, "blocks": blocks, "begin": np.append(begin, len(order)), "words": words[order], "texts": [texts[k] for k in order], "items": names, "names": [x for x, _ in items]})
    return out


def occurrences(t: dict, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each occurrence in the slice's words, and its pattern."""
    m, size, shift, n = t["m"], t["size"], t["shift"], len(h)
    if n < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes = max(1, min(1 << 15, (n - m + 1) // 64))
    edges = np.linspace(m - 1, n, lanes + 1).astype(np.int64)
    at, end = edges[:-1].copy(), edges[1:]
    hits, kinds = [], []
    while len(at):
        block = _block(h, at, size, t["bits"])
        skip = shift[block].astype(np.int64)
        zero = np.flatnonzero(skip == 0)
        if len(zero):
            hits.append(at[zero])
            kinds.append(block[zero])
        at = at + np.maximum(skip, 1)
        live = at < end
        if not live.all():
            at, end = at[live], end[live]
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last, block = np.concatenate(hits), np.concatenate(kinds)
    same = w.row[last - m + 1] == w.row[last]
    k = np.minimum(np.searchsorted(t["blocks"], block), len(t["blocks"]) - 1)
    same &= t["blocks"][k] == block
    last, k = last[same], k[same]
    count = t["begin"][k + 1] - t["begin"][k]
    start = np.repeat(last - m + 1, count)
    pattern = np.repeat(t["begin"][k], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    for j in [*range(size), *range(size, m)]:  # the prefix first, as most candidates end there
        ok = h[start + j] == t["words"][pattern, j]
        start, pattern = start[ok], pattern[ok]
        if not len(start):
            break
    sure = np.fromiter((b" ".join(w.word(i) for i in range(s, s + m)) == t["texts"][p] for s, p in zip(start.tolist(), pattern.tolist())), bool, len(start))
    return start[sure], pattern[sure]


def _search(blocks: list, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = [pickle.loads(b.value) for b in blocks] if len(blocks) == 1 else None
        for batch in slices(batches, most=(4 if alone else 16) << 20):
            w = words_of(batch.column("text"), ALNUM, lower=True)
            h = w.hashes()
            depth = np.zeros(len(h) + 1, np.int32)
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for b in range(len(blocks)):
                for t in alone[b] if alone else pickle.loads(blocks[b].value):
                    start, pattern = occurrences(t, w, h)
                    np.add.at(depth, start, 1)
                    np.subtract.at(depth, start + t["m"], 1)
                    for r, p in zip(w.row[start].tolist(), pattern.tolist()):
                        items[r].update(str(t["names"][i]) for i in t["items"][p])
                if not alone:
                    blocks[b].__dict__.pop("_value", None)  # the next use reads it from this machine's disk again
            hit = np.cumsum(depth)[: len(h)] > 0
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            spans: list[list] = [[] for _ in items]
            for s, e in zip(a.tolist(), z.tolist()):
                while s < e:  # a run can go on in the next row
                    r = int(w.row[s])
                    stop = min(e, int(w.first[r + 1]))
                    spans[r].append({"start": s - int(w.first[r]), "end": stop - int(w.first[r])})
                    s = stop
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.diff(w.first), pa.int64()), pa.array(sums(hit, w.first), pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[*keep, "n_words", "n_hit", "items", "spans"],
            )

    return run


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast table sets, each for at most `block_bytes` of item text (or one longer item)."""
    context, out, block, size = benchmark.sparkSession.sparkContext, [], [], 0
    for name, t in benchmark.select(F.col(item), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        if block and size + len(t) > block_bytes:
            out.append(context.broadcast(pickle.dumps(tables(block, window), 5)))
            block, size = [], 0
        block.append((name, t))
        size += len(t)
    out.append(context.broadcast(pickle.dumps(tables(block, window), 5)))
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Words of each document that lie in a benchmark window.

    Returns a row for each row of `docs`: the id (and the columns named in `keep`), n_words, n_hit (words in
    any occurrence), items (sorted item ids, as strings, with an occurring window) and spans of hit words.
    A null or empty text has no words; a null item text is no pattern; a null item id reads "None"; repeated
    rows stay repeated; with an empty benchmark nothing is hit. Other columns of `docs` are not used.
    """
    names = [id_col, *(keep or [])]
    inner = [f"_k{i}" for i in range(len(names))]
    d = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = ", ".join(f"{i} {d.schema[i].dataType.simpleString()}" for i in inner)
    found = d.mapInArrow(_search(benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes), inner), f"{kinds}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>")
    return found.withColumnsRenamed(dict(zip(inner, names)))


def contaminated(n_hit, n_words):
    """The contamination rule: at least one word in 20 is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
