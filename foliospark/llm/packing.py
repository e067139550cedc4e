"""Best-fit packing with exact-complement hashing.

Pieces are counted by length, which leaves at most `size` numbers whatever the corpus. From the longest down, a
length's gap is looked up among single lengths, sums of two and sums of three, and as many bins as the
availability counts allow are filled exactly. What remains is packed best-fit, again by counts. The plan says
which ranks within a length go to which bins; pieces get their rank without any task holding a whole length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import salted_rank
from .shared import saved
from .words import slices

SIZE, END = 4096, 1
CACHE = 250_000
#: Lower-case letters of Latin scripts and marks after them: words that need no normalisation beyond lower case.
_PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's.

    For a tokenizer that drops white space, ids of a text are those of its space-separated parts. Parts are kept
    in two bounded caches (whole parts, bare words). Plain words go to the tokenizer's model, others through all of it.
    """

    def __init__(self, path: str, most: int = CACHE) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {"": b""}
        self.plain: dict[str, bytes] = {}
        self.most = most
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in keep]
        self.letters = {chr(b): chr(b) for b in keep} | {chr(b): chr(256 + i) for i, b in enumerate(odd)}
        self.letters = str.maketrans(self.letters)

    def _bare(self, word: str) -> bytes:
        found = self.plain.get(word)
        if found is None:
            if len(self.plain) >= self.most:
                self.plain.clear()
            tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
            found = self.plain[word] = np.array([t.id for t in tokens], "<u4").tobytes()
        return found

    def _part(self, part: str) -> bytes:
        m = _PLAIN.fullmatch(part) if len(part) < 64 else None
        if m:
            out = self._bare(m[1].lower()) + (self._bare(m[2]) if m[2] else b"")
        else:
            out = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def __call__(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        seen = self.parts
        try:
            return b"".join([seen[p] for p in parts])
        except KeyError:
            if len(seen) >= self.most:
                seen.clear()
                seen[""] = b""
            for p in parts:
                if p not in seen:
                    seen[p] = self._part(p)
            return b"".join([seen[p] for p in parts])


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, size: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        tail = int(end).to_bytes(4, "little")
        for batch in slices(batches, "_text"):
            row, cols, ids = [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                data = encode(text or "") + tail
                n = len(data) // 4
                for k, a in enumerate(range(0, n, size)):
                    part = data[4 * a : 4 * (a + size)]
                    row.append(i)
                    cols.append((k, a, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [batch.column("_id").take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*cols), (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "ids"][: len(arrays)])

    return run


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(bins, lengths of the pieces in each) for all pieces. counts: pieces of each length, 1 to size."""
    free = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        free[n] = c
    out: list[tuple[int, list[int]]] = []
    if free[size]:
        out.append((int(free[size]), [size]))
        free[size] = 0

    def take(lengths: list[int]) -> bool:
        need = {x: lengths.count(x) for x in lengths}
        m = min(int(free[x]) // k for x, k in need.items())
        if m <= 0:
            return False
        for x, k in need.items():
            free[x] -= m * k
        out.append((m, lengths))
        return True

    def pair(gap: int, first: int) -> tuple[int, int] | None:
        """The two lengths of this sum whose larger one is largest, given that a `first` is used up."""
        a = np.arange(1, gap // 2 + 1)
        b = gap - a
        have_a, have_b = free[a] - (a == first), free[b] - (b == first)
        ok = np.flatnonzero((have_a > 0) & (have_b > 0) & ((a != b) | (have_a > 1)))
        return (int(a[ok[0]]), int(b[ok[0]])) if len(ok) else None

    pair_sums, stale = None, 0

    def triple(gap: int, first: int) -> tuple[int, int, int] | None:
        nonlocal pair_sums, stale
        if pair_sums is None or stale > 64:
            have = (free > 0).astype(np.float32)
            width = 1 << (2 * size + 1).bit_length()
            pair_sums, stale = np.fft.irfft(np.fft.rfft(have, width) ** 2, width)[: size + 1] > 0.5, 0
        c = np.arange(gap - 2, 0, -1)
        for x in c[(free[c] - (c == first) > 0) & pair_sums[gap - c]].tolist():
            free[x] -= 1
            found = pair(gap - x, first)
            free[x] += 1
            if found:
                return (x, *found)
            stale += 1
        return None

    for n in range(size - 1, 0, -1):
        gap = size - n
        while free[n] > 0:
            if gap <= size and free[gap] > (gap == n) and take([n, gap]):
                continue
            found = pair(gap, n)
            if found and take([n, *found]):
                continue
            more = triple(gap, n) if gap > 2 else None
            if not (more and take([n, *more])):
                break
    # best fit for what is left, longest first
    gaps: list[int] = []
    open_: dict[int, list[tuple[int, list[int]]]] = {}

    def put(gap: int, bins: int, lengths: list[int]) -> None:
        if gap not in open_:
            bisect.insort(gaps, gap)
            open_[gap] = []
        open_[gap].append((bins, lengths))

    for n in range(size, 0, -1):
        k = int(free[n])
        while k:
            at = bisect.bisect_left(gaps, n)
            if at < len(gaps):
                gap = gaps[at]
                bins, lengths = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
                m = min(k, bins)
                if bins > m:
                    put(gap, bins - m, lengths)
                put(gap - n, m, [*lengths, n])
                k -= m
            else:
                each = min(size // n, k)
                put(size - each * n, k // each, [n] * each)
                k %= each
    return out + [x for g in gaps for x in open_[g]]


def plan_rows(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, bin, offset): pieces of rank lo to hi - 1 go to bins from `bin` on, at that offset."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for m, lengths in bins:
        offset = 0
        for n in lengths:
            lo = used.get(n, 0)
            used[n] = lo + m
            rows.append((n, lo, lo + m, first, offset))
            offset += n
        first += m
    return rows


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: the id, piece, start, length, ids_crc32, sequence_id and offset (and ids if asked for).

    A document's ids are the tokenizer's, then `end`; only longer ones than `size` are cut. `tokenizer` is a
    file that all machines have, of a tokenizer that drops white space. A null or empty text is one piece of
    the end id alone. Repeated rows are packed each on its own; an empty table gives no rows.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kinds = f"_id {d.schema['_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    pieces = saved(d.mapInArrow(_pieces(tokenizer, size, end, with_ids), kinds), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # `size` rows at most
    plan = docs.sparkSession.createDataFrame(plan_rows(plan_bins(counts, size)), "length bigint, _lo bigint, _hi bigint, _bin bigint, offset bigint")
    ranked = salted_rank(pieces, ["length"], ["_id", "piece", "ids_crc32"], "_rank")
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).drop(plan["length"])
    out = placed.withColumn("sequence_id", F.col("_bin") + F.col("_rank") - F.col("_lo"))
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
