"""Vectorised word handling over Arrow string columns.

Texts are handled as one UTF-8 buffer per slice, so that finding words and hashing them costs a few
nanoseconds a byte. A slice holds about SLICE_BYTES of text, or a single longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
LONG_WORD = 4096

_b = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, every other byte as it is.
LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)
#: Bytes of words of [^\x20\x09-\x0D]+ and, after lower-casing, of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_SPACE = ~((_b == 32) | ((_b >= 9) & (_b <= 13)))
ALNUM = ((_b >= 48) & (_b <= 57)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def span_hashes(padded: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans. `padded` ends in 8 spare bytes."""
    n = len(starts)
    h = mix(lens.astype(np.uint64) * _K[0] + _K[3])
    if not n:
        return h
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    at, left, who = starts, lens, None
    long = np.flatnonzero(lens > LONG_WORD)
    first = True
    while True:
        if first:
            h = mix((h ^ (words[at] & _MASKS[np.minimum(left, 8)])) * _K[3] + _K[0])
            keep = np.flatnonzero((left > 8) & (left <= LONG_WORD))
            who, at, left, first = keep, at[keep] + 8, left[keep] - 8, False
        else:
            h[who] = mix((h[who] ^ (words[at] & _MASKS[np.minimum(left, 8)])) * _K[3] + _K[0])
            keep = left > 8
            who, at, left = who[keep], at[keep] + 8, left[keep] - 8
        if not len(who):
            break
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : starts[i] + lens[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words; one for each start, len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = (out ^ (out >> np.uint64(29))) * _K[1] + h[j : j + m]
    return mix(out)


@dataclass
class Words:
    """Words of a slice of texts: byte spans, the row of each, and each row's first word (with the end)."""

    padded: np.ndarray
    starts: np.ndarray
    lens: np.ndarray
    row: np.ndarray
    first: np.ndarray
    text_at: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.padded, self.starts, self.lens)

    def word(self, i: int) -> bytes:
        return self.padded[self.starts[i] : self.starts[i] + self.lens[i]].tobytes()

    def gram_rows(self, n: int) -> np.ndarray:
        """Starts of n consecutive words that lie within one row."""
        m = len(self.row) - n + 1
        return np.flatnonzero(self.row[:m] == self.row[n - 1 :]) if m > 0 else np.zeros(0, np.int64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, with 8 spare zero bytes, and each text's offset (with the end). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    size = int(at[-1] - at[0])
    padded = np.zeros(size + 8, np.uint8)
    if size:
        padded[:size] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return padded, at - at[0]


def words_of(column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    padded, at = buffer_of(column)
    if lower:
        padded = LOWER[padded]
    size = len(padded) - 8
    inside = kind[padded[:size]] if size else np.zeros(0, bool)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < size)]  # words don't reach over texts
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    lens = np.flatnonzero(ends) + 1 - starts
    first = np.searchsorted(starts, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(padded, starts, lens, row, first, at)


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[i]:edges[i+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), np.int64)
        group = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        lo = 0
        for hi in [*cuts.tolist(), n]:
            if hi > lo:
                yield batch.slice(lo, hi - lo)
            lo = hi


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a span of `length` from one of the starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1) if len(starts) and len(np.unique(starts)) != len(starts) else step.__setitem__(starts, 1)
    ends = np.zeros(n + 1, np.int32)
    np.add.at(ends, np.minimum(starts + length, n), 1)
    return np.cumsum(step - ends)[:n] > 0


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
