"""LM scoring with a log-frequency Bloom filter.

Training counts of words and word pairs are quantised: a count's level is the number of THRESHOLDS it reaches, and
the filter holds (n-gram, 1) to (n-gram, level). A count is read by probing levels until one is missing, and stands
for the least count of its level. Scores mix the pair's and the word's probability (Jelinek-Mercer), both read from
the filter; a token after an unseen one has the word's alone.

Scores are probabilities: over all training words and one unknown word, those after any context sum to 1 at most.
Words are divided by the sum of what the filter says of them, known once it is made. Pairs are divided by the most that
their context may have been seen, and by what the filter may claim falsely of a whole vocabulary (Model.spare); the
weight of pairs shrinks alike, so rare contexts lean on the word. To keep the false claims few, the number of probes
and the bits of a key follow the input: about one false pair in a vocabulary.

Documents are cut into slices, which are written as tokens once: a slice's distinct words as hashes, and each token as a
place in them. Counting and scoring read these.

Counting: a task adds up the distinct n-grams of its slices, up to COUNT_KEYS of them, and sends the
sums packed by shard (upper bits of the hash), so that a shard has bounded size and a frequent word at most one
entry for each sum. The number of shards follows the input. Each shard makes its part of the filter and keeps the words' exact counts, which the base score needs.

The parts are broadcast together if they have at most MOST_FILTER bytes. Beyond that each slice sends the n-grams
it needs to their shards, and the levels come back, which is the same as what a broadcast filter says. A slice sends a row to
each shard that it needs, at most one for each of its distinct n-grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved
from .words import NOT_SPACE, mix, slices, words_of

#: Bytes of a slice of texts and of texts a shard; the largest filter that is broadcast (every Python worker holds a copy of it).
SLICE, SHARD_BYTES, MOST_FILTER = 4 << 20, 16 << 20, 32 << 20
PAIR_WEIGHT, ADD = 0.3, 0.5
#: Fewest and most probes; bytes of text that give a new word, roughly.
LEAST_PROBES, MOST_PROBES, BYTES_A_WORD = 8, 32, 64
END, START = np.uint64(0x5F3759DF9E3779B1), np.uint64(0xC2B2AE3D27D4EB4F)
#: Probes after which keys that missed one are left out.
STRIDE = 4
#: N-grams whose counts a task adds up before it sends them.
COUNT_KEYS = 1 << 21
#: Counts from which the levels start: about two to a doubling.
THRESHOLDS = np.unique(np.round(2 ** (np.arange(80) / 2)).astype(np.int64))
#: The least and the most count of a level; level 0 is not seen.
LOW = np.concatenate([[0.0], THRESHOLDS])
MOST = np.concatenate([[0.0], THRESHOLDS[1:] - 1.0, [np.inf]])
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def pair_keys(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix(mix(before + _A) + now * _B)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    width = x.dtype.itemsize
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes() or b"\0", "zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def pack_keys(keys: np.ndarray, drop: int = 0) -> bytes:
    return packed(np.diff(keys >> np.uint64(drop), prepend=np.uint64(0)))


def unpack_keys(data: bytes, drop: int = 0) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64) << np.uint64(drop)


def probes_for(size: int) -> int:
    """Probes for so many bytes of text: false positives of one in the words they have, or fewer."""
    return int(min(MOST_PROBES, max(LEAST_PROBES, np.ceil(np.log2(max(1, size / BYTES_A_WORD))))))


def drop_for(probes: int) -> int:
    """Low bits that the filter's keys can do without: with the others, two n-grams are taken for one no oftener than probes err.
    A text has about 2 ** (probes + 4) n-grams."""
    return 64 - min(64, max(40, 2 * probes + 6))


def shortened(keys: np.ndarray, drop: int) -> np.ndarray:
    return keys >> np.uint64(drop) << np.uint64(drop)


class Filter:
    """Parts of a log-frequency Bloom filter, one for each shard; it looks at keys as `shortened`."""

    def __init__(self, parts: list[np.ndarray], probes: int) -> None:
        self.size = np.array([8 * len(p) for p in parts], np.uint64)
        self.at = np.concatenate([[0], np.cumsum(self.size)]).astype(np.uint64)
        self.bits = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        self.probes = probes

    @staticmethod
    def _start(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(keys + np.full(1, level, np.uint64) * _A)
        return x, mix(x) | np.uint64(1)

    @staticmethod
    def _place(x: np.ndarray, size: int) -> np.ndarray:
        """A place in a part of `size` bits, fewer than 2 ** 32."""
        return (((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).view(np.int64)

    @classmethod
    def part(cls, keys: np.ndarray, counts: np.ndarray, probes: int) -> np.ndarray:
        """The bytes of a part that holds these n-grams; it is at most half full."""
        keys, levels = shortened(keys, drop_for(probes)), np.searchsorted(THRESHOLDS, counts, "right")
        n_bytes = max(8, -(-int(np.ceil(probes / np.log(2) * levels.sum())) // 8))
        bits = np.zeros(8 * n_bytes, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            x, y = cls._start(keys[levels >= level], level)
            for i in range(probes):
                bits[cls._place(x + np.uint64(i) * y, len(bits))] = True
        return np.packbits(bits, bitorder="little")

    def levels(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        keys, out = shortened(keys, drop_for(self.probes)), np.zeros(len(keys), np.uint8)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own, s = order[a:z], int(shard[order[a]])
            out[own] = self._of_part(keys[own], self.bits[int(self.at[s]) // 8 : int(self.at[s] + self.size[s]) // 8])
        return out

    def _of_part(self, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        out, size = np.zeros(len(keys), np.uint8), 8 * len(part)
        # a byte a bit is read faster, and is worth making for many keys
        bits = np.unpackbits(part, bitorder="little").view(bool) if self.probes * len(keys) > size else None
        live = np.arange(len(keys))
        for level in range(1, len(THRESHOLDS) + 1):
            if not len(live):
                break
            x, y = self._start(keys[live], level)
            for first in range(0, self.probes, STRIDE):  # those that miss a probe need no other
                ok = np.ones(len(live), bool)
                for i in range(first, min(first + STRIDE, self.probes)):
                    at = self._place(x + np.uint64(i) * y, size)
                    ok &= bits[at] if bits is not None else (part[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                if not ok.all():
                    live, x, y = live[ok], x[ok], y[ok]
            out[live] = level
        return out


@dataclass(frozen=True)
class Model:
    """What turns levels into probabilities."""

    tokens: int  # training tokens
    words: int  # distinct ones
    total: float  # sum of the words' counts as the filter gives them
    false: float  # false positive rate of the fullest part
    pair_weight: float = PAIR_WEIGHT

    @property
    def spare(self) -> float:
        """More false counts than the filter gives to a context over all words: their mean and six deviations."""
        mean = 1.5 * self.false * (self.words + 1)
        return mean + 6 * mean**0.5 + 3

    def probability(self, pair: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of tokens with these levels, after contexts with these."""
        p_word = (LOW[word] + ADD) / (self.total + ADD * (self.words + 1))
        most = 1.01 * MOST[context] + self.spare
        weight = self.pair_weight * LOW[context] / most
        return (1 - weight) * p_word + weight * np.minimum(1.0, LOW[pair] / most)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.tokens + ADD * (self.words + 1))


class Tokens:
    """The tokens of a slice: words in lower case (A-Z), then an end for each text."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        w = words_of(batch.column("_text"), NOT_SPACE, lower=True)
        self.first = w.first + np.arange(w.rows + 1)
        self.now = np.full(len(w.row) + w.rows, END, np.uint64)
        self.now[np.arange(len(w.row)) + w.row] = w.hashes()
        self.held_out = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in batch.column("_id").to_pylist()], bool)


_SLICE = {"split": pa.int64(), "size": pa.int64(), "data": pa.binary()}


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slice: a random name, bytes of text, and the slice as `Slice` reads it."""
    import os

    for batch in slices(batches, "_text", SLICE):
        t = Tokens(batch)
        words, word = np.unique(t.now, return_inverse=True)
        sink = pa.BufferOutputStream()
        rest = batch.drop_columns(["_text"])
        with pa.ipc.new_stream(sink, rest.schema) as to:
            to.write_batch(rest)
        parts = [sink.getvalue().to_pybytes(), packed(t.first.astype("<u4")), packed(word.astype("<u4")), packed(t.held_out.astype(np.uint8)), pack_keys(words)]
        size = int(pc.sum(pc.binary_length(batch.column("_text"))).as_py() or 0)
        yield _batch([(int.from_bytes(os.urandom(8), "little", signed=True), size, b"".join(len(x).to_bytes(8, "little") + x for x in parts))], _SLICE)


class Slice:
    """Some documents: their other columns (rows), each one's first token, its distinct words in order, and tokens as places in them."""

    def __init__(self, data: bytes) -> None:
        parts = []
        while data:
            size = int.from_bytes(data[:8], "little")
            parts.append(data[8 : 8 + size])
            data = data[8 + size :]
        self.rows = pa.ipc.open_stream(parts[0]).read_all().combine_chunks()
        self.first, self.word = unpacked(parts[1], "<u4").astype(np.int64), unpacked(parts[2], "<u4").astype(np.int64)
        self.held_out, self.words = unpacked(parts[3], "u1") == 1, unpack_keys(parts[4])

    def context(self) -> np.ndarray:
        """The place of each token's context: the word before, or len(words) at the start of a text."""
        out = np.concatenate([[0], self.word[:-1]]) if len(self.word) else self.word.copy()
        out[self.first[:-1]] = len(self.words)
        return out

    def pairs(self) -> np.ndarray:
        return pair_keys(np.append(self.words, START)[self.context()], self.words[self.word])

    def grams(self, drop: int) -> tuple[np.ndarray, ...]:
        """The distinct n-grams, shortened, in order, and the places in them of each token's pair, its word and its context."""
        grams, gram = np.unique(shortened(np.concatenate([self.words, [START], self.pairs()]), drop), return_inverse=True)
        own = gram[: len(self.words) + 1]
        return grams, gram[len(self.words) + 1 :], own[self.word], own[self.context()]


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    s = shard_of(keys, shards)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]])
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if z > a:
            yield int(s[a]), a, z


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], names=list(kinds))


_COUNT = {"shard": pa.int32(), "kind": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, with the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(shards: int, drop: int):
    """Rows of counts for the shards: of words (kind 0) with their whole keys, of pairs and starts (kind 1) with shortened ones."""

    def sent(held: tuple[list, list]) -> pa.RecordBatch:
        out = []
        for kind, parts in enumerate(held):
            keys, counts = _added(parts)
            out += [(s, kind, pack_keys(keys[a:z], kind * drop), packed(counts[a:z].astype("<u4"))) for s, a, z in _by_shard(keys, shards)]
            parts.clear()
        return _batch(out, _COUNT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for batch in batches:
            for data in batch.column("data"):
                t = Slice(data.as_py())
                train = np.repeat(~t.held_out, np.diff(t.first))
                times = np.bincount(t.word[train], minlength=len(t.words))
                held[0].append((t.words[times > 0], times[times > 0]))
                held[1].append(np.unique(shortened(np.concatenate([t.pairs()[train], np.full(int((~t.held_out).sum()), START)]), drop), return_counts=True))
                if sum(len(k) for parts in held for k, _ in parts) >= COUNT_KEYS:
                    yield sent(held)
        yield sent(held)

    return run


_SHARD = {"shard": pa.int32(), "part": pa.binary(), "keys": pa.binary(), "counts": pa.binary(), "words": pa.int64(), "tokens": pa.int64(), "total": pa.float64(), "false": pa.float64()}


def _merged(table: pa.Table, kind: int, drop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    return _added([(unpack_keys(k, drop), unpacked(c, "<u4")) for q, k, c in zip(*(table.column(x).to_pylist() for x in ("kind", "keys", "counts"))) if q == kind])


def _shard(probes: int, shards: int):
    drop = drop_for(probes)

    def run(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table, 0)
        more, times = _merged(table, 1, drop)
        part = Filter.part(np.concatenate([keys, more]), np.concatenate([counts, times]), probes)
        total = float(LOW[Filter([part], probes).levels(keys, np.zeros(len(keys), np.int64))].sum())
        false = float((np.unpackbits(part).sum() / (8 * len(part))) ** probes) + shards * (len(keys) + len(more)) / 2.0 ** (64 - drop)
        row = (table.column("shard")[0].as_py(), part.tobytes(), pack_keys(keys), packed(counts.astype("<u8")), len(keys), int(counts.sum()), total, false)
        return pa.Table.from_batches([_batch([row], _SHARD)])

    return run


_ASK = {"split": pa.int64(), "shard": pa.int32(), "kind": pa.int32(), "data": pa.binary()}


def _ask(shards: int, pairs_too: bool, drop: int):
    """Rows for the shards: the words (kind 0), and without a broadcast filter the n-grams (kind 1), that a slice needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split, data in zip(batch.column("split").to_pylist(), batch.column("data")):
                t = Slice(data.as_py())
                out = [(split, s, 0, pack_keys(t.words[a:z])) for s, a, z in _by_shard(t.words, shards)]
                if pairs_too:
                    grams = t.grams(drop)[0]
                    out += [(split, s, 1, pack_keys(grams[a:z], drop)) for s, a, z in _by_shard(grams, shards)]
                yield _batch(out, _ASK)

    return run


def _scores(levels, of_pair, of_word, of_context, first, model: Model) -> np.ndarray:
    p = model.probability(levels[of_pair], levels[of_word], levels[of_context])
    return np.add.reduceat(np.log10(p), first[:-1]) if len(first) > 1 else np.zeros(0)


def _answer(probes: int):
    """The words' exact counts and the n-grams' levels, for each asking split."""

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        out = []
        if shard.num_rows:
            keys, counts = unpack_keys(shard.column("keys")[0].as_py()), unpacked(shard.column("counts")[0].as_py(), "<u8")
            part = Filter([np.frombuffer(shard.column("part")[0].as_py(), np.uint8)], probes)
        rows = list(zip(*(asked.column(c).to_pylist() for c in _ASK)))
        for kind in (0, 1):
            own = [r for r in rows if r[2] == kind]
            if not own:
                continue
            wants = [unpack_keys(r[3], kind * drop_for(probes)) for r in own]
            want, place = np.unique(np.concatenate(wants), return_inverse=True)  # many slices ask the same
            found = np.zeros(len(want), "<u8" if kind == 0 else np.uint8)
            if kind and shard.num_rows:
                found = part.levels(want, np.zeros(len(want), np.int64))
            elif shard.num_rows and len(keys):
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                found = np.where(keys[at] == want, counts[at], 0).astype("<u8")
            edges = np.cumsum([0, *map(len, wants)])
            out += [(split, s, kind, packed(found[place[a:z]])) for (split, s, _, _), a, z in zip(own, edges[:-1], edges[1:])]
        return pa.Table.from_batches([_batch(out, _ASK)])

    return run


def _finish(model: Model, kinds: pa.Schema, shards: int, filter_b, drop: int):
    def run(answers: pa.Table, own: pa.Table) -> pa.Table:
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "data"))), key=lambda r: r[:2])
        t = Slice(own.column("data")[0].as_py())
        count = np.concatenate([unpacked(d, "<u8") for k, _, d in rows if k == 0])[t.word].astype(np.float64)
        grams, *places = t.grams(drop)
        levels = filter_b.value.levels(grams, shard_of(grams, shards)) if filter_b is not None else np.concatenate([unpacked(d, "u1") for k, _, d in rows if k == 1])
        base = np.add.reduceat(np.log10(model.base(count)), t.first[:-1])
        known = np.add.reduceat((count > 0).astype(np.int64), t.first[:-1])
        more = [pa.array(t.held_out), pa.array(np.diff(t.first)), pa.array(known), pa.array(np.full(len(base), model.tokens)), pa.array(base), pa.array(_scores(levels, *places, t.first, model))]
        names = [c for c in t.rows.column_names if c != "_id"]
        return pa.Table.from_arrays([*(t.rows.column(c) for c in names), *more], names=kinds.names)

    return run


def sliced(d: DataFrame) -> DataFrame:
    """d (_id, _text, and columns that stay) as a table of slices, which can be joined by `split` where it lies."""
    buckets = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(d.mapInArrow(_sliced, "split bigint, size bigint, data binary"), "slices", (buckets, "split"))


def train(d: DataFrame, **options) -> tuple[DataFrame, Model, int, int]:
    """As train_slices, on (_id, _text)."""
    return train_slices(sliced(d), **options)


def train_slices(held: DataFrame, *, pair_weight: float = PAIR_WEIGHT, slice_shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, Model, int, int]:
    """The filter's parts with the words' exact counts, a row for each shard; the model; probes and shards."""
    size = held.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards, probes = max(4, -(-size // slice_shard_bytes)), probes_for(size)
    counted = held.select("data").mapInArrow(_count(shards, drop_for(probes)), "shard int, kind int, keys binary, counts binary")
    kinds = "shard int, part binary, keys binary, counts binary, words bigint, tokens bigint, total double, false double"
    # in buckets, so that those who ask come to the shards
    made = saved(counted.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard(probes, shards), kinds), "shards", (shards, "shard"))
    zero = lambda f, c: F.coalesce(f(c), F.lit(0))
    v, n, total, false = made.agg(zero(F.sum, "words"), zero(F.sum, "tokens"), zero(F.sum, "total"), zero(F.max, "false")).first()
    return made, Model(n, v, total, false, pair_weight), probes, shards


def whole_filter(made: DataFrame, shards: int, probes: int) -> Filter:
    """All parts together; for filters of a checked size."""
    parts = [np.zeros(8, np.uint8)] * shards
    for s, part in made.select("shard", "part").toLocalIterator():
        parts[s] = np.frombuffer(part, np.uint8)
    return Filter(parts, probes)


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, pair_weight: float = PAIR_WEIGHT, slice_shard_bytes: int = SHARD_BYTES, most_filter: int = MOST_FILTER) -> DataFrame:
    """A row for each row of `docs`: the id (and the columns in `keep`), held_out, n_tokens, n_known, train_tokens,
    base_score (add-0.5 word probabilities from exact counts) and score (the model's log10 probability).

    Training rows are those whose crc32 of the id as text is not 1 modulo 5 (a null id is empty text, a training
    row). A null or empty text has the end token alone. Repeated rows count repeatedly. An empty table gives no
    rows; without training rows every token is unknown.
    """
    names = [id_col, *(keep or [])]
    inner = [f"_k{i}" for i in range(len(names))]
    d = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)), F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    held = sliced(d)
    made, model, probes, shards = train_slices(held, pair_weight=pair_weight, slice_shard_bytes=slice_shard_bytes)
    filter_b = None
    if made.agg(F.coalesce(F.sum(F.octet_length("part")), F.lit(0))).first()[0] <= most_filter:
        filter_b = docs.sparkSession.sparkContext.broadcast(whole_filter(made, shards, probes))
    asked = held.select("split", "data").mapInArrow(_ask(shards, filter_b is None, drop_for(probes)), "split bigint, shard int, kind int, data binary")
    answered = asked.repartition(shards, "shard").groupBy("shard").cogroup(made.groupBy("shard")).applyInArrow(_answer(probes), "split bigint, shard int, kind int, data binary")
    kinds = ", ".join(f"{i} {d.schema[i].dataType.simpleString()}" for i in inner)
    out = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    schema = pa.schema([(x.split()[0], pa.null()) for x in [*inner, *out.split(", ")]])
    both = answered.groupBy("split").cogroup(held.select("split", "data").groupBy("split"))  # slices lie in buckets by split
    return both.applyInArrow(_finish(model, schema, shards, filter_b, drop_for(probes)), f"{kinds}, {out}").withColumnsRenamed(dict(zip(inner, names)))
