"""Quality rules: a linear-chain conditional random field labels each line as content or boilerplate.

Lines are described by numeric features; Viterbi decoding finds the best label sequence of each document, and
the share of words in content lines decides whether the document stays. The field is fitted by maximum
likelihood on a bounded sample of labelled documents (TRAIN_ROWS, texts of at most TRAIN_CHARS); everything else covers
all rows and whole texts.

Labels are given for documents, the field learns them for lines. Lines of bad documents are boilerplate; lines of good
ones are content, but for those that repeat their own text. So that the field sees where labels change, runs of lines
of bad documents are also set into good ones (a run in each good document of two lines or more).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NOT_SPACE, Words, covered, gram_hashes, mix, slices, span_hashes, sums, words_of

TRAIN_ROWS, TRAIN_CHARS, SEGMENT = 1500, 20_000, 32
#: Lines of a run that is set into a good document; share of words in repeated windows from which a line repeats its text.
SPLICED, MOST_REPEATED = 6, 0.5
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT, CONTENT_SHARE = 10, 5, 20, 0.5
FEATURES = ("bias", "symbols", "upper", "digits", "marks", "log_words", "repeated", "duplicate", "no_stop", "windows")


def _in(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS, MARKS, STOPS, DIGITS = _in("#*$%&|<>"), _in("!?"), _in(".!?:;\"')"), _in("0123456789")
UPPER, LETTER = _in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _in("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
CONTINUES = (np.arange(256) & 0xC0) == 0x80


@dataclass
class Lines:
    first: np.ndarray  # each row's first line, with the end
    words: np.ndarray  # words in each line
    features: np.ndarray
    base: dict[str, np.ndarray]


def lines_of(column: pa.Array) -> Lines:
    """Lines (\\n-split) of each text with their features, and the counts of each text."""
    w: Words = words_of(column, NOT_SPACE)
    data, n_rows = w.padded[:-8], w.rows
    breaks = np.flatnonzero(data == 10)
    per_row = 1 + np.bincount(np.searchsorted(w.text_at, breaks, "right") - 1, minlength=n_rows)[:n_rows] if n_rows else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    n = int(first[-1])
    starts, ends, opens, closes = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    opens[first[:-1]], closes[first[1:] - 1] = True, True
    starts[opens], starts[~opens] = w.text_at[:-1], breaks + 1
    ends[closes], ends[~closes] = w.text_at[1:], breaks
    line_row = np.repeat(np.arange(n_rows), per_row)
    a, z = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    words = z - a

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int32)])
        return (total[ends] - total[starts]) / np.maximum(of, 1)

    size = (ends - starts).astype(np.float64)
    h = w.hashes()
    word_line = np.repeat(np.arange(n), words)
    # words of a line that stood in it before
    key = mix(h ^ mix(word_line.astype(np.uint64)))
    kept = np.zeros(len(h), bool)
    kept[np.unique(key, return_index=True)[1]] = True
    again = np.bincount(word_line[~kept], minlength=n)[:n]
    # lines with a word that equal an earlier one of their text
    full = np.flatnonzero(words > 0)
    line_key = mix(span_hashes(w.padded, starts[full], ends[full] - starts[full]) ^ mix(line_row[full].astype(np.uint64)))
    new = np.zeros(len(full), bool)
    new[np.unique(line_key, return_index=True)[1]] = True
    duplicate = np.zeros(n, bool)
    duplicate[full[~new]] = True
    # words in windows that are found twice or more in their text
    at = w.gram_rows(REPEAT_WINDOW)
    grams = mix(gram_hashes(h, REPEAT_WINDOW)[at] ^ mix(w.row[at].astype(np.uint64)))
    _, which, times = np.unique(grams, return_inverse=True, return_counts=True)
    repeat = covered(len(h), at[times[which] > 1], REPEAT_WINDOW)
    repeat_line = sums(repeat, np.append(a, len(h))) if n else np.zeros(0, np.int64)
    last = data[np.maximum(w.starts[np.maximum(z - 1, 0)] + w.lens[np.maximum(z - 1, 0)] - 1, 0)] if len(h) else np.zeros(n, np.uint8)
    x = np.stack(
        [np.ones(n), np.minimum(1, 20 * share(SYMBOLS, size)), share(UPPER, size * share(LETTER, size)), np.minimum(1, 5 * share(DIGITS, size)), np.minimum(1, 20 * share(MARKS, size)), np.log1p(words) / 4, again / np.maximum(words, 1), duplicate.astype(float), np.where(words > 0, ~STOPS[last], 1.0), repeat_line / np.maximum(words, 1)],
        axis=1,
    ) if n else np.zeros((0, len(FEATURES)))
    points = np.concatenate([[0], np.cumsum(NOT_SPACE[data] & ~CONTINUES[data], dtype=np.int64)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data], dtype=np.int64)])
    base = {"n_words": np.diff(w.first), "word_chars": np.diff(points[w.text_at]), "n_symbols": np.diff(symbols[w.text_at]), "n_dup_lines": sums(duplicate, first), "n_repeat_words": sums(repeat, w.first)}
    return Lines(first, words, x, base)


@dataclass
class Field:
    """A linear-chain CRF of two labels: 0 boilerplate, 1 content."""

    weights: np.ndarray  # features x 2
    moves: np.ndarray  # label x next label

    @classmethod
    def plain(cls) -> Field:
        """All lines are content; used where there is nothing to learn from."""
        w = np.zeros((len(FEATURES), 2))
        w[0, 1] = 1.0
        return cls(w, np.zeros((2, 2)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.1, decay: float = 1e-3) -> Field:
        """x: sequences x lines x features, y: their labels, -1 after the end. Adam on the mean log likelihood."""
        mask = y >= 0
        s, n, _ = x.shape
        hot = np.stack([(y == 0), (y == 1)], axis=2).astype(float)
        lines = mask.sum()
        params = [np.zeros((x.shape[2], 2)), np.zeros((2, 2))]
        m = [np.zeros_like(p) for p in params]
        v = [np.zeros_like(p) for p in params]
        seen = np.einsum("sni,snj->ij", hot[:, :-1], hot[:, 1:])
        for t in range(1, steps + 1):
            w, a = params
            e = x @ w
            f, b = np.zeros((s, n, 2)), np.zeros((s, n, 2))
            f[:, 0] = e[:, 0]
            for i in range(1, n):
                step = np.logaddexp(f[:, i - 1, 0, None] + a[0], f[:, i - 1, 1, None] + a[1]) + e[:, i]
                f[:, i] = np.where(mask[:, i, None], step, f[:, i - 1])
            z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
            for i in range(n - 2, -1, -1):
                nxt = e[:, i + 1] + b[:, i + 1]
                step = np.logaddexp(a[:, 0] + nxt[:, 0, None], a[:, 1] + nxt[:, 1, None])
                b[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
            p = np.exp(np.minimum(f + b - z[:, None, None], 0)) * mask[:, :, None]
            pair = np.exp(np.minimum(f[:, :-1, :, None] + a + (e + b)[:, 1:, None, :] - z[:, None, None, None], 0)) * mask[:, 1:, None, None]
            grads = [np.einsum("snf,snk->fk", x, hot - p) / lines - decay * w, (seen - pair.sum((0, 1))) / lines - decay * a]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] + rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return cls(*params)

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels of the lines of all rows at once; rows are lines first[i] to first[i+1]."""
        e = x @ self.weights
        out = np.zeros(len(e), np.int8)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], first[:-1][order]
        if not len(size) or not size[0]:
            return out
        back = np.zeros((len(e), 2), np.int8)
        best = np.zeros((len(size), 2))
        a = self.moves
        for i in range(int(size[0])):
            live = int(np.searchsorted(-size, -i, "left"))  # rows with more than i lines
            at = begin[:live] + i
            if i:
                p = best[:live]
                up = p[:, 1, None] + a[1] > p[:, 0, None] + a[0]
                back[at] = up
                best[:live] = np.where(up, p[:, 1, None] + a[1], p[:, 0, None] + a[0]) + e[at]
            else:
                best[:live] = e[at]
        label = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for i in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -i, "left"))
            at = begin[:live] + i
            out[at] = label[:live]
            label[:live] = back[at, label[:live]]
        return out


def fit_field(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Field:
    """A field fitted on at most `train_rows` labelled documents, chosen by a hash of their id.

    Rows without label, id or text and texts over `train_chars` aren't used; lines learn from them as `_sequences` says. Without examples of both labels
    the plain field is returned, which takes every line as content.
    """
    ids = labels.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{label_col}`").cast("int").alias("_y")).where("_i is not null and _y in (0, 1)").groupBy("_i").agg(F.max("_y").alias("_y"))
    ids = ids.orderBy(F.xxhash64(F.col("_i").cast("string")), "_i").limit(train_rows)
    d = docs.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text_col}`").alias("_t")).where(F.length("_t").between(1, train_chars))
    rows = sorted((str(r[0]), r[1], r[2]) for r in d.join(F.broadcast(ids), "_i").select("_i", "_y", "_t").limit(2 * train_rows).collect())
    if len({y for _, y, _ in rows}) < 2:
        return Field.plain()
    return Field.fit(*_sequences(lines_of(pa.array([t for _, _, t in rows], pa.string())), np.array([y for _, y, _ in rows])))


def _sequences(found: Lines, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences of at most SEGMENT lines and their labels, -1 after the end; good: 1 or 0 for each document."""
    x = found.features
    repeats = (x[:, FEATURES.index("duplicate")] > 0) | (x[:, FEATURES.index("windows")] > MOST_REPEATED)
    y = np.where(repeats, 0, np.repeat(good, np.diff(found.first)))
    docs = [np.arange(a, z) for a, z in zip(found.first[:-1].tolist(), found.first[1:].tolist())]
    bad = [d for d, g in zip(docs, good) if not g]
    made = list(docs)
    for k, d in enumerate(d for d, g in zip(docs, good) if g and len(d) > 1):
        run = bad[k % len(bad)][: 1 + k % SPLICED]
        cut = 1 + k % (len(d) - 1)
        made.append(np.concatenate([d[:cut], run, d[cut:]]))
    parts = [d[i : i + SEGMENT] for d in made for i in range(0, len(d), SEGMENT)]
    xs, ys = np.zeros((len(parts), SEGMENT, x.shape[1])), np.full((len(parts), SEGMENT), -1)
    for k, d in enumerate(parts):
        xs[k, : len(d)], ys[k, : len(d)] = x[d], y[d]
    return xs, ys


#: Bytes of text that are judged at once.
SLICE = 1 << 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(field: Field, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            found = lines_of(batch.column("_text"))
            label = field.decode(found.features, found.first)
            content = sums(found.words * label, found.first)
            n = found.base["n_words"]
            failed = (n < MIN_WORDS) | (100 * found.base["n_repeat_words"] > REPEAT_PERCENT * n)
            kept = ~failed & (content >= share * n)
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(found.base[k], pa.int64()) for k in BASE), pa.array(content, pa.int64()), pa.array(failed), pa.array(kept)], names=[*names, *BASE, "content_words", "base_failed", "kept"])

    return run


def judge_quality(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, share: float = CONTENT_SHARE) -> DataFrame:
    """Counts and verdict for each row of `docs`: the id (and the columns in `keep`), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, content_words, base_failed and kept.

    A null text counts as empty: no words, base_failed. Repeated rows stay repeated.
    """
    names = [id_col, *(keep or [])]
    inner = [f"_k{i}" for i in range(len(names))]
    d = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kinds = ", ".join(f"{i} {d.schema[i].dataType.simpleString()}" for i in inner)
    out = d.mapInArrow(_judge(field, share), f"{kinds}, {', '.join(f'{k} bigint' for k in BASE)}, content_words bigint, base_failed boolean, kept boolean")
    return out.withColumnsRenamed(dict(zip(inner, names)))


def filter_quality(docs: DataFrame, field: Field, *, text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of `docs` that judge_quality keeps, with all their columns, in one pass and without a shuffle."""
    inner = [f"_k{i}" for i in range(len(docs.columns))]
    d = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(docs.columns, inner)), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kinds = ", ".join(f"{i} {d.schema[i].dataType.simpleString()}" for i in inner)
    out = d.mapInArrow(_judge(field, share), f"{kinds}, {', '.join(f'{k} bigint' for k in BASE)}, content_words bigint, base_failed boolean, kept boolean")
    return out.where("kept").select(*(F.col(i).alias(c) for i, c in zip(inner, docs.columns)))
