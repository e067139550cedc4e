"""Quality classifier by pairwise ranking (Bradley-Terry).

A document's worth is a linear function of features of its text alone. In a preference pair the better document wins with
the probability sigmoid(worth - worth); the weights minimise the logistic loss on feature differences over all pairs
of a good and a bad labelled document. The threshold is the quantile of the learnt worths at the share of bad labels, and
the score is sigmoid(worth - threshold), so that the share below 0.5 is that of bad labels.

The model is fitted on all training labels. Their features are written once; each step of the fit is two passes over them:
the worths of good and of bad documents, dealt linearly to NODES places, tell each document how often it loses, and then
every document adds its own to the gradient and the curvature (Newton's method). So pairs are summed without being made, and
what a task returns has a fixed size. The model goes to the tasks with the function. Scoring is one pass over the texts,
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, saved
from .words import NOT_SPACE, covered, gram_hashes, mix, slices, sums, words_of

SLICE = 1 << 20
STEPS, DECAY, FAR = 30, 1e-3, 6.0
#: Places of worths, from -MOST to MOST; what is beyond counts as there. Classes of worths from -MOST / 2 for the curvature.
NODES, MOST, CLASSES = 2048, 36.0, 128
#: Digits of what is learnt, so that it doesn't hang on the order of sums.
DIGITS = 6
WINDOW = 5

#: Classes of bytes: printable ASCII each its own, blanks, other control characters, parts of longer characters.
_CLASS = np.full(256, 96, np.int64)
_CLASS[33:127] = np.arange(94)
_CLASS[[9, 10, 11, 12, 13, 32]] = 94
_CLASS[:9], _CLASS[14:32], _CLASS[127] = 95, 95, 95
_CLASSES = 97
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_PLAIN = _UPPER | _LOWER | (np.arange(256) >= 128)
_PLAIN[48:58] = True
SHAPES = ("log_words", "word_size", "short", "capital", "shouted", "marked_end", "said_before", "in_repeated_windows", "lines_a_word")
N_FEATURES = _CLASSES + len(SHAPES)


def features_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each text, and its number of words. Shares are taken by square roots, which tells rare from none."""
    w = words_of(column, NOT_SPACE)
    data, n_rows = w.padded[:-8], w.rows
    n = np.diff(w.first)
    byte_row = np.repeat(np.arange(n_rows), np.diff(w.text_at))
    counts = np.bincount(byte_row * _CLASSES + _CLASS[data], minlength=n_rows * _CLASSES).reshape(n_rows, _CLASSES)
    x = np.zeros((n_rows, N_FEATURES))
    x[:, :_CLASSES] = np.sqrt(counts / np.maximum(np.diff(w.text_at), 1)[:, None])
    of_row = lambda flags: sums(flags, w.first) / np.maximum(n, 1)
    upper, lower = (np.concatenate([[0], np.cumsum(k[data], dtype=np.int64)]) for k in (_UPPER, _LOWER))
    ends = w.starts + w.lens
    uppers, lowers = upper[ends] - upper[w.starts], lower[ends] - lower[w.starts]
    h = w.hashes()
    again = np.ones(len(h), bool)
    again[np.unique(mix(h ^ mix(w.row.astype(np.uint64))), return_index=True)[1]] = False
    at = w.gram_rows(WINDOW)
    _, which, times = np.unique(mix(gram_hashes(h, WINDOW)[at] ^ mix(w.row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    repeat = covered(len(h), at[times[which] > 1], WINDOW)
    lines = np.bincount(byte_row[data == 10], minlength=n_rows)
    shapes = (
        np.log1p(n),
        np.log1p(of_row(w.lens)),
        of_row(w.lens <= 2),
        of_row(_UPPER[data[w.starts]] if len(h) else again),
        of_row((uppers > 1) & (lowers == 0)),
        of_row(~_PLAIN[data[ends - 1]] if len(h) else again),
        of_row(again),
        of_row(repeat),
        np.sqrt(lines / np.maximum(n, 1)),
    )
    for k, values in enumerate(shapes):
        x[:, _CLASSES + k] = values
    return x, n


@dataclass(frozen=True)
class Ranking:
    """The learnt worth and where scores reach 0.5."""

    weights: np.ndarray
    middle: np.ndarray  # of the features
    scale: np.ndarray
    threshold: float

    @classmethod
    def plain(cls) -> Ranking:
        """Without examples of both labels nothing is preferred; every text with a word scores 0.5."""
        return cls(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.0)

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -FAR, FAR)

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.normal(x) @ self.weights

    def score(self, x: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return np.where(n_words > 0, 1 / (1 + np.exp(-np.clip(self.worth(x) - self.threshold, -36, 36))), 0.0)

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, bad_share: float) -> Ranking:
        """x: documents x features, good: whether each is a good one; bad_share: of all training labels."""
        return cls.learn(lambda f: f(x, good), bad_share)

    @classmethod
    def learn(cls, total: Callable[[Callable], np.ndarray], bad_share: float) -> Ranking:
        """total(f): the sum of f(x, good) over all training documents, in whatever parts."""
        n, n_good, *rest = total(_moments)
        if not 0 < n_good < n:
            return cls.plain()
        middle, squares = np.reshape(rest, (2, -1)) / n
        model = cls(np.zeros(len(middle)), np.round(middle, DIGITS), np.round(np.maximum(np.sqrt(np.maximum(squares - middle**2, 0)), 1e-3), DIGITS), 0.0)
        share = np.array([1 / (n - n_good), 1 / n_good])  # of a bad and of a good document

        def tried(w: np.ndarray) -> tuple[cls, float, np.ndarray]:
            """The model of these weights, its loss, and its spread."""
            m = cls(w, model.middle, model.scale, 0.0)
            spread = total(partial(_spread, m)) * share[:, None]
            return m, float(spread[0] @ np.logaddexp(0, _GAPS) @ spread[1]) + DECAY / 2 * float(w @ w), spread

        model, loss, spread = tried(model.weights)
        for _ in range(STEPS):
            lost = 1 / (1 + np.exp(-_GAPS))  # how often a good document there loses to a bad one there
            curves = np.stack([lost @ spread[1], spread[0] @ lost, (lost * (1 - lost)) @ spread[1], spread[0] @ (lost * (1 - lost))])
            g, h = _newton(total(partial(_pull, model, curves, share)), len(middle))
            g, h = g + DECAY * model.weights, h + DECAY * np.eye(len(middle))
            step, size, better = np.linalg.solve(h, g), 1.0, None
            while size > 1e-3 and (better is None or better[1] >= loss):
                better, size = tried(model.weights - size * step), size / 2
            gain = loss - better[1]
            if gain <= 0:
                break
            model, loss, spread = better
            if gain < 1e-11:
                break
        model = cls(np.round(model.weights, DIGITS), model.middle, model.scale, 0.0)
        return cls(model.weights, model.middle, model.scale, round(_quantile(total, model, int(n), min(max(bad_share, 0.0), 1.0)), DIGITS))


_PLACES = np.linspace(-MOST, MOST, NODES)
_GAPS = _PLACES[:, None] - _PLACES[None, :]  # of a bad and a good document


def _moments(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x), good.sum()], x.sum(0), (x * x).sum(0)])


def _spread(model: Ranking, x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How many bad and good documents are at each place; one between two places counts in part at both."""
    at = (np.clip(model.worth(x), -MOST, MOST) + MOST) * ((NODES - 1) / (2 * MOST))
    low = np.minimum(at.astype(np.int64), NODES - 2)
    row = good.astype(np.int64) * NODES + low
    return (np.bincount(row, 1 - (at - low), 2 * NODES) + np.bincount(row + 1, at - low, 2 * NODES)).reshape(2, NODES)


def _pull(model: Ranking, curves: np.ndarray, share: np.ndarray, x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """In rows: the gradient, the curvature of each document for itself, and the documents of each class of worths."""
    z, s, y = model.normal(x), np.clip(model.worth(x), -MOST, MOST), good.astype(np.int64)
    p, h = (np.where(good, np.interp(s, _PLACES, curves[i + 1]), np.interp(s, _PLACES, curves[i])) * share[y] for i in (0, 2))
    of = np.zeros((2 * CLASSES, z.shape[1]))
    np.add.at(of, y * CLASSES + np.clip((s / MOST + 0.5) * CLASSES, 0, CLASSES - 1).astype(np.int64), z * share[y][:, None])
    return np.concatenate([[np.where(good, -p, p) @ z], (z * h[:, None]).T @ z, of])


def _newton(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature over all pairs; what the two documents of a pair share is taken from classes of worths."""
    bad, good = rows[1 + n : 1 + n + CLASSES], rows[1 + n + CLASSES :]
    gap = (np.arange(CLASSES)[:, None] - np.arange(CLASSES)[None, :]) * (MOST / CLASSES)
    both = bad.T @ (1 / (2 + 2 * np.cosh(gap))) @ good
    value, axis = np.linalg.eigh(rows[1 : 1 + n] - both - both.T)
    return rows[0], (axis * np.maximum(value, 0)) @ axis.T


def _counts(model: Ranking, low: float, high: float, x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How many worths are below low, and in each of NODES equal parts up to high."""
    s = model.worth(x)
    part = np.floor((s - low) * (NODES / (high - low)))
    return np.bincount(np.clip(part, -1, NODES).astype(np.int64) + 1, minlength=NODES + 2).astype(float)


def _quantile(total: Callable[[Callable], np.ndarray], model: Ranking, n: int, share: float) -> float:
    """The quantile of all worths, between the two that are next to it, each found by narrowing."""

    def at(k: int) -> float:
        low, high = -FAR * np.abs(model.weights).sum() - 1, FAR * np.abs(model.weights).sum() + 1
        while high - low > 1e-9:
            part = int(np.searchsorted(np.cumsum(total(partial(_counts, model, low, high))), k, "right")) - 1
            part = min(max(part, 0), NODES - 1)
            low, high = low + part * (high - low) / NODES, low + (part + 1) * (high - low) / NODES
        return (low + high) / 2

    k = int(share * (n - 1))
    first = at(k)
    return first + (share * (n - 1) - k) * (at(min(k + 1, n - 1)) - first)


def held_out(id_col: str) -> Column:
    """Whether the CRC-32 of the id as text (null: empty) is 1 modulo 3; such rows teach nothing."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


_FOUND = "good boolean, x array<double>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_t", SLICE):
        x, _ = features_of(batch.column("_t"))
        yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))], names=["good", "x"])


def _summed(f: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0
        for batch in batches:
            if batch.num_rows:
                out = out + f(np.asarray(batch.column("x").flatten()).reshape(-1, N_FEATURES), np.asarray(batch.column("good")).astype(bool))
        if not isinstance(out, int):
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([list(out.shape)], pa.list_(pa.int32()))], names=["v", "shape"])

    return run


def fit_ranking(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """A ranking learnt from all labels of ids that aren't held out. Labels other than 0 and 1, of null ids, and of ids with both
    labels teach nothing, nor do null texts."""
    known = labels.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{label_col}`").cast("int").alias("_q")).where("_i is not null and _q in (0, 1)").where(~held_out("_i"))
    known = known.groupBy("_i").agg(F.min("_q").alias("_q"), F.max("_q").alias("_z")).where("_q = _z")
    bad, n = known.agg(F.coalesce(F.sum(1 - F.col("_q")), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < bad < n:
        return Ranking.plain()
    d = docs.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text_col}`").cast("string").alias("_t")).where("_t is not null").where(~held_out("_i"))
    # by a shuffle at any size, as labels grow with the documents
    rows = saved(d.join(known.select("_i", (F.col("_q") == 1).alias("_y")).hint("merge"), "_i").select("_y", "_t").mapInArrow(_features, _FOUND), "features")

    def total(f: Callable) -> np.ndarray:
        # a sum of a fixed size from each task, and a task has many MB of features
        parts = rows.mapInArrow(_summed(f), "v binary, shape array<int>").collect()
        return sum(np.frombuffer(bytes(r.v)).reshape(r["shape"]) for r in parts) if parts else np.zeros(2)

    model = Ranking.learn(total, bad / n)
    forget(rows)
    return model


def _score(model: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            score = model.score(*features_of(batch.column("_text")))
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return run


def rank_quality(docs: DataFrame, model: Ranking, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each row of `docs`: the id (and the columns in `keep`), held_out, score (0 to 1; higher is better) and
    predicted (1 from a score of 0.5). A text without a word (null, empty, blanks) scores 0; repeated rows stay repeated."""
    names = [id_col, *(keep or [])]
    inner = [f"_k{i}" for i in range(len(names))]
    d = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)), held_out(id_col).alias("_held"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kinds = ", ".join(f"{i} {d.schema[i].dataType.simpleString()}" for i in inner)
    out = d.mapInArrow(_score(model), f"{kinds}, _held boolean, score double, predicted int")
    return out.withColumnsRenamed(dict(zip(inner, names)) | {"_held": "held_out"})
