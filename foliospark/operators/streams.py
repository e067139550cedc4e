"""Elements of pages from their drawing operations.

Operations are rows: a page's key, an order, op (the operator's name), operands a to f (null where there are fewer), text (the
strings that it shows, put together), name and sub (of Do: what it draws, and whether that is an Image or a Form).
A page is one ordered state machine: the matrix stack (q, Q, cm), text and line matrix (BT to ET), the open path. Its
rows come to one task in order and are worked off as a stream, so that a page of any length needs the memory of its open state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .pagewise import pages_of

c = F.col
OPERANDS = list("abcdef")
SHOWS, LINES = ("Tj", "TJ", "'", '"'), ("T*", "'", '"')
PATHS = ("m", "l", "c", "v", "y", "re", "h")
CLIPS, PAINTS = ("W", "W*"), ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n")
FORM_DEPTH = 4
#: Operations of forms that are sent to all tasks.
FEW = 100_000
_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_ELEMENT = "el_ix int, kind string, x0 double, y0 double, x1 double, y1 double, rot boolean, n_pts int, paint_op string, key_text string, n_chars bigint"


def _times(m, n):
    """The affine map m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def _moved(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def _box(points):
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


class _Points:
    """The box of points as they come."""

    def __init__(self) -> None:
        self.n, self.box = 0, None

    def add(self, *points) -> None:
        self.n += len(points)
        x0, y0, x1, y1 = self.box or (*points[0], *points[0])
        for x, y in points:
            x0, x1 = x if x < x0 else x0, x if x > x1 else x1
            y0, y1 = y if y < y0 else y0, y if y > y1 else y1
        self.box = x0, y0, x1, y1


class _Page:
    """The open state of a page; one with an operation that couldn't be read has that one first, and no elements."""

    def __init__(self, readable: bool = True) -> None:
        self.readable, self.began = readable, None
        self.matrix, self.kept, self.path, self.clip, self.opened = _UNIT, [], _Points(), False, None
        self.in_text, self.n = False, 0

    def element(self, kind, box, first, last, rot=False, n_pts=0, paint=None, text=None, n_chars=0):
        self.n += 1
        return (self.n, kind, *box, rot, n_pts, paint, text, n_chars, first, last)

    def text(self, at, op, v, key, n_chars):
        if op == "Tm" and len(v) == 6:
            self.line = tuple(v)
        elif op in ("Td", "TD") and len(v) == 2:
            if op == "TD":
                self.leading = -v[1]
            self.line = _times((1, 0, 0, 1, *v), self.line)
        elif op == "TL" and v:
            self.leading = v[0]
        elif op in LINES:
            self.line = _times((1, 0, 0, 1, 0, -self.leading), self.line)
        if op in SHOWS:
            m = _times(self.line, self.matrix)
            self.rot |= abs(m[1]) > V.ROT_TOL or abs(m[2]) > V.ROT_TOL
            self.shown.add(m[4:])
            self.words = self.words or key or ""
            self.n_chars += n_chars
        if op == "ET":
            self.in_text = False
            x0, y0, x1, y1 = self.shown.box or (0.0,) * 4
            box = (x0, y0 - 2, x1 + 4, y1 + 10) if self.shown.n else (0.0,) * 4
            return self.element("T", box, self.began, at, self.rot, text=self.words, n_chars=self.n_chars)

    def step(self, at, op, v, key, n_chars, sub):
        """Takes one operation and gives the element that it ends, if any."""
        if self.in_text:
            return self.text(at, op, v, key, n_chars)
        if op == "BT":
            self.in_text, self.began, self.line, self.leading, self.rot, self.shown, self.words, self.n_chars = True, at, _UNIT, 0.0, False, _Points(), "", 0
        elif op == "q":
            self.kept.append(self.matrix)
        elif op == "Q":
            self.matrix = self.kept.pop() if self.kept else _UNIT
        elif op == "cm" and len(v) == 6:
            self.matrix = _times(v, self.matrix)
        elif op in PATHS:
            self.opened = at if self.opened is None else self.opened
            if op == "re" and len(v) == 4:
                x, y, w, h = v
                v = (x, y, x + w, y, x, y + h, x + w, y + h)
            if len(v) > 1:
                self.path.add(*(_moved(self.matrix, v[i], v[i + 1]) for i in range(0, len(v) - 1, 2)))
        elif op in CLIPS:
            self.opened, self.clip = at if self.opened is None else self.opened, True
        elif op in PAINTS:
            path, clip, first = self.path, self.clip, at if self.opened is None else self.opened
            self.path, self.clip, self.opened = _Points(), False, None
            if path.n and not clip:  # a clipping path stays, it is no element
                return self.element("P", path.box, first, at, n_pts=path.n, paint=op)
        elif op == "Do" and sub == "Image":
            return self.element("I", _box([_moved(self.matrix, x, y) for x in (0, 1) for y in (0, 1)]), at, at)
        elif op == "BI":
            return self.element("II", _box([_moved(self.matrix, 0, 0), _moved(self.matrix, 1, 1)]), at, at)


def _words(column: pa.Array) -> list:
    """A column of few different words as a list."""
    d = column.dictionary_encode()
    words = [*d.dictionary.to_pylist(), None]
    return [words[k] for k in d.indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()]


def _operands(batch: pa.RecordBatch) -> list[list[float]]:
    """The operands of each row, without nulls."""
    cols = [batch.column(n) for n in OPERANDS]
    valid = np.column_stack([x.is_valid().to_numpy(zero_copy_only=False) for x in cols])
    rows = np.column_stack([x.fill_null(0.0).to_numpy(zero_copy_only=False) for x in cols]).tolist()
    out = [v[:n] for v, n in zip(rows, valid.sum(1).tolist())]
    for i in np.flatnonzero((valid[:, 1:] & ~valid[:, :-1]).any(1)).tolist():
        out[i] = [x for x, known in zip(rows[i], valid[i]) if known]
    return out


def _walk(keys: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = now = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            here = pages_of(pa.Table.from_batches([batch]), keys)
            fresh = np.ones(n, bool)
            fresh[1:] = here[1:] != here[:-1]
            ends = batch.select(keys).take(pa.array([0, n - 1])).to_pylist() if keys else [{}, {}]
            fresh[0] = page is None or ends[0] != now
            now, out = ends[1], []
            for at, new, op, text, n_chars, sub, v in zip(range(n), fresh.tolist(), *(_words(batch.column(x)) for x in ("op", "_key")), batch.column("_chars").to_pylist(), _words(batch.column("sub")), _operands(batch)):
                if new:
                    page = _Page(op is not None)
                if page.readable:
                    found = page.step(at, op, v, text, n_chars, sub)
                    if found:
                        out.append((*found, at))
            # places are looked up for elements alone; those that stay open take theirs along
            places = batch.column("_at")
            if page.readable:
                page.began, page.opened = ((places[x].as_py(),) if isinstance(x, int) else x for x in (page.began, page.opened))
            *cols, first, _, last = zip(*out) if out else [()] * (len(schema) - len(keys) + 1)
            rows = pa.array(last, pa.int64())
            first = pa.array([x[0] if isinstance(x, tuple) else places[x].as_py() for x in first], schema.field("first_op").type)
            cols = [*(batch.column(k).take(rows) for k in keys), *cols, first, places.take(rows)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

    return run


def unparsed(ops: DataFrame, key: list[str]) -> DataFrame:
    """Pages whose operations couldn't be read as a whole: those with a row without op."""
    return ops.where("op is null").select(*key).distinct()


def elements_of(ops: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, el_ix, kind, x0, y0, x1, y1, rot, n_pts, paint_op, key_text, n_chars, first_op, last_op): elements of pages, numbered
    from 1 in the order in which they end.

    Kinds: T, a text object (BT to ET), the padded box of the places where it shows something (zeros if it doesn't), rotated if
    a matrix is, key_text of its first text that has one; P, a painted path that doesn't clip; I, a drawn image; II, an
    inline image. Forms and unknown names are no elements. A save without a restore and the reverse are allowed: restoring
    from an empty stack gives the identity. Unfinished paths and texts give nothing; pages in `unparsed` have no elements.
    """
    at = ops.schema[order].dataType.simpleString()
    d = ops.select(*key, c(order).alias("_at"), "op", *(c(x).cast("double").alias(x) for x in OPERANDS), T.key_text(c("text")).alias("_key"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_chars"), "sub")
    order_ = ["_at"] if not at.startswith("array") else [F.get("_at", F.lit(0)), "_at"]  # arrays are compared at length where they must be
    # a window brings pages together in order; no shuffle where they already are. What couldn't be read comes first
    d = d.withColumn("_place", F.row_number().over(Win.partitionBy(*key).orderBy(F.desc(c("op").isNull()), *order_)))
    kinds = f"{', '.join(f'{k} {ops.schema[k].dataType.simpleString()}' for k in key)}, {_ELEMENT}, first_op {at}, last_op {at}"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(d.sparkSession.createDataFrame([], kinds).schema)
    return d.mapInArrow(_walk(key, schema), kinds)


def rewritten(ops: DataFrame, removed: DataFrame, key: list[str], order: str) -> DataFrame:
    """The operations that are left when elements go (removed: key, kind, first_op, last_op): a text object goes as a whole, of
    a path what builds, clips and paints it, an image by itself. All else stays, state and clipping with it."""
    # starts of ranges lie among the operations: an operation goes if a range that began reaches it, however long the page is
    starts = removed.where("first_op is not null").select(*key, c("first_op").alias(order), F.coalesce("kind", F.lit("P")).alias("_kind"), c("last_op").alias("_last"), F.lit(True).alias("_start"))
    w = Win.partitionBy(*key).orderBy(order)  # up to the row and those of its place
    reach = lambda which: F.coalesce(F.max(F.when(which, c("_last"))).over(w) >= c(order), F.lit(False))
    d = ops.unionByName(starts, True).withColumns({"_whole": reach(c("_kind") != "P"), "_path": reach(c("_kind") == "P")})
    drawn = F.coalesce(c("op").isin(*PATHS, *CLIPS, *PAINTS), F.lit(False))
    return d.where(c("_start").isNull() & ~c("_whole") & ~(c("_path") & drawn)).select(*ops.columns)


def expanded(forms: DataFrame, depth: int = FORM_DEPTH) -> DataFrame:
    """(form, path, and the columns of operations): what each form draws between q and Q, forms in forms down to `depth`, in the
    order of path (an array); deeper calls stay as they are, which also ends cycles. forms: form (the name), i, and the columns of
    operations; a form's own matrix is its first operation."""
    body = ["op", *OPERANDS, "text", "name", "sub"]
    rows = forms.select("form", F.array(F.lit(1).cast("long"), c("i").cast("long")).alias("path"), *body)
    ends = forms.select("form").distinct().withColumn("_s", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(op).alias("op")) for k, op in ((0, "q"), (2, "Q"))))))
    nothing = [F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in body[1:]]
    whole = rows.unionByName(ends.select("form", F.array("_s.k").alias("path"), c("_s.op").alias("op"), *nothing))
    inner = whole.select(c("form").alias("_form"), c("path").alias("_path"), *(c(x).alias(f"_{x}") for x in body))
    d = whole
    for _ in range(depth - 1):
        d = _replaced(d, inner, "path", ["form"])
    return d


def _replaced(d: DataFrame, inner: DataFrame, order: str, rest: list[str]) -> DataFrame:
    """Calls of known forms replaced by what they draw, in their place."""
    body = ["op", *OPERANDS, "text", "name", "sub"]
    # rows that call nothing have a key each that no form has, so that they don't all meet in one place
    call = F.coalesce((d["op"] == "Do") & (d["sub"] == "Form"), F.lit(False)) & d["name"].isNotNull()
    d = d.withColumn("_call", F.when(call, F.concat(F.lit("+"), c("name"))).otherwise(F.xxhash64(order, *rest).cast("string")))
    met = d.join(inner.withColumn("_callee", F.concat(F.lit("+"), c("_form"))), c("_call") == c("_callee"), "left")
    called = c("_form").isNotNull()
    return met.select(*rest, F.when(called, F.concat(d[order], c("_path"))).otherwise(d[order]).alias(order), *(F.when(called, c(f"_{x}")).otherwise(d[x]).alias(x) for x in body))


def with_forms(ops: DataFrame, forms: DataFrame, order: str, depth: int = FORM_DEPTH) -> DataFrame:
    """Operations with those of the forms that they draw in their place (see `expanded`); calls of unknown forms stay. The order
    becomes an array, which sorts as the page draws. Forms are expanded apart, so that pages meet them in one join."""
    rest = [x for x in ops.columns if x not in (order, "op", "text", "name", "sub", *OPERANDS)]
    body = ["op", *OPERANDS, "text", "name", "sub"]
    inner = expanded(forms, depth).select(c("form").alias("_form"), c("path").alias("_path"), *(c(x).alias(f"_{x}") for x in body))
    few = inner.limit(FEW + 1).count() <= FEW  # then they go to the operations, which stay where they are
    return _replaced(ops.withColumn(order, F.array(c(order).cast("long"))), F.broadcast(inner) if few else inner, order, rest)
