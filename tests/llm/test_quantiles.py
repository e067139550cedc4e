"""Summaries against the sorted values."""

import bisect
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import quantiles as q

ROWS = "stream string, grp string, batch int, x long, n long"


def check(rows, groups):
    """rows: what verified_quantiles gave; groups: {(stream, grp, batch): values} of single batches."""
    every = defaultdict(list)
    for (s, g, b), xs in groups.items():
        every[s, g, b] += xs
        every[s, g, q.WHOLE] += xs
    got = {(r.stream, r.grp, r.batch, r.i): r for r in rows}
    assert len(got) == len(rows) and set(got) == {(*k, i) for k, xs in every.items() if len(xs) >= 20 for i in range(1, 10)}
    for k, xs in every.items():
        if len(xs) < 20:
            continue
        xs, before = sorted(xs), None
        for i in range(1, 10):
            r, target = got[(*k, i)], math.ceil(i * len(xs) / 10)
            below, upto = bisect.bisect_left(xs, r.answer), bisect.bisect_right(xs, r.answer)
            assert (r.n, r.target, r.exact_x, r.n_below, r.n_upto) == (len(xs), target, xs[target - 1], below, upto)
            assert r.rank_error == max(0, below + 1 - target, target - upto) <= r.tracked_error and r.within and 1000 * r.rank_error <= 50 * r.n
            assert min(4, len(set(xs))) <= r.points <= min(len(xs), 400) and xs[0] <= r.answer <= xs[-1]
            assert before is None or before <= r.answer
            before = r.answer


def frame(spark, groups):
    return spark.createDataFrame([(*k, x, n) for k, xs in groups.items() for x, n in Counter(xs).items()], ROWS)


@pytest.mark.parametrize("blocks", [1, 7, 37])
def test_equals_the_sorted_values(spark, blocks):
    rng = random.Random(blocks)
    groups = {("a", f"g{g}", b): [rng.randint(0, 10 ** rng.randint(0, 6)) for _ in range(rng.choice([1, 3, 19, 20, 60]))] for g in range(25) for b in range(rng.randint(1, 8))}
    # a group in many blocks, one of a single value, one where a value hides others
    groups |= {("a", "hot", b): [rng.randint(-9000, 9000) for _ in range(2500)] for b in range(8)}
    groups |= {("b", "flat", 3): [5] * 4000, ("b", "hidden", 0): [7] * 9000 + list(range(600)), (None, None, 1): list(range(40))}
    check(q.verified_quantiles(frame(spark, groups), blocks=blocks).collect(), groups)


def test_few_rows_nulls_and_other_columns(spark):
    groups = {("a", "g", 0): list(range(19)), ("a", "h", 0): [1] * 20}
    df = frame(spark, groups).unionByName(spark.createDataFrame([("a", "g", 0, None, 5), ("a", "g", 0, 3, 0)], ROWS)).withColumns({"block": F.lit("x"), "edge": F.lit(1), "points": F.lit(2)})
    check(q.verified_quantiles(df).collect(), groups)
    assert q.verified_quantiles(df.limit(0)).count() == 0


def test_collapses_keep_their_bound_and_alternate():
    rng = np.random.default_rng(1)
    for n, most in ((1000, 10), (1001, 10), (777, 50), (20000, 400)):
        x = np.sort(rng.integers(0, 10**6, n))
        for odd in (False, True):
            p, w, error = q.collapsed(x, np.ones(n, np.int64), most, odd)
            assert w.sum() == n and len(p) <= most and error == -(-n // most) // 2
            total = np.concatenate([[0], np.cumsum(w)])
            for t in range(1, n + 1, 7):
                a = p[np.searchsorted(total, t, "left") - 1]
                assert max(0, np.searchsorted(x, a) + 1 - t, t - np.searchsorted(x, a, "right")) <= error
    even = np.arange(100)
    assert q.collapsed(even, np.ones(100, np.int64), 10, False)[0].tolist() == list(range(4, 100, 10))
    assert q.collapsed(even, np.ones(100, np.int64), 10, True)[0].tolist() == list(range(5, 100, 10))


def test_merges_wait_for_the_rest_of_a_group():
    import pyarrow as pa

    def row(g, points):
        edges, w = np.array([0, len(points)]), np.ones(len(points), np.int64)
        return q._summary([pa.array(["s"]), pa.array([g]), pa.array([0], pa.int32()), pa.array([0], pa.int64())], edges, np.array(points), w, np.array([1]), np.array([2]))

    out = [r for b in q._merge(["stream", "grp"], 400, True)(iter([row("a", [3, 5]), row("a", [1, 5]), row("b", [2])])) for r in b.to_pylist()]
    assert [(r["grp"], r["batch"], r["n"], r["points"], r["weights"], r["error"], r["collapses"]) for r in out] == [("a", -1, 4, [1, 3, 5], [1, 1, 2], 2, 4), ("b", -1, 1, [2], [1], 1, 2)]


def test_shop_values_with_broken_rows(spark):
    clicks = spark.createDataFrame([(1, 5, 7, 1.005, "k"), (1, 4, 7, 2.0, "k"), (2, 1, None, 3.0, "k"), (3, 1, 8, None, "k"), (4, 1, 8, -0.015, "k"), (None, 1, 8, 1.0, "k"), (5, 1, 8, float("nan"), "k")], "click_id long, arrived_at long, client_id long, value double, grp string")
    lines = spark.createDataFrame([(1, 9), (1, 9), (1, None), (2, 9), (None, 9), (99, 9), (3, 9)], "item_id long, vendor_id long").withColumn("n", F.lit("x"))
    items = spark.createDataFrame([(1, "B1", 10.0), (2, None, 5.0), (3, "B1", None), (None, "B1", 1.0)], "item_id long, brand string, price double").withColumn("batch", F.lit(5))
    b = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 8
    x = lambda money, i: math.floor(100 * money + 0.5) + 1000 * b(i)
    want = [("value", "7", b(1), x(2.0, 1), 1), ("value", "8", b(4), x(-0.015, 4), 1), ("value", "8", b(None), x(1.0, None), 1), ("price", "B1", b(9), x(10.0, 9), 2), ("price", "B1", b(None), x(10.0, None), 1)]
    assert sorted(tuple(r) for r in q.shop_values(clicks, lines, items).select("stream", "grp", "batch", "x", "n").collect()) == sorted(want)
