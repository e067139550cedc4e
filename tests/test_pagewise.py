"""Boxes of whole pages against brute force, and pages of very many boxes."""

import time

import numpy as np
import pyarrow as pa

from foliospark.operators import pagewise as W


def _components(page, x0, y0, x1, y1, gap):
    label = list(range(len(page)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(page)):
        for j in range(i):
            if page[i] == page[j] and x0[i] <= x1[j] + gap and x0[j] <= x1[i] + gap and y0[i] <= y1[j] + gap and y0[j] <= y1[i] + gap:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(page))]


def test_touching_and_beside_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, m, size = int(rng.integers(1, 60)), int(rng.integers(0, 50)), int(rng.choice([20, 100, 400]))
        page = np.sort(rng.integers(0, 4, n))
        x0, y0 = rng.integers(0, size, n) / rng.choice([1, 3]), rng.integers(0, size, n) / rng.choice([1.0, 7.0])
        x1, y1 = x0 + rng.integers(0, size // 4, n), y0 + rng.integers(0, size // 4, n)
        assert W.touching(page, x0, y0, x1, y1, 3.0).tolist() == _components(page, x0, y0, x1, y1, 3.0)
        vp, vx, v0 = rng.integers(0, 4, m), rng.integers(0, 40, m) / 2, rng.integers(0, 50, m) * 1.0
        v1 = v0 + rng.integers(0, 30, m)
        met = [any(vp[k] == page[i] and abs(vx[k] - x0[i]) <= 5 and v0[k] <= y0[i] + 5 and v1[k] >= y0[i] - 5 and (y0[i] - v0[k] >= 10 or v1[k] - y0[i] >= 10) for k in range(m)) for i in range(n)]
        assert W.beside(page, x0, y0, vp, vx, v0, v1, 5.0, 10.0).tolist() == met


def test_a_page_of_very_many_boxes():
    """Pairs would be 10 ** 10."""
    n, rng = 100_000, np.random.default_rng(2)
    page, flat = np.zeros(n, np.int64), rng.random(n) < 0.5
    x0, y0 = rng.random(n) * 595, rng.random(n) * 842
    x1, y1 = x0 + np.where(flat, 300, 2), y0 + np.where(flat, 2, 120)
    start = time.process_time()
    assert not W.touching(page, x0, y0, x1, y1, 3.0).any()
    W.beside(page, x0, y0, page, x0, y0, y1, 5.0, 10.0)
    assert time.process_time() - start < 30


def test_chunks_are_whole_pages(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 10)
    pages = [None] * 3 + [1] * 45 + [2] + [3] * 8 + [4] * 30
    table = pa.table({"p": pa.array(pages, pa.int64())})
    got = [t.column("p").to_pylist() for t in W.chunks(iter(table.to_batches(max_chunksize=4)), ["p"])]
    assert sum(got, []) == pages and all(a[-1] != b[0] for a, b in zip(got, got[1:]))
    assert W.pages_of(table, ["p"]).tolist() == [0] * 3 + [1] * 45 + [2] + [3] * 8 + [4] * 30
