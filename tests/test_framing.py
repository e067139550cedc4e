"""The one pass over pages against plain forms."""

import numpy as np

from foliospark.operators import framing as R
from foliospark.operators import verdict as D


def test_lines_of_small_paths_are_a_fold_from_the_top():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 80))
        page, y = np.sort(rng.integers(0, 4, n)), rng.integers(600, 640, n) / rng.choice([1.0, 2.0])
        want = np.zeros((n, 2))
        for p in set(page.tolist()):
            line, start = -1, None
            for i in sorted(np.flatnonzero(page == p), key=lambda i: -y[i]):
                if start is None or abs(start - y[i]) > 3.5:
                    line, start = line + 1, y[i]
                want[i] = line, start
        line, start = R.lines_of(page, y)
        assert line.tolist() == want[:, 0].tolist() and start.tolist() == want[:, 1].tolist()


def test_rules_read_the_elements_once(spark):
    """They were computed or scanned again for each thing that the rules ask."""
    from foliospark.plans.vehicles import elements

    d = elements(spark, "/root/testdata/sf0.001")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = d.mapInArrow(count, d.schema)
    assert D.reasons(d).where("reason is not null").count() > 0
    read = seen.value
    spark.catalog.clearCache()
    assert read == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_page_cuts_number_no_elements(spark):
    """A number for each element of a page takes a shuffle of all that elements have."""
    from foliospark.plans.registry import QUERIES

    plan = QUERIES["page_cuts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_letters_are_dealt_out_before_they_are_written(spark, monkeypatch):
    from foliospark.plans import letters

    seen = []
    monkeypatch.setattr(letters, "kept", lambda d: seen.append(d._jdf.queryExecution().optimizedPlan().toString()) or d)
    letters.letters(spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in seen[0]
