"""Baselines of removed frames, and frames that come back."""

from foliospark.operators import baseline as X

JUDGED = "file_id int, page_id int, kind string, x0 double, y0 double, x1 double, y1 double, reason string"


def test_frames_are_kept_as_often_as_they_were(spark):
    box = (1.5, 2.5, 3.5, 4.0)
    rows = [(1, 1, "P", *box, "boiler_path"), (1, 1, "P", *box, "cluster_topo"), (1, 1, "T", 0.0, 0.0, 0.0, 0.0, "boiler_texto"), (1, 1, "T", *box, "corte_topo"), (1, 2, "I", *box, None), (2, 1, "I", *box, "tarja_margem")]
    keys = X.frame_keys(spark.createDataFrame(rows, JUDGED))
    stored = X.baseline(keys)
    assert sorted((r.file_id, r.page_id, r.removed) for r in stored.collect()) == [(1, 1, ["P:2:2:4:4", "P:2:2:4:4"]), (2, 1, ["I:2:2:4:4"])]
    assert sorted(map(tuple, X.stored_keys(stored).collect())) == sorted(map(tuple, keys.collect()))
    now = spark.createDataFrame([(1, 1, "P", 2.4, 2.0, 4.4, 4.0, None), (1, 1, None, *box, None), (1, 2, "I", *box, None)], JUDGED)
    assert sorted(map(tuple, X.failures(keys, X.present_keys(now)).collect()), key=str) == [(1, 1, "P:2:2:4:4", 2, "reappeared"), (2, None, None, 1, "missing")]
    assert X.failures(keys.limit(0), X.present_keys(now)).count() == 0
