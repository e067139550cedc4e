"""Streams after a restart, sinks of failing jobs, runs that are cancelled."""

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from foliospark.operators import steps as R
from foliospark.sources.files_sink import TextFiles
from foliospark.streaming import emissions as E

EVENTS = "file string, at double, done double, force boolean"


def made(n=240):
    rng, rows, clock = random.Random(4), [], {f: 0.0 for f in "abcde"}
    for _ in range(n):
        f = rng.choice("abcde")
        clock[f] += rng.choice([0.01, 0.05, 0.2, 1.0])
        rows.append((f, round(clock[f], 3), float(rng.randint(0, 50)) + clock[f], rng.random() < 0.1))
    return rows


def key(r):
    return (r.file, r.at, r.percent, None if r.ema is None or r.ema != r.ema else round(r.ema, 9), None if r.remaining is None or r.remaining != r.remaining else round(r.remaining, 6))


def test_a_restarted_stream_says_what_the_batch_says(spark, tmp_path):
    rows, source, sink, state = made(), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):  # the query ends after each part, and starts again from its checkpoint
            spark.createDataFrame(rows[80 * k : 80 * (k + 1)], EVENTS).coalesce(1).write.mode("append").parquet(source)
            s = E.emission_stream(spark.readStream.schema(EVENTS).parquet(source), "file", 120.0)
            q = s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(name)
    got = sorted(map(key, spark.read.parquet(sink).collect()), key=str)
    want = sorted(map(key, E.emissions(spark.createDataFrame(rows, EVENTS), "file", [], 120.0).collect()), key=str)
    assert got == want and 20 < len(got) < len(rows)
    for f in "abcde":
        told = [r[2] for r in sorted(got, key=lambda r: (r[0], r[1])) if r[0] == f]
        assert told == sorted(told) and told[-1] <= 99


def test_one_message_a_gap_but_for_forced_ones(spark):
    rows = [("a", 0.0, 0.0, False), ("a", 0.05, 6.0, False), ("a", 0.06, 7.0, True), ("a", 0.15, 8.0, False), ("a", 0.17, 5.0, False), ("a", None, 9.0, True), (None, 1.0, 9.0, True), ("b", 9.0, None, None)]
    got = {(r.file, r.at): r for r in E.emissions(spark.createDataFrame(rows, EVENTS), "file", [], 100.0).collect()}
    assert sorted(got) == [("a", 0.0), ("a", 0.06), ("a", 0.17), ("b", 9.0)]
    assert [got["a", t].percent for t in (0.0, 0.06, 0.17)] == [0, 7, 7]
    assert abs(got["a", 0.06].ema - 0.06 / 7) < 1e-12 and abs(got["a", 0.17].ema - (0.3 * 0.17 / 5 + 0.7 * 0.06 / 7)) < 1e-12
    assert E.emissions(spark.createDataFrame([], EVENTS), "file", [], 100.0).count() == 0


def texts(folder):
    return {f: open(os.path.join(d, f)).read() for d, _, names in os.walk(folder) for f in names}


def test_text_files_all_or_nothing(spark, tmp_path):
    spark.dataSource.register(TextFiles)
    path = str(tmp_path / "docs")
    write = lambda df, mode="overwrite": df.write.format("text_files").mode(mode).option("path", path).option("key", "k").option("text", "t").save()
    rows = [(f"folha/{i}", f"texto {i}\n\nçã" if i else None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, t string").repartition(5)
    write(df)
    want = {f"folha%2F{i}.md": f"texto {i}\n\nçã" if i else "" for i in range(20)}
    assert texts(path) == want
    fails = df.withColumn("t", F.when(F.col("k") == "folha/7", F.raise_error(F.lit("no page"))).otherwise("x"))
    twice = df.unionByName(df.where("k = 'folha/3'")).coalesce(1)
    for bad in (fails, twice, df.withColumn("k", F.lit(None).cast("string"))):
        with pytest.raises(Exception):
            write(bad)
        assert texts(path) == want and os.listdir(tmp_path) == ["docs"]
    with pytest.raises(Exception):
        write(df, "append")
    assert texts(path) == want and os.listdir(tmp_path) == ["docs"]
    write(df.where("k = 'folha/1'"))
    assert texts(path) == {"folha%2F1.md": "texto 1\n\nçã"}


def test_progress_never_falls_and_counts_rows(spark, tmp_path):
    said = []
    steps = [R.Step(n, u, lambda k=k: spark.range(10 * k), lambda d, n=n: d.write.parquet(str(tmp_path / n))) for k, (n, u) in enumerate([("clean", 1.0), ("ocr", 2.6), ("export", 0.0)], 1)]
    assert R.Run(spark, steps, lambda *x: said.append(x)).start() == {"clean": 10, "ocr": 20, "export": 30}
    assert said == [("clean", 27, 10), ("ocr", 99, 20), ("export", 100, 30)]


def test_a_cancelled_run_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(TextFiles)
    slow = F.udf(lambda x: time.sleep(0.4) or str(x), "string")
    rows = lambda: spark.range(400).repartition(40).select(F.col("id").alias("file_id"), slow("id").alias("markdown"))
    write = lambda d: d.write.format("text_files").mode("overwrite").option("path", str(tmp_path / "docs")).save()
    said = []
    first = R.Step("clean", 1.0, lambda: spark.range(3), lambda d: d.write.parquet(str(tmp_path / "clean")))
    run = R.Run(spark, [first, R.Step("export", 1.0, rows, write), R.Step("never", 1.0, rows, write)], lambda *x: said.append(x))
    threading.Timer(4.0, run.cancel).start()
    t = time.time()
    with pytest.raises(R.Cancelled):
        run.start()
    assert time.time() - t < 30 and said == [("clean", 33, 3)] and run.percent == 33
    assert sorted(os.listdir(tmp_path)) == ["clean"]
    with pytest.raises(R.Cancelled):
        run.start()


def test_scans_in_forms_down_to_the_fourth(spark):
    from foliospark.sources import files as S

    chain = [(k, k + 1, "Form", None, None) for k in range(1, 8)] + [(8, 9, "Image", 1000, 300), (8, 10, "Image", 1000, 299), (20, 21, "Form", None, None), (21, 20, "Form", None, None), (30, 31, "Image", 10, 10), (40, 40, "Form", None, None), (40, 41, "Image", 600, 500)]
    x = spark.createDataFrame(chain, "parent int, child int, subtype string, w long, h long")
    assert sorted(r.root for r in S.xobject_scans(x).collect()) == [5, 6, 7, 8, 40]
    assert S.xobject_scans(x.limit(0)).count() == 0
