"""Parts by measured size: shared objects, single large pages, odd rows."""

from pyspark.sql import functions as F

from foliospark.operators import measured as M

MB = 1024 * 1024


def parts(spark, pages, objects, most_mb=1.0, overhead=0):
    p = spark.createDataFrame(pages, "file string, page int")
    o = spark.createDataFrame(objects, "file string, page int, name string, bytes long").repartition(3)
    placed = M.page_parts(p.repartition(4), o, "file", "page", most_mb=most_mb, overhead=overhead)
    return [tuple(r) for r in M.measured_parts(placed, "file", most_mb).orderBy("file", "part_no").collect()]


def test_shared_objects_count_once_a_part(spark):
    limit = int(MB * 0.9)
    font, own = limit // 2, limit // 8
    pages = [("a", k) for k in range(9)]
    objects = [("a", k, n, b) for k in range(9) for n, b in (("font", font), (f"page {k}", own))]
    got = parts(spark, pages, objects)
    assert got == [("a", 1, 1, 4, font + 4 * own, 4 * (font + own), False), ("a", 2, 5, 8, font + 4 * own, 4 * (font + own), False), ("a", 3, 9, 9, font + own, font + own, False)]


def test_no_page_is_lost_and_large_ones_stand_alone(spark):
    pages = [("a", k) for k in range(5)] + [("b", 0)]
    objects = [("a", k, f"o{k}", b) for k, b in enumerate([10, 2 * MB, 10, 10, 3 * MB])] + [("b", 0, "x", 5)]
    assert [r[1:5] + r[6:] for r in parts(spark, pages, objects, overhead=7)] == [(1, 1, 1, 17, False), (2, 2, 2, 2 * MB + 7, True), (3, 3, 4, 27, False), (4, 5, 5, 3 * MB + 7, True), (1, 1, 1, 12, False)]
    assert [r[:4] for r in parts(spark, pages, objects, most_mb=0)] == [("a", 1, 1, 5), ("b", 1, 1, 1)]


def test_odd_rows(spark):
    pages = [(None, 1), ("a", None), ("a", 1), ("a", 1), ("a", 2)]
    objects = [("a", 1, "x", 30), ("a", 1, "x", 20), ("a", 1, None, 99), ("a", 1, "y", -5), ("a", 1, "z", None), (None, 1, "n", 8), ("a", None, "m", 4), ("c", 1, "lost", 1)]
    assert parts(spark, pages, objects) == [(None, 1, 1, 1, 8, 8, False), ("a", 1, 1, 4, 34, 64, False)]
    assert parts(spark, [], objects) == []
    p = spark.createDataFrame([("a", 1)], "file string, page int").withColumns({"part_no": F.lit("x"), "_objects": F.lit(1)})
    o = spark.createDataFrame([("a", 1, "x", 3)], "file string, page int, name string, bytes long").withColumn("page_no", F.lit(0))
    assert M.page_parts(p, o, "file", "page").columns == ["file", "page", "page_no", "part_no", "grown", "alone"]
