"""Golden cases of single functions, and the streaming and source helpers."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.operators import parts as R
from foliospark.operators import zones as Z
from foliospark.sources import files as S
from foliospark.streaming import pages as P


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "line, want",
    [("DESPACHO", "DESPACHO"), ("  TERMO DE   ENTREGA ", "TERMO DE ENTREGA"), ("OFÍCIO Nº 7-B", "OFÍCIO Nº 7-B"), ("um despacho em minúsculas", None), ("Despacho", None), ("DESPACHOS DO DIA", None), ("A" * 80, None), ("", None)],
)
def test_heading(spark, line, want):
    assert one(spark, T.heading(F.lit(line))) == want


def test_tables(spark):
    md = lambda rows: spark.createDataFrame([(rows,)], "r array<array<string>>").select(T.table_md(F.col("r"))).first()[0]
    assert md([["a"], ["b"]]) is None and md([["a", "b"]]) is None
    assert md([["Nome", "Valor"], [None, ""], ["x", "1|2"]]) == "| Nome | Valor |\n| --- | --- |\n| x | 1\\|2 |"


def test_suffix(spark):
    assert one(spark, T.without_suffix(F.lit("alfa beta\nfim da folha 3"), F.lit("fim  da folha 3"))) == "alfa beta"
    assert one(spark, T.without_suffix(F.lit("alfa beta"), F.lit("gama"))) is None
    assert one(spark, T.without_suffix(F.lit("x (a.b) [1\\]"), F.lit("[1\\ ]"))) == "x (a.b)"


def test_containment_and_ordinals(spark):
    text = F.lit("O barco azul chegou tarde ao porto velho com muitas caixas vazias")
    assert one(spark, T.contained(F.lit("barco chegou porto caixas"), text))
    assert not one(spark, T.contained(F.lit("montanha neve inverno frio"), text)) and not one(spark, T.contained(F.lit(""), text))
    assert one(spark, T.fix_ordinals(F.lit("bªrcº 3ª 8º pºrtª"))) == "barco 3ª 8º porta"


@pytest.mark.parametrize("box, want", [((100, 200, 184, 284), False), ((100, 200, 210, 310), True), ((0, 0, 612, 0.9 * 792), False), ((100, 0.85 * 792 + 1, 300, 790), False)])
def test_region_candidate(spark, box, want):
    row = dict(zip(("x0", "y0", "x1", "y1"), map(float, box))) | {"kind": "I", "rot": False, "W": 612.0, "H": 792.0}
    assert one(spark, G.region_candidate(), **row) is want


def test_usable_and_times(spark):
    assert not one(spark, T.usable(F.lit("a" * 19))) and one(spark, T.usable(F.lit("a" * 20)))
    assert not one(spark, T.usable(F.lit("" * 10 + "a" * 20)))
    assert [one(spark, T.clock(F.lit(s))) for s in (59, 3600)] == ["00:59", "1:00:00"]
    assert [one(spark, T.remaining(F.lit(float(s)))) for s in (5, 55, 150)] == ["resta ~10 s", "resta ~50 s", "restam ~2 min"]


def test_split(spark):
    kb = lambda sizes: spark.createDataFrame([("f", i, s * 1024) for i, s in enumerate(sizes)], "k string, i int, b bigint")
    rows = R.split_by_size(kb([200] * 15), "k", "i", "b", 1).orderBy("part_no").collect()
    assert [r.last_page - r.first_page + 1 for r in rows] == [4, 4, 4, 3] and rows[0].first_page == 1
    rows = R.split_by_size(kb([100, 2000, 100]), "k", "i", "b", 1).orderBy("part_no").collect()
    assert [(r.first_page, r.last_page, r.oversize) for r in rows] == [(1, 1, False), (2, 2, True), (3, 3, False)]
    assert R.split_by_size(kb([50, 50]), "k", "i", "b", 0).count() == 1


@pytest.mark.parametrize("strips, want", [([(0, 0.47), (0.47, 0.94)], True), ([(0, 0.33), (0.33, 0.66), (0.66, 1)], True), ([(0.95, 1)], False), ([(0.25, 0.75)], False)])
def test_strips(spark, strips, want):
    h = 842.0
    rows = [("f", 0, i, "I", 0.0, a * h, 595.0, z * h, False, 595.0, h) for i, (a, z) in enumerate(strips)]
    d = spark.createDataFrame(rows, "file_id string, page_id int, el_ix int, kind string, x0 double, y0 double, x1 double, y1 double, rot boolean, W double, H double")
    assert Z.scanned_strips(d).first().protect is want


def test_stream_gives_what_batch_gives(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    d.write.parquet(str(tmp_path / "in"))
    q = P.judged(P.read_pages(spark, str(tmp_path / "in"), "doc_id bigint, text string")).writeStream.format("memory").queryName("judged_pages").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("judged_pages").collect())) == sorted(map(tuple, P.judged(d).collect()))


def test_files(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "a_limpo.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "d.pdf").write_bytes(b"yz")
    got = [(r.path.rsplit("/", 1)[1], r.length) for r in S.list_files(spark, str(tmp_path)).collect()]
    assert got == [("a.pdf", 1), ("b.pdf", 1), ("d.pdf", 2)]
    assert S.output_path("/x/a.pdf") == "/x/a_limpo.pdf"


def test_scan_forms(spark):
    rows = [("page", "f1", "Form", 0, 0), ("f1", "f2", "Form", 0, 0), ("f2", "im", "Image", 1000, 400), ("page2", "im2", "Image", 10, 10)]
    d = spark.createDataFrame(rows, "parent string, child string, subtype string, w int, h int")
    assert {r[0] for r in S.xobject_scans(d).collect()} == {"page", "f1", "f2"}


def test_pages_of_one_size_in_whole_points(spark):
    from foliospark.operators import boilerplate as B

    rows = [(1, p, 1, "T", 50.0, 800.0, 90.0, 810.0, False, "T|200|head", w, 842.0 - p / 10) for p, w in ((1, 594.96), (2, 595.2), (3, 595.0), (4, 595.4))]
    d = spark.createDataFrame(rows, "file_id int, page_id int, el_ix int, kind string, x0 double, y0 double, x1 double, y1 double, rot boolean, key string, W double, H double")
    got = B.repeated_keys(d).collect()
    assert [(r.key, r.pages, r.W, r.H) for r in got] == [("T|200|head", 4, 595.0, 842.0)]


def test_ordinals_that_follow_each_other(spark):
    assert one(spark, T.fix_ordinals(F.lit("jªª 1ª ªªl 1ºº"))) == "jaa 1ª aal 1ºº"


def test_letters_of_any_language_are_no_rule(spark):
    from foliospark.operators import reports

    assert [one(spark, reports.digits_only(F.lit(f"T|-3|{x}"))) for x in ("Ö Ö Ö", "é", "--- #", "")] == [False, False, True, True]


def test_every_row_is_numbered_however_blocks_are_cut(spark):
    from foliospark.operators import numbering

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("source", "doc_id", "text")
        got = numbering.numbered(d, "source", ["doc_id"])
        assert got.select("source", "page_no").distinct().count() == d.count() == got.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ordered_differences_make_objects_of_few_texts_at_a_time():
    import pyarrow as pa

    from foliospark.operators import audit

    lines = pa.array([["a", "b"]] * 300, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), lines, pa.array([["b"]] * 300, pa.list_(pa.string()))], names=["_k", "a", "z"])
    got = list(audit._diff(iter([batch])))
    assert max(b.num_rows for b in got) <= 64 and sum((b.column("lost").to_pylist() for b in got), []) == [["a"]] * 300
