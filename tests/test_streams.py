"""The machine that draws pages: single operations, odd streams, forms."""

from pyspark.sql import functions as F

from foliospark.operators import streams as E

COLS = "page int, i int, op string, a double, b double, c double, d double, e double, f double, text string, name string, sub string"


def ops(spark, *pages):
    rows = []
    for p, lines in enumerate(pages):
        for i, (op, *args) in enumerate(lines):
            nums = [float(x) for x in args if not isinstance(x, str)]
            words = [x for x in args if isinstance(x, str)]
            text = words[0] if op in E.SHOWS and words else None
            name, sub = (words[0], words[1] if len(words) > 1 else None) if op == "Do" and words else (None, None)
            rows.append((p, i, op, *(nums + [None] * 6)[:6], text, name, sub))
    return spark.createDataFrame(rows, COLS)


def drawn(df, key=("page",), order="i"):
    return [(r.page, r.kind, r.x0, r.y0, r.x1, r.y1, r.rot, r.n_pts, r.paint_op, r.key_text, r.n_chars) for r in E.elements_of(df, list(key), order).orderBy("page", "el_ix").collect()]


def box(d):
    return [(r[1], *r[2:6]) for r in d]


def test_texts_follow_their_matrices(spark):
    page = [("cm", 2, 0, 0, 2, 10, 0), ("BT",), ("Tm", 1, 0, 0, 1, 5, 5), ("TL", 3), ("Tj", ""), ("T*",), ("Tj", " Fls. 12 "), ("q",), ("ET",)]
    turned = [("BT",), ("Tm", 0, 1, -1, 0, 7, 9), ("Tj", "x"), ("ET",), ("BT",), ("Td", 1, 2), ("TD", 1, -4), ("'", "ab"), ("ET",), ("BT",), ("Tm", 1, 2), ("ET",)]
    assert drawn(ops(spark, page, turned)) == [
        (0, "T", 20.0, 2.0, 24.0, 20.0, False, 0, None, "fls. ##", 9),
        (1, "T", 7.0, 7.0, 11.0, 19.0, True, 0, None, "x", 1),
        (1, "T", 2.0, -8.0, 6.0, 4.0, False, 0, None, "ab", 2),
        (1, "T", 0.0, 0.0, 0.0, 0.0, False, 0, None, "", 0),
    ]


def test_paths_images_and_the_stack(spark):
    page = [("q",), ("cm", 2, 0, 0, 3, 0, 0), ("re", 1, 1, 2, 2), ("S",), ("Q",), ("m", 0, 0), ("l", 5, 1), ("c", 1, 1, 2, 2, 9, 9), ("h",), ("b*",), ("S",), ("re", 0, 0, 1, 1), ("W",), ("n",), ("re", 0, 0, 1, 1), ("f",)]
    images = [("q",), ("cm", 10, 0, 0, 20, 3, 4), ("Do", "Im", "Image"), ("BI",), ("Do", "Fm", "Form"), ("Do", "Gone"), ("Q",), ("Q",), ("BI",), ("cm", 1, 2, 3), ("cm", 0, 5, -5, 0, 5, 0), ("Do", "Im", "Image")]
    got = drawn(ops(spark, page, images))
    assert box(got) == [("P", 2, 3, 6, 9), ("P", 0, 0, 9, 9), ("P", 0, 0, 1, 1), ("I", 3, 4, 13, 24), ("II", 3, 4, 13, 24), ("II", 0, 0, 1, 1), ("I", 0, 0, 5, 5)]
    assert [(r[7], r[8]) for r in got[:3]] == [(4, "S"), (5, "b*"), (4, "f")]


def test_unfinished_unread_and_empty_pages(spark):
    df = ops(spark, [("BT",), ("Tj", "never ends")], [("re", 0, 0, 1, 1)], [("re", 0, 0, 1, 1), ("f",), (None,)], [("ET",), ("Q",), ("T*",), ("f",)])
    assert drawn(df) == [] and [r.page for r in E.unparsed(df, ["page"]).collect()] == [2]
    assert drawn(df.limit(0)) == []
    twice = ops(spark, [("re", 0, 0, 1, 1), ("f",)]).withColumns({"kind": F.lit(1), "el_ix": F.lit("x"), "_at": F.lit(0)})
    assert len(drawn(twice)) == 1
    none = ops(spark, [("re", 0, 0, 1, 1), ("f",)]).withColumn("page", F.lit(None).cast("int"))
    assert box(drawn(none)) == [("P", 0, 0, 1, 1)]


def test_forms_in_forms_and_cycles(spark):
    page = [("Do", "A", "Form"), ("re", 0, 0, 1, 1), ("f",), ("Do", "Z", "Form")]
    bodies = {"A": [("cm", 2, 0, 0, 2, 0, 0), ("re", 0, 0, 1, 1), ("S",), ("Do", "B", "Form")], "B": [("cm", 3, 0, 0, 3, 0, 0), ("Do", "Im", "Image"), ("Q",), ("Q",), ("Do", "A", "Form")]}
    forms = [ops(spark, b).withColumn("form", F.lit(n)).drop("page") for n, b in bodies.items()]
    forms = forms[0].unionByName(forms[1])
    depth = {k: box(drawn(E.with_forms(ops(spark, page), forms, "i", k))) for k in (1, 2, 3, 4)}
    outer, inner, last = ("P", 0, 0, 2, 2), ("I", 0, 0, 6, 6), ("P", 0, 0, 1, 1)
    # B restores twice, so that the next A starts from the page's matrix
    assert depth == {1: [outer, last], 2: [outer, inner, last], 3: [outer, inner, outer, last], 4: [outer, inner, outer, inner, last]}


def test_what_is_left_after_a_removal(spark):
    page = [("q",), ("cm", 1, 0, 0, 1, 0, 0), ("re", 0, 0, 1, 1), ("w", 3), ("S",), ("BT",), ("Tf",), ("Tj", "a"), ("ET",), ("Do", "Im", "Image"), ("re", 0, 0, 1, 1), ("W",), ("n",), ("Q",)]
    df = ops(spark, page, page)
    e = E.elements_of(df, ["page"], "i")
    left = lambda gone: [r.op for r in E.rewritten(df, gone, ["page"], "i").where("page = 0").orderBy("i").collect()]
    assert left(e.where("kind = 'P'")) == ["q", "cm", "w", "BT", "Tf", "Tj", "ET", "Do", "re", "W", "n", "Q"]
    assert left(e.where("kind in ('T', 'I')")) == ["q", "cm", "re", "w", "S", "re", "W", "n", "Q"]
    assert left(e.where("page = 1")) == [x[0] for x in page]


def test_removed_ranges_meet_operations_without_pairs(spark):
    ops = spark.range(0, 3000).selectExpr("0 as page", "id as i", "case when id % 3 = 0 then 'q' when id % 3 = 1 then 're' else 'f' end as op")
    gone = spark.range(0, 900).selectExpr("0 as page", "case when id % 2 = 0 then 'P' else 'T' end as kind", "3 * id as first_op", "3 * id + 2 + id % 5 as last_op")
    left = E.rewritten(ops, gone, ["page"], "i")
    ranges = [(r.kind, r.first_op, r.last_op) for r in gone.collect()]
    want = [r.i for r in ops.collect() if not any(a <= r.i <= z and (kind != "P" or r.op != "q") for kind, a, z in ranges)]
    assert sorted(r.i for r in left.collect()) == want and "Join" not in left._jdf.queryExecution().executedPlan().toString()


def test_operations_that_call_nothing_are_not_one_key(spark, monkeypatch):
    """Rows without a name met in one task where forms are many."""
    monkeypatch.setattr(E, "FEW", -1)
    body = "op string, " + ", ".join(f"{x} double" for x in "abcdef") + ", text string, name string, sub string"
    ops = spark.createDataFrame([(1, i, "q", *[None] * 9) for i in range(400)], f"page int, i long, {body}")
    forms = spark.createDataFrame([("F", 1, "q", *[None] * 9)], f"form string, i long, {body}")
    for setting, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(setting, value)
    try:
        rows = E.with_forms(ops, forms, "i").rdd.glom().map(len).collect()
    finally:
        for setting in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(setting)
    assert sum(rows) == 400 and max(rows) < 200
