"""Line dedup: names, ids and texts of every kind; its plan."""

from foliospark.llm import linededup

LONG = "\n".join(f"w{i} x{i} y{i} z{i}" for i in range(70000))


def test_clashing_columns_and_large_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    made = spark.createDataFrame(
        [(0, f"{a}\nfirst", 7, "t", 5, "g"), (1 << 40, f"{a}\nsecond one", 8, "u", 6, "h"), ((1 << 62) + 3, f"{b}\n{b} {b}", 9, "v", 7, "i"), (-(1 << 62), f"{b} thirteen", None, None, None, None)],
        "doc_id bigint, text string, _id int, _text string, n_lines_removed int, id string",
    )
    got = linededup.dedup_lines(made)
    assert got.columns == [*made.columns, "n_lines_removed_"]
    assert sorted(tuple(r) for r in got.collect()) == [
        (-(1 << 62), f"{b} thirteen", None, None, None, None, 0),
        (0, f"{a}\nfirst", 7, "t", 5, "g", 0),
        (1 << 40, "second one", 8, "u", 6, "h", 1),
        ((1 << 62) + 3, "", 9, "v", 7, "i", 2),
    ]


def test_ids_that_are_text(spark):
    got = linededup.dedup_lines(spark.createDataFrame([("b", "x y z"), ("a", "z y x\nk"), (None, "q")], "key string, body string"), id_col="key", text_col="body")
    assert sorted((r.key or "", r.body) for r in got.collect()) == [("", "q"), ("a", "z y x\nk"), ("b", "")]


def test_a_very_long_text(spark):
    made = spark.createDataFrame([(1, LONG), (2, "z5 y5 x5 w5\nother\n" + LONG), (3, "w69999 x69999 y69999 z69999")], "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in linededup.dedup_lines(made).collect()}
    assert got == {1: (LONG, 0), 2: ("other", 70001), 3: ("", 1)}


def test_no_python_on_the_main_path(spark):
    out = linededup.dedup_lines(spark.createDataFrame([(1, "a b\nb a")], "doc_id bigint, text string"))
    assert not {"Python", "Arrow", "Pandas"} & {w for x in ("Python", "Arrow", "Pandas") for w in [x] if x in out._jdf.queryExecution().toString()}
    source = open(linededup.__file__).read()
    assert not any(x in source for x in ("numpy", "pyarrow", "mapIn", "applyIn", "udf", ".rdd"))
