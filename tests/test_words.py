"""Recognised words at size: plans without a shuffle of words, and rows that are odd."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions import values as V
from foliospark.operators import recognition as O
from foliospark.operators import reports as X
from foliospark.plans import registry


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(1, "um dois tres  quatro\ncinco"), (2, ""), (3, None), (4, " ".join(f"palavra{i % 70}ª" for i in range(130))), (None, "alfa beta gama"), (6, " \n ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_widths_are_looked_up_once_a_character(spark):
    texts = ["", "Ação (l)", "WM@", "\U0001f600x", "ā一", "|{}\"'^", None]
    want = [None if t is None else sum({x: w for w, cs in V.WIDTHS.items() for x in cs}.get(x, 556) for x in t) / 1000.0 for t in texts]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in d.orderBy("i").select(T.helvetica_width(F.col("t"))).collect()] == want
    assert "translate" not in plan(d.select(T.helvetica_width(F.col("t"))))


def test_white_space_at_the_ends(spark):
    d = spark.createDataFrame([(chr(i) + "a" + chr(i),) for i in range(0x3100)], "t string")
    assert d.where(T.strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    assert "regexp" not in plan(d.select(T.strip(F.col("t"))))


def test_blocks_of_pages_are_those_of_words(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    page = docs.select("doc_id", F.expr("array_join(transform(split(translate(text, '\n', ' '), ' '), (w, k) -> if(floor(k / 40) % 3 = 1, reverse(w), w)), ' ')").alias("page_text"))
    want = O.blocks(O.accepted(registry._words(spark, folder)), page, ["doc_id"])
    got = registry.QUERIES["block_confidence"](spark, folder)
    of = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.region, r.text, round(r.conf, 6)) for r in d.collect())
    assert of(got) == of(want) and {r[0] for r in of(got)} == {-1, 4}
    assert not {"Aggregate", "Join"} & set(plan(got).replace("[", " ").split())


def test_preview_of_pages_with_several_rows(spark):
    d = spark.createDataFrame([(1, ["a", "b"], ["a"]), (1, ["c"], ["b", "c"]), (2, ["x", "y", "x"], ["y"]), (3, ["k"], None), (None, ["q"], []), (4, None, ["z"]), (5, ["s"], [])], "k int, a array<string>, z array<string>")
    assert sorted(map(tuple, X.word_preview(d, "k", "a", "z", words=2, pages=2).collect())) == [(2, "x x"), (3, "k")]
    assert sorted(r.k for r in X.word_preview(d, "k", "a", "z").collect()) == [2, 3, 5]
