"""The quality field labels lines, not documents."""

from pyspark.sql import functions as F

from foliospark.llm import quality, queries

SF = "/root/testdata/sf0.1"


def test_lines_of_one_document_get_both_labels(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    field = quality.fit_field(docs, labels)
    pick = lambda q: [r.text for r in docs.join(labels.where(f"quality = {q}"), "doc_id").where("size(split(text, '\n')) between 2 and 6 and n_chars between 500 and 4000").orderBy(F.xxhash64("doc_id")).limit(40).collect()]
    good, bad = pick(1), pick(0)
    half = lambda t, n: "\n".join(t.split("\n")[:n])
    made = [(k, f"{g}\n{half(b, 1)}", 0) for k, (g, b) in enumerate(zip(good, bad))] + [(100 + k, f"{half(g, 1)}\n{b}", 1) for k, (g, b) in enumerate(zip(good, bad))]
    got = quality.judge_quality(spark.createDataFrame([(d, t) for d, t, _ in made], "doc_id long, text string"), field).where("not base_failed").collect()
    mixed = [r for r in got if 0 < r.content_words < r.n_words]
    assert len(mixed) > 0.5 * len(got) > 10
    # the share decides, and it isn't 0 or 1
    assert {r.kept for r in mixed} == {True, False}
    assert all(r.kept == (r.content_words >= quality.CONTENT_SHARE * r.n_words) for r in got)
    strict = quality.judge_quality(docs, field, share=0.99).where("kept").count()
    assert strict < quality.judge_quality(docs, field).where("kept").count()


def test_a_long_text_and_rows_without_id(spark):
    text = "\n".join(f"word{i} and the other {i % 7} words of this line." for i in range(120000))
    made = spark.createDataFrame([(1, text), (None, "a b c d e f g h i j k l m"), (None, None)], "doc_id long, text string")
    got = {r.n_words: r for r in quality.judge_quality(made, quality.Field.plain()).collect()}
    assert set(got) == {1080000, 13, 0} and got[1080000].content_words == 1080000 and got[0].base_failed and got[13].doc_id is None
