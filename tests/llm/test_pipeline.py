from collections import Counter

from foliospark.llm import quality, queries

from . import brute

SF = "/root/testdata/sf0.01"


def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline as p

    docs = queries.table(spark, SF, "documents")
    kept = {r.doc_id for r in quality.judge_quality(docs, quality.fit_field(docs, queries.table(spark, SF, "labels"))).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    text = brute.line_dedup(rows)
    rows = [(d, text[d]) for d, _ in rows]
    first = {d for d, _, c in brute.near(rows) if c == d}
    rows = [(d, t) for d, t in rows if d in first]
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.decontaminate(rows, items) if r[-1]}
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    assert sorted((r.doc_id, r.text, r.n_chars) for r in now.collect()) == sorted((d, t, len(t)) for d, t in rows if d not in dirty)
    out = p.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(d for d, _ in rows if d not in dirty)


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    made = spark.createDataFrame([(1, None, "en", None, None), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, "a b " * 40, "en", "s", 1), (3, "x y z " * 4000, "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for d in (made, made.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, d, SF)
            assert name == "pack" or out.columns == d.columns
            out.collect()
