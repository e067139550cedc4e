"""The quality ranking: held-out accuracy, what a pair says, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.llm import queries, ranking

SF = "/root/testdata/sf0.1"


def auc(scores, good):
    rank = np.empty(len(scores))
    rank[np.argsort(scores, kind="stable")] = np.arange(1, len(scores) + 1)
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_documents(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    got = queries.op12_quality_classifier(spark, SF)
    rows = got.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert got.count() == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    score, good = np.array([r.score for r in held]), np.array([r.quality == 1 for r in held])
    assert len(held) > 1000 and auc(score, good) > 0.995
    assert (score[good] >= 0.5).mean() > 0.98 and (score[~good] < 0.5).mean() > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = queries.table(spark, SF, "documents").limit(800), queries.table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(ranking.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = ranking.fit_ranking(docs, labels), ranking.fit_ranking(docs, turned)
    assert np.array_equal(one.weights, other.weights) and one.threshold == other.threshold


def test_pairs_are_won_and_the_quantile_splits():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, ranking.N_FEATURES))
    good = x[:, 0] - 2 * x[:, 1] > -1
    model = ranking.Ranking.fit(x, good, float((~good).mean()))
    worth = model.worth(x)
    won = worth[good][:, None] > worth[~good][None, :]
    assert won.mean() > 0.97 and abs((worth < model.threshold).mean() - (~good).mean()) < 0.01
    assert np.argmax(model.weights) == 0 and np.argmin(model.weights) == 1
    assert not ranking.Ranking.fit(x, np.ones(600, bool), 0.0).weights.any()


def test_features_are_of_whole_texts():
    x, n = ranking.features_of(pa.array(["a b a b a b a b a b", "", None, "WORD!! MORE!!", "Ünï ünï\nx"]))
    of = lambda name: x[:, 97 + ranking.SHAPES.index(name)].round(3).tolist()
    assert n.tolist() == [10, 0, 0, 2, 3]
    assert of("said_before") == [0.8, 0, 0, 0, 0] and of("in_repeated_windows") == [1.0, 0, 0, 0, 0] and of("shouted") == [0, 0, 0, 1, 0] and of("marked_end") == [0, 0, 0, 1, 0]
    assert of("lines_a_word")[4] == round((1 / 3) ** 0.5, 3) and not x[1].any()


def test_odd_rows(spark):
    long = " ".join(f"word{i % 999}" for i in range(400000))
    docs = spark.createDataFrame([(1, "some words here.", 1), (1, "some words here.", 1), (None, "x y", 2), (2, None, 3), (3, "", 4), (4, " \n ", 5), (5, long, 6)], "doc_id long, text string, score int").withColumns({"held_out": F.lit("x"), "_text": F.lit("y")})
    got = ranking.rank_quality(docs, ranking.Ranking.plain()).collect()
    assert len(got) == 7 and all(r.score == (0.0 if r.doc_id in (2, 3, 4) else 0.5) for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert ranking.rank_quality(docs.limit(0), ranking.Ranking.plain()).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1), (1, 7)], "doc_id long, quality int")
    assert not ranking.fit_ranking(docs, none).weights.any() and not ranking.fit_ranking(docs.limit(0), none).weights.any()
    assert ranking.rank_quality(docs.drop("held_out").withColumnRenamed("doc_id", "name"), ranking.Ranking.plain(), id_col="name", keep=["_text"]).columns == ["name", "_text", "held_out", "score", "predicted"]


def test_all_labels_teach(spark, monkeypatch):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    seen = []
    monkeypatch.setattr(ranking.Ranking, "learn", lambda total, share: seen.append(total(ranking._moments)[0]) or ranking.Ranking.plain())
    # more documents with a label than any sample had
    many = docs.join(labels, "doc_id").select("doc_id", "text").crossJoin(spark.range(3)).select((F.col("doc_id") + F.col("id") * 10**9).alias("doc_id"), "text")
    marks = labels.crossJoin(spark.range(3)).select((F.col("doc_id") + F.col("id") * 10**9).alias("doc_id"), "quality")
    ranking.fit_ranking(many, marks)
    assert seen == [marks.where(~ranking.held_out("doc_id")).count()] and seen[0] > 4000


def test_parts_give_what_the_whole_gives_and_the_loss_is_least():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, ranking.N_FEATURES))
    good = x[:, 2] + rng.normal(size=900) > 0.5
    one = ranking.Ranking.fit(x, good, 0.7)
    other = ranking.Ranking.learn(lambda f: sum(f(x[i::7], good[i::7]) for i in range(7)), 0.7)
    assert np.allclose(one.weights, other.weights, atol=2e-6) and abs(one.threshold - other.threshold) < 1e-4
    assert abs(one.threshold - np.quantile(one.worth(x), 0.7)) < 1e-5

    def loss(w):
        s = one.normal(x) @ w
        return np.logaddexp(0, s[~good][:, None] - s[good][None, :]).mean() + ranking.DECAY / 2 * w @ w

    assert all(loss(one.weights) < loss(one.weights + rng.normal(size=len(one.weights)) * 0.01) for _ in range(20))
    assert loss(one.weights) < loss(one.weights * 1.01) and loss(one.weights) < loss(one.weights * 0.99)
