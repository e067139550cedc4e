"""Prefixes of the n-gram join grow where candidates are many, and fewer texts are compared then."""

import random

from pyspark.sql import functions as F

from foliospark.llm import near, setjoin

from . import brute
from .test_operators import docs_of, rows


def made():
    rng = random.Random(3)
    passages = [[f"p{k}_{i}" for i in range(24)] for k in range(12)]
    out = []
    for d in range(160):  # texts made of shared passages: all their shingles are common, few texts are similar
        parts = rng.sample(passages, 4)
        text = [w for p in parts for w in p]
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = f"x{d}"
        out.append((d, " ".join(text)))
    return out + [(1000 + k, " ".join(f"u{k}_{i}" for i in range(80))) for k in range(20)]


def test_prefixes_grow_and_candidates_fall(spark, monkeypatch):
    docs, counts, lengths = made(), {}, {}
    for most in (1, near.MOST_MATCHES):
        seen = []

        def with_texts(pairs, texts):
            seen.append(pairs.count())
            return setjoin.with_texts(pairs, texts)

        def matches(live, m):
            out = original(live, m)
            lengths[m] = out.groupBy("l").count().collect()
            return out

        original = setjoin_matches
        monkeypatch.setattr(near, "with_texts", with_texts)
        monkeypatch.setattr(near, "matches", matches)
        got = rows(near.near_components(docs_of(spark, docs), most_matches=most), "doc_id", "n_shingles", "component_id")
        assert got == sorted(brute.near(docs))
        counts[most] = sum(seen)
    assert lengths[1] == [] and sum(r["count"] for r in lengths[near.MOST_MATCHES]) > 50
    assert counts[near.MOST_MATCHES] < counts[1]


setjoin_matches = near.matches


def test_clashing_columns_stay(spark):
    d = spark.createDataFrame([(7, "a b c d e f", 1, "t"), (8, "a b c d e f", 2, "u"), (9, None, 3, "v")], "doc_id long, text string, _id int, _text string")
    got = near.drop_near(d)
    assert got.columns == d.columns and sorted(tuple(r) for r in got.collect()) == [(7, "a b c d e f", 1, "t"), (9, None, 3, "v")]
    assert near.drop_near(d.where(F.lit(False))).count() == 0
