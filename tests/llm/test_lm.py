"""The language model's scores are probabilities, and are what its filter says."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import lm, queries
from foliospark.llm.words import span_hashes

from . import brute

SF = "/root/testdata/sf0.001"


def key(word):
    data = np.frombuffer(word + bytes(8), np.uint8)
    return span_hashes(data, np.zeros(1, np.int64), np.array([len(word)]))


def trained(spark, n=10**9):
    docs = queries.table(spark, SF, "documents").limit(n)
    d = docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("_text"))
    made, model, probes, shards = lm.train(d, slice_shard_bytes=1 << 18)
    return docs, lm.whole_filter(made, shards, probes), model, shards


def tokens(text):
    return [w.encode() for w in brute.words((text or "").translate(brute.UP))]


def test_probabilities_sum_to_one_at_most(spark):
    docs, f, model, shards = trained(spark)
    rows = [tokens(r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    words = sorted({w for r in rows for w in r})
    assert model.words == len(words) + 1 and model.tokens == sum(len(r) + 1 for r in rows)
    keys = np.concatenate([*(key(w) for w in words), [lm.END]])
    level = f.levels(keys, lm.shard_of(keys, shards))
    unknown = np.zeros(1, np.int64)
    assert 1 - 1e-6 < model.probability(unknown, np.append(level, 0), unknown).sum() < 1 + 1e-6
    seen = np.array([sum(r.count(w) for r in rows) for w in words[:: max(1, len(words) // 300)]])
    for w in (*words[:: max(1, len(words) // 300)], *(words[i] for i in np.argsort(-level[:-1])[:20])):
        pairs = lm.pair_keys(np.full(len(keys), key(w)[0]), keys)
        context = f.levels(key(w), lm.shard_of(key(w), shards))
        p = model.probability(np.append(f.levels(pairs, lm.shard_of(pairs, shards)), 0), np.append(level, 0), context.repeat(len(keys) + 1))
        assert 0.3 < p.sum() <= 1 + 1e-6, (w, p.sum())
    assert seen.min() > 0


def test_scores_are_what_the_filter_says(spark):
    docs, f, model, shards = trained(spark)
    got = {r.doc_id: r.score for r in lm.score_documents(docs, slice_shard_bytes=1 << 18).collect()}
    one = lambda k: int(f.levels(k, lm.shard_of(k, shards))[0])
    for r in docs.orderBy("doc_id").limit(40).collect():
        before, total = np.array([lm.START], np.uint64), 0.0
        for now in [*(key(w) for w in tokens(r.text)), np.array([lm.END], np.uint64)]:
            context, word, pair = one(before), one(now), one(lm.pair_keys(before, now))
            p_word = (lm.LOW[word] + 0.5) / (model.total + 0.5 * (model.words + 1))
            most = 1.01 * lm.MOST[context] + model.spare
            weight = model.pair_weight * lm.LOW[context] / most
            total += math.log10((1 - weight) * p_word + weight * min(1, lm.LOW[pair] / most))
            before = now
        assert abs(got[r.doc_id] - total) < 1e-6 * max(1, abs(total))


def test_a_text_longer_than_a_slice(spark):
    text = " ".join(f"w{i % 5000}" for i in range(900000))
    assert len(text) > lm.SLICE
    got = lm.score_documents(spark.createDataFrame([(1, text), (2, "w1 w2"), (3, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 900001, 2: 3, 3: 1} and all(math.isfinite(r.score) for r in got)


def test_probes_follow_the_input():
    assert lm.probes_for(0) == lm.LEAST_PROBES < lm.probes_for(1 << 30) < lm.probes_for(1 << 40) <= lm.MOST_PROBES
