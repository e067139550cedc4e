import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.llm import chat, decontam, linededup, lm, near, packing, quality, queries, sharding, substrings, urls
from foliospark.llm.ranks import salted_rank

from . import brute

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, key string, e int, token string, piece string, shard string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, "k", 1, "t", "p", "s") for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def table(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: tuple((x is not None, x) for x in r))


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, "a"), (5, "a"), (6, "a b c d e f g h i j k l m n o p"), (7, "word " * 3000), (8, "é ß 漢字 \x0b x\x1fy \x00")]


def test_decontaminate_matches_brute_force(spark, table):
    got = rows(queries.op1_decontaminate(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == sorted(brute.decontaminate(table, items))
    assert sum(r[5] for r in got) > 5


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_decontaminate_odd_rows_and_blocks(spark, block):
    items = [(10, "A"), (9, "b c d"), (8, None), (7, ""), (6, "c d e f g h i j k l m n o p q"), (5, "word word"), (4, "é-ß"), (3, "d e f g h i j k l m n o p"), (2, "D e f g h i j k l m n o p")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = decontam.find_benchmark(docs_of(spark, ODD), bench, block_bytes=block)
    got = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found.collect())
    assert got == sorted(brute.decontaminate(ODD, items))
    for r in found.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
    assert decontam.find_benchmark(docs_of(spark, ODD), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.find_benchmark(docs_of(spark, []), bench).count() == 0


def test_quality_counts(spark, table):
    got = rows(queries.op3_quality_rules(spark, SF), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted((d, *brute.quality(t)) for d, t in table)
    odd = quality.judge_quality(docs_of(spark, ODD), quality.Field.plain())
    assert rows(odd, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted((d, *brute.quality(t)) for d, t in ODD)
    assert quality.filter_quality(docs_of(spark, ODD), quality.Field.plain()).columns == [x.split()[0] for x in DOCS.split(", ")]
    assert quality.judge_quality(docs_of(spark, []), quality.Field.plain()).count() == 0


def test_quality_verdicts_against_held_out_labels(spark):
    docs, labels = queries.table(spark, "/root/testdata/sf0.1", "documents"), queries.table(spark, "/root/testdata/sf0.1", "labels")
    field = quality.fit_field(docs, labels)
    used = labels.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(quality.TRAIN_ROWS)
    rest = quality.judge_quality(docs, field).join(labels.join(used, "doc_id", "left_anti"), "doc_id")
    n = Counter((r.quality, r.kept) for r in rest.select("quality", "kept").collect())
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.97
    assert n[0, False] / (n[0, True] + n[0, False]) > 0.9


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    field = quality.fit_field(docs_of(spark, ODD), none)
    assert (field.weights == quality.Field.plain().weights).all()


def test_viterbi_is_the_best_sequence():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    f = quality.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    sizes = [1, 4, 0, 7, 4]
    first = np.cumsum([0, *sizes])
    x = rng.normal(size=(first[-1], 3))
    got = f.decode(x, first)
    for a, z in zip(first[:-1], first[1:]):
        score = lambda y: sum(x[a + i] @ f.weights[:, k] for i, k in enumerate(y)) + sum(f.moves[p, q] for p, q in zip(y, y[1:]))
        assert z == a or tuple(got[a:z]) == max(itertools.product((0, 1), repeat=z - a), key=score)


def test_near_matches_brute_force(spark, table):
    assert rows(queries.op4_ngram_jaccard(spark, SF), "doc_id", "n_shingles", "component_id") == sorted(brute.near(table))


def test_near_groups_and_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    made = [(100 + k, " ".join(w if i % 30 != k % 30 else f"x{k}" for i, w in enumerate(base))) for k in range(40)]
    common = " ".join(f"c{i}" for i in range(50))
    made += [(200 + k, common + " " + " ".join(f"u{k}_{i}" for i in range(15))) for k in range(40)]
    made += [(300 + k, common.upper()) for k in range(20)] + [(50, "Alpha BETA"), (49, "alpha beta"), (48, "alpha beta gamma")]
    made += ODD
    assert rows(near.near_components(docs_of(spark, made)), "doc_id", "n_shingles", "component_id") == sorted(brute.near(made))
    assert near.near_components(docs_of(spark, [])).count() == 0
    assert near.near_components(docs_of(spark, [(1, None)])).collect()[0].component_id == 1


def test_urls():
    found = urls.automaton()
    assert urls.hits(found, "http://casino-win.example.com/") == ({"casino"}, {"win"})
    assert urls.hits(found, "http://essex.example.com/window") == (set(), set())
    rules = {"example.com": [("/a", "allow")], "com": [("/", "block")], "com.": []}
    assert urls.rule_of("www.example.com", "/ab", rules) == ("example.com/a", "allow")
    assert urls.rule_of("myexample.com", "/ab", rules) == ("com/", "block")
    assert urls.rule_of("example.com", "", rules) is None


def test_url_query(spark):
    made = [(1, "http://A.B.example.COM/en/7?x"), (2, None), (3, "no scheme free bets"), (4, "x://"), (5, "http://example.net/de/8#f"), (6, "http://de.example.org/es"), (7, "ftp://x.y/a://b"), (8, "http://free.bets.io"), (8, "http://free.free.io"), (9, "")]
    got = urls.judge_urls(spark.createDataFrame([(*r, "z") for r in made], "page_id bigint, url string, host string"), queries.RULES)
    got = rows(got, "page_id", "host", "path", "rule", "verdict")
    assert got == [
        (1, "a.b.example.com", "/en/7", "example.com/en/7", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "block"), (4, "", "", None, "allow"), (5, "example.net", "/de/8", "example.net/de/8", "block"),
        (6, "de.example.org", "/es", None, "allow"), (7, "x.y", "/a://b", None, "allow"), (8, "free.bets.io", "", None, "block"), (8, "free.free.io", "", None, "allow"), (9, "", "", None, "allow"),
    ]


def test_line_dedup_matches_brute_force(spark, table):
    want = brute.line_dedup(table)
    got = dict(rows(queries.op6_line_dedup(spark, SF), "doc_id", "text"))
    assert got == want
    assert sum(got[d] != t for d, t in table) > 50


def test_line_dedup_groups_and_odd_rows(spark):
    made = [(100 + k, f"one two three four five six seven eight nine t{k}\nunique{k} line{k}\n\nthe end {'x ' * 12}") for k in range(30)]
    made += [(200 + k, f"page {k} of site") for k in range(30)] + ODD[:-1] + [(9, "a b c d e\nb a c d e e\n\n a"), (-4, "p q\n" * 5)]
    got = linededup.dedup_lines(docs_of(spark, made))
    assert got.columns == [*[x.split()[0] for x in DOCS.split(", ")], "n_lines_removed"]
    assert dict(rows(got, "doc_id", "text")) == brute.line_dedup(made)
    assert got.count() == len(made)
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0
    nulls = linededup.dedup_lines(docs_of(spark, [(None, "a b c"), (1, "a b c"), (None, None)]))
    assert rows(nulls, "doc_id", "text") == [(None, None), (None, "a b c"), (1, "")]


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op7_format_chats(spark, SF).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    assert set(got) == set(turns)
    for c, t in turns.items():
        t.sort()
        loss = "".join(x for _, role, x in t if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(t), brute.sha("".join(f"{r}\n{x}\n" for _, r, x in t)), len(loss), brute.sha(loss))


def test_chat_templates(spark):
    hard = [("user", "</turn>\n<turn x>\n &lt; & ]]"), ("", ""), ("assistant", "\n</turn>"), ("a>\n<turn b", "x\ue000probe\ue001")]
    text, spans, stable = chat.locate(hard)
    assert stable and chat.read_back(text) == hard
    assert [chat.unescape(text[a:z]) for _, a, z, _ in spans] == [t for _, t in hard]
    rewrites = lambda turns: "".join(f"[{i}/{len(turns)}]{t}" for i, (_, t) in enumerate(turns))
    assert chat.locate(hard[:2], rewrites)[2] is False
    made = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, None, None), (None, None, "user", "x"), (2, 0, "assistant", "s"), (2, 0, "assistant", "s")], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.digest_chats(chat.format_chats(made)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars, got[None].n_turns) == (2, 1, 2, 1)
    assert not [r for r in chat.format_chats(made, render=rewrites).collect() if r.conv_id == 2 and r.stable]
    assert chat.format_chats(made.limit(0)).count() == 0


def check_packing(got, ids, size):
    by_bin, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_bin[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    for d, x in ids.items():
        want = Counter((k, a, len(x[a : a + size]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[a : a + size]))) for k, a in enumerate(range(0, len(x), size)))
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]) == want
    return len(by_bin)


def test_packing(spark, table):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    got = queries.op8_pack(spark, SF).collect()
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in table}
    bins = check_packing(got, ids, 4096)
    assert bins <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_packing_odd_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    made = [*[r for r in ODD if r[0] != 5], (11, "It's <|endoftext|> We'LL ÀÉ...,, e\u0301 \u1e9b\u0323 I\u0307 Σας ½ ² ３\u3000x\u00a0y ﬁ"), (12, "don't,stop. (ok) 12 3a")]
    got = packing.pack(docs_of(spark, made), queries.tokenizer(), size=64, with_ids=True).collect()
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in made}
    check_packing(got, ids, 64)
    assert packing.pack(docs_of(spark, []), queries.tokenizer()).count() == 0
    assert len({(r.sequence_id, r.offset) for r in packing.pack(docs_of(spark, [(5, "a")] * 9), queries.tokenizer()).collect()}) == 9


def test_plan_uses_exact_complements():
    bins = packing.plan_bins({60: 5, 40: 3, 25: 2, 15: 3, 70: 1, 10: 3}, 100)
    assert sum(m for m, _ in bins) == 7
    rows_ = packing.plan_rows(bins)
    assert Counter({n: sum(hi - lo for x, lo, hi, _, _ in rows_ if x == n) for n in (60, 40, 25, 15, 70, 10)}) == {60: 5, 40: 3, 25: 2, 15: 3, 70: 1, 10: 3}


def test_sharding(spark, table):
    got = queries.op9_shard(spark, SF).collect()
    text = dict(table)
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in table}
    shard, load, slots = {}, Counter(), defaultdict(list)
    for r in got:
        assert shard.setdefault(text[r.doc_id], r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(16)) and max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_odd_rows(spark):
    got = sharding.shard_groups(docs_of(spark, [*ODD, (None, None), (None, "a")]), shards=3).collect()
    assert len(got) == len(ODD) + 2 and len({r.shard for r in got if r.doc_id in (4, 5)}) == 1
    assert sharding.shard_groups(docs_of(spark, [])).count() == 0


def test_schedule_is_the_heap_rule():
    import heapq

    classes = [(900, 3, 2700), (70, 500, 35000), (8, 1, 8), (3, 40, 120)]
    heap = [(0.0, s) for s in range(16)]
    for c, k, b in classes:
        for _ in range(k):
            x, s = heapq.heappop(heap)
            heapq.heappush(heap, (x + b / k, s))
    load = Counter()
    for c, lo, hi, s in sharding.schedule(classes, 16):
        load[s] += (hi - lo) * {x: b / k for x, k, b in classes}[c]
    assert sorted(load.values()) == sorted(x for x, _ in heap)


def test_salted_rank(spark):
    d = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    for g in range(3):
        assert sorted(r.r for r in salted_rank(d, ["g"], ["id"], "r", 7).where(F.col("g") == g).collect()) == list(range(len([i for i in range(5000) if i % 3 == g])))


def test_substrings_match_brute_force(spark, table):
    got = rows(queries.op10_substring_dedup(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring_dedup(table))
    assert sum(r[2] > 0 for r in got) > 50


def test_substrings_odd_rows(spark):
    import random

    rng = random.Random(5)
    made = [*ODD, (9, "word " * 200), (10, "word " * 70 + "other " + "word " * 60)]
    base = [f"b{i}" for i in range(400)]
    for k in range(60):
        a = rng.randrange(350)
        text = [f"u{k}_{i}" for i in range(rng.randrange(60))] + base[a : a + rng.randrange(40, 180)]
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(["x", "y"])
        made.append((1000 - k, " ".join(text + base[: rng.randrange(70)])))
    made += [(2000, " ".join(base[:49])), (2001, " ".join(base[:50])), (2002, " ".join(base[:50] * 3))]
    got = substrings.dedup_substrings(docs_of(spark, made), block=64)
    assert sorted((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in got.collect()) == sorted(brute.substring_dedup(made))
    assert substrings.dedup_substrings(docs_of(spark, [])).count() == 0
    nulls = substrings.dedup_substrings(docs_of(spark, [(None, " ".join(base)), (1, " ".join(base)), (None, None)])).collect()
    assert sorted(r.n_removed for r in nulls) == [0, 0, 400]


def test_factors_over_a_boundary():
    ref = substrings.Reference([f"a{i}".encode() for i in range(60)] + [f"b{i}".encode() for i in range(60)], 50)
    words = [f"a{i}".encode() for i in range(30, 60)] + [f"b{i}".encode() for i in range(40)]
    assert {p for a, z in ref.windows([b"q", *words, b"q"]) for p in range(a, z + 1)} == set(range(1, 22))


def lm_base(docs):
    import math

    held = {i: zlib.crc32(str(d).encode()) % 5 == 1 for i, (d, _) in enumerate(docs)}
    tokens = [[*brute.words((t or "").translate(brute.UP)), None] for _, t in docs]
    c = Counter(x for i, t in enumerate(tokens) if not held[i] for x in t)
    n, v = sum(c.values()), len(c)
    return sorted((d, held[i], len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6)) for i, ((d, _), t) in enumerate(zip(docs, tokens)))


def test_lm_base_and_score(spark, table):
    got = queries.op2_lm_score(spark, SF).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == lm_base(table)
    total = lambda c, held: sum(r[c] for r in got if r.held_out == held)
    assert total("score", True) > total("base_score", True) and total("score", False) > total("base_score", False)


def test_lm_odd_rows_and_large_filters(spark):
    made = [r for r in ODD if r[0] != 5] + [(20 + k, f"the cat sat on the mat {k}") for k in range(30)]
    one = lm.score_documents(docs_of(spark, made)).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in one) == lm_base(made)
    two = lm.score_documents(docs_of(spark, made), most_filter=0, slice_shard_bytes=100).collect()
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in one} == {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in two}
    three = lm.score_documents(docs_of(spark, made), most_filter=1 << 20, slice_shard_bytes=100).collect()
    assert {r.doc_id: round(r.score, 6) for r in two} == {r.doc_id: round(r.score, 6) for r in three}
    assert lm.score_documents(docs_of(spark, [])).count() == 0
    assert len(lm.score_documents(docs_of(spark, [(None, None), (None, "x")])).collect()) == 2


def test_filter_levels():
    import numpy as np

    keys = lm.mix(np.arange(1, 20001).astype(np.uint64))
    counts = np.random.default_rng(2).zipf(1.5, 20000).clip(max=10**6)
    f = lm.Filter([lm.Filter.part(keys[:10000], counts[:10000], 8)], 8)
    got = f.levels(keys, np.zeros(20000, int))
    want = np.searchsorted(lm.THRESHOLDS, counts, "right")
    assert (got[:10000] >= want[:10000]).all() and (got[:10000] == want[:10000]).mean() > 0.97
    assert (got[10000:] == 0).mean() > 0.97
