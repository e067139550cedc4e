"""The prefix trie against plain Python, over few and many blocks."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.llm import queries, trie

from ..compare import connect, difference
from . import brute

ROWS = "conv_id long, turn long, role string, text string"


def plain(convs):
    """Nodes of {conv: [(role, text), ...]} as tuples in the order of the query's columns."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        spare = sum((len(members[p]) - 1) * len(brute.words(p[-1][1])) for p in below if p)
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below)
        ends = sorted(c for c in ids if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(ids), len(path), parent, len(ids), len(kids), leaves, spare, brute.sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def grouped(rows):
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def folded(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def made(seed, n, depth, kinds):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(5 * n), n):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["", None, "a b", "c", "a  b\tc"])) for _ in range(rng.randint(1, depth))] if rng.random() < kinds else [("user", "x y")] * rng.randint(1, depth)
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed, n, depth, kinds, blocks", [(1, 60, 4, 0.8, 1), (2, 120, 3, 0.7, 9), (3, 150, 6, 0.3, 23), (4, 90, 2, 0.0, 40)])
def test_equals_plain_python(spark, seed, n, depth, kinds, blocks):
    rows = made(seed, n, depth, kinds)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    assert got(trie.prefix_trie(trie.conversations(trie.named_turns(df)), blocks=blocks)) == plain(grouped(rows))
    assert got(trie.prefix_trie(trie.rebuilt(trie.named_turns(df)), blocks=blocks)) == plain(folded(grouped(rows)))


def test_copies_that_fill_blocks(spark):
    """One conversation a thousand times: its node is open in every block, and its ids are hashed across them."""
    rows = [(c, t, "user", "same words here") for c in range(1000) for t in range(2)] + [(5000, 0, "user", "other")]
    df = spark.createDataFrame(rows, ROWS)
    assert got(trie.prefix_trie(trie.conversations(trie.named_turns(df)), blocks=31)) == plain(grouped(rows))


def test_nulls_ties_long_ones_and_other_columns(spark):
    long = [(7, t, "user", f"turn {t % 3}") for t in range(300)]
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (3, 0, "us", "er"), (4, 0, "u", "ser"), *long]
    df = spark.createDataFrame(rows, ROWS).withColumns({"conv": F.lit("x"), "pos": F.lit(1.5), "name": F.lit(None).cast("string"), "key": F.lit(2), "block": F.lit(3)})
    out = got(trie.prefix_trie(trie.conversations(trie.named_turns(df)), blocks=5))
    assert out == plain(grouped(rows)) and len(out) == 307
    assert got(trie.prefix_trie(trie.conversations(trie.named_turns(df.limit(0))))) == []


def test_a_conversation_without_turns_ends_at_the_root(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "user", "gone"), (60, 0, "user", "stays"), (60, 1, "user", "too"), (60, 2, "user", "and more"), (60, 3, "user", "last")]
    out = got(trie.prefix_trie(trie.rebuilt(trie.named_turns(spark.createDataFrame(rows, ROWS)))))
    assert out == plain(folded(grouped(rows))) and [r for r in out if r[1] == 0][0][7] == brute.sha(str(c))


def test_common_start():
    name = lambda *x: b"".join(i.to_bytes(trie.NAME, "big") for i in x)
    assert [trie.common(name(1, 2, 3), name(*o)) for o in ((), (1,), (1, 2), (1, 2, 3, 4), (1, 9, 3), (9,))] == [0, 1, 2, 3, 1, 0]


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(spark, connect(sf), queries.QUERIES["op11_conversation_trie"], queries.ORACLE["op11_conversation_trie"], sf) is None
