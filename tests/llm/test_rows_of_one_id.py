"""Rows without an id, and rows of one id with different texts."""

from foliospark.llm import linededup, substrings

from . import brute
from .test_operators import docs_of

LAST = 1 << 40


def test_substrings_of_rows_of_one_id(spark):
    w = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"]
    made = [(1, f"{w[0]} {w[1]}"), (None, f"{w[2]} {w[3]} {w[0]}"), (None, "short text"), (None, f"{w[4]} {w[5]} {w[6]}"), (None, f"{w[2]} {w[3]} {w[0]}")]
    # texts of one id aren't before one another, but all of them are before later ids
    made += [(5, f"{w[2]} x {w[1]}"), (5, f"{w[6]} {w[2]} y"), (5, "short"), (7, f"z {w[6]} {w[2]}"), (8, f"{w[3]} v {w[6]}")]
    got = substrings.dedup_substrings(docs_of(spark, made), block=64).collect()
    want = brute.substring_dedup([(LAST if d is None else d, t) for d, t in made])
    assert sorted((LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in got) == sorted(want)
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0, 60, 180, 180]


def test_lines_of_rows_of_one_id(spark):
    one, two, three = (f"{c} one two three four five six seven" for c in ("a b c d", "e f g h", "i j k l"))
    made = [(None, f"{one}\n{one}\nrest of it"), (None, "clean line\nother words here\nmore of them"), (None, None), (None, ""), (None, "clean line\nother words here\nmore of them")]
    made += [(3, f"{two}\n{two}"), (3, "first\nsecond words\nthird"), (3, None), (4, f"{three}\nq r s\nfourth line"), (5, f"{one}\n{three}\nlast line")]
    got = linededup.dedup_lines(docs_of(spark, made))
    assert got.columns == ["doc_id", "text", "key", "e", "token", "piece", "shard", "n_lines_removed"]
    want = [(None, f"{one}\nrest of it", 1), (None, "clean line\nother words here\nmore of them", 0), (None, None, 0), (None, "", 0), (None, "clean line\nother words here\nmore of them", 0)]
    want += [(3, two, 1), (3, "first\nsecond words\nthird", 0), (3, None, 0), (4, f"{three}\nq r s\nfourth line", 0), (5, "last line", 2)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r.n_lines_removed) for r in got.collect()), key=key) == sorted(want, key=key)
    # a line that several rows without an id have stays in one of them, and goes in those with an id
    got = linededup.dedup_lines(docs_of(spark, [(None, f"{one}\nx y"), (None, f"v w\n{one}"), (-7, f"{one}\nz")])).collect()
    assert sum(one in r.text for r in got if r.doc_id is None) == 1 and {r.text for r in got if r.doc_id == -7} == {"z"}
