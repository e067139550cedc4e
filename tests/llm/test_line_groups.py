"""Line dedup: tokens of small and of large groups of lines, and how often lines are cut into words."""

import random

import pytest

from foliospark.llm import linededup

from . import brute


def made(seed=3):
    """Texts of lines that are edited copies of a few, copies with the later text first, and lines of common words alone."""
    r = random.Random(seed)
    base = [[f"b{i}w{k}" for k in range(r.choice([4, 5, 9, 12, 30, 90]))] for i in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(r.randrange(1, 8)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(["the", "of", f"x{r.randrange(400)}"])
            r.shuffle(w)
            lines.append(" ".join(w))
        lines.append(" ".join(r.sample(["the", "of", "and", "to", "in", "a", "is"], r.randrange(1, 7))))
        rows.append((r.choice([1, -1]) * (d + 1), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("group, heavy", [(linededup.HEAVY, linededup.HEAVY), (5, linededup.HEAVY), (2, 16)])
def test_groups_of_every_size(spark, monkeypatch, group, heavy):
    monkeypatch.setattr(linededup, "GROUP", group, raising=False)
    monkeypatch.setattr(linededup, "HEAVY", heavy)
    rows = made()
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == brute.line_dedup(sorted(rows))


def test_small_groups_are_shuffled_once_and_words_are_made_once(spark, monkeypatch):
    words, tables = [], []
    cut, saved = linededup._words, linededup.saved
    monkeypatch.setattr(linededup, "_words", lambda line: words.append(1) or cut(line))
    monkeypatch.setattr(linededup, "saved", lambda df, name, *a, **b: tables.append(name) or saved(df, name, *a, **b))
    rows = made()
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == brute.line_dedup(sorted(rows))
    # each text is cut into words once, and no token of a small group goes through the tables of large ones
    assert len(words) == 1
    assert not {"live", "rest", "ordered"} & set(tables)
