"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACE.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminate(docs, items, m=13):
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: alnum.findall((t or "").translate(UP))
    windows = {}
    for name, text in items:
        w = split(text)
        if w:
            k = min(m, len(w))
            for i in range(len(w) - k + 1):
                windows.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[x]
        yield d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)


def quality(text):
    text = text or ""
    w = words(text)
    lines = text.split("\n")
    seen, dups = set(), 0
    for line in lines:
        if words(line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def shingles(text, k=5):
    w = words((text or "").translate(UP))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    done = set()
    for group in where.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in done:
                    done.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    o = len(a & b)
                    if 100 * o >= 75 * (len(a) + len(b) - o):
                        root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)] if s else d) for i, (d, s) in enumerate(sets)]


def line_dedup(docs, num=4, den=5):
    lines = sorted({(d, k, frozenset(words(x))) for d, t in docs if t is not None for k, x in enumerate(t.split("\n")) if words(x)}, key=lambda x: x[:2])
    where, gone = {}, set()
    for i, (d, k, s) in enumerate(lines):
        for j in {j for x in s for j in where.get(x, ())}:
            o = len(s & lines[j][2])
            if den * o >= num * (len(s) + len(lines[j][2]) - o):
                gone.add((d, k))
                break
        for x in s:
            where.setdefault(x, []).append(i)
    return {d: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in docs}


def substring_dedup(docs, m=50):
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - m + 1):
            x = tuple(w[i : i + m])
            first[x] = min(first.get(x, d), d)
    out = []
    for d, t in docs:
        w, gone = words(t), set()
        for i in range(len(w) - m + 1):
            if first[tuple(w[i : i + m])] < d:
                gone.update(range(i, i + m))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out
