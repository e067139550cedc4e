"""URL filters: a weighted vocabulary searched by Aho-Corasick, and host and path rules that come first."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One of these is enough.
STRICT = ("casino", "porn", "porno", "xxx", "viagra", "cialis", "escort", "escorts", "hentai", "sportsbook", "payday-loan", "torrent", "warez")
#: Two different ones are needed.
SOFT = ("adult", "bet", "bets", "bonus", "cheap", "click", "coupon", "crack", "discount", "free", "jackpot", "keygen", "loan", "lottery", "nude", "pharmacy", "pill", "pills", "poker", "replica", "sale", "sex", "slots", "win", "winner")
SOFT_HITS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)
_INSIDE = frozenset(LOWER + "0123456789")


def automaton(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for t in terms:
            out.add_word(t.translate(_LOWER), (weight, t.translate(_LOWER)))
    out.make_automaton()
    return out


def hits(found: ahocorasick.Automaton, url: str) -> tuple[set, set]:
    """Distinct strict and soft terms with no letter or digit (a-z, 0-9) on either side."""
    strict, soft = set(), set()
    for last, (weight, term) in found.iter(url):
        begin = last - len(term)
        if (begin < 0 or url[begin] not in _INSIDE) and (last + 1 == len(url) or url[last + 1] not in _INSIDE):
            (strict if weight == 2 else soft).add(term)
    return strict, soft


def rule_of(host: str, path: str, rules: dict) -> tuple[str, str] | None:
    """The longest rule (host plus path prefix) that fits the host or a domain above it."""
    best, at = None, 0
    while True:
        for prefix, verdict in rules.get(host[at:], ()):
            if path.startswith(prefix) and (best is None or at and len(host) - at + len(prefix) > len(best[0]) or not at and len(host) + len(prefix) > len(best[0])):
                best = (host[at:] + prefix, verdict)
        at = host.find(".", at) + 1
        if not at:
            return best


def _judge(rules: dict, strict: tuple, soft: tuple, needed: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft) if strict or soft else None
        for batch in batches:
            out: list[tuple] = []
            for url, host, path in zip(batch.column("_url").to_pylist(), batch.column("_host").to_pylist(), batch.column("_path").to_pylist()):
                a, b = hits(found, (url or "").translate(_LOWER)) if found and url else (set(), set())
                by_terms = "block" if a or len(b) >= needed else "allow"
                rule = rule_of(host, path, rules) if host else None
                out.append((rule and rule[0], rule[1] if rule else by_terms, sorted(a), sorted(b)))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "_host", "_path")), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.list_(pa.string()))], names=[*keep, "host", "path", "rule", "verdict", "strict_terms", "soft_terms"])

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = (), *, id_col: str = "page_id", url_col: str = "url", strict: tuple = STRICT, soft: tuple = SOFT, soft_hits: int = SOFT_HITS, keep: list[str] | None = None) -> DataFrame:
    """A verdict for each row: the id (and `keep`), host, path, rule, verdict, strict_terms, soft_terms.

    `rules`: (verdict, "host/path") pairs; the longest that fits decides. Without one, a strict term or
    `soft_hits` different soft terms anywhere in the url mean block. A null url or one without :// has an
    empty host and path, which no rule fits. Repeated rows stay repeated.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in rules:
        host, _, path = rule.partition("/")
        by_host.setdefault(host.translate(_LOWER), []).append((f"/{path}", verdict))
    names = [id_col, *(keep or [])]
    inner = [f"_k{i}" for i in range(len(names))]
    u = F.col(f"`{url_col}`").cast("string")
    d = pages.select(
        *(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)),
        u.alias("_url"),
        F.translate(F.coalesce(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER).alias("_host"),
        F.coalesce(F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")).alias("_path"),
    )
    kinds = ", ".join(f"{i} {d.schema[i].dataType.simpleString()}" for i in inner)
    out = d.mapInArrow(_judge(by_host, tuple(strict), tuple(soft), soft_hits, inner), f"{kinds}, host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>")
    return out.withColumnsRenamed(dict(zip(inner, names)))
