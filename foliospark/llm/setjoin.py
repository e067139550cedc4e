"""The common part of the exact set-similarity joins: from prefix tokens to candidate pairs to verified pairs.

Each set has a number, `key`, and a row for each token of its prefix: (token, key, at), where `at` holds the set's
size and the token's place in the global order, rare tokens first. Two sets of Jaccard t or more share a token of
their prefixes. Texts themselves are only joined to the pairs that are left.

Candidates come in two steps, so that a group of M similar sets costs about M pairs and not M * M:
1. every set is paired with one set (`hub`) of each of its tokens, the first or the most central one;
2. sets that step 1 didn't settle are paired with all others of their tokens.
A pair goes on to verification if its sizes allow the similarity (length filter), if from its first common token
on enough tokens are left (positional filter), if it shares as many tokens of its prefixes as their lengths ask for (the
matches of adaptive prefixes), and if those together with all later ones are enough.

All of it is DataFrame code. The sets of a token are brought together once; tokens flagged `heavy` (common in the
corpus) are dealt to several parts, whose sums are joined back, where Spark can split them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import saved


def overlap_needed(n: Column, m: Column, num: int, den: int) -> Column:
    """Least intersection for Jaccard num/den: ceil(t / (1 + t) * (n + m))."""
    return F.ceil((num * (n + m)).cast("double") / (num + den) - 1e-9)


def prefix_size(n: Column, num: int, den: int) -> Column:
    return n - F.ceil((num * n).cast("double") / den - 1e-9).cast("int") + 1


def at(n: Column, pos: Column) -> Column:
    return F.shiftleft(n.cast("bigint"), 32).bitwiseOR(pos.cast("bigint"))


def size_of(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


def left_of(x: Column) -> Column:
    """How many tokens there are from this place on."""
    return size_of(x) - x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def live_entries(entries: DataFrame, *, central: bool = False) -> DataFrame:
    """Entries whose token more than one set has, once for each token and set, with the token's hub and count.

    The hub is the token's first set or, with `central`, the set in which the token stands earliest for its size: of
    a text and its edited copies that is the text, as each copy has rarer tokens of its own before. Entries are made
    once; those of heavy tokens are dealt to SALTS parts, whose results are put together afterwards.
    """
    place = [F.floor((size_of(F.col("at")) - left_of(F.col("at"))) * 1024 / size_of(F.col("at"))).cast("int").alias("r"), F.xxhash64("key").alias("s")] if central else []
    best = F.struct(*place, F.col("key").alias("key"), F.col("at").alias("at"))
    salt = F.when(F.col("heavy"), 1 + F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0).cast("smallint")
    # dealt out first, so that what the window compares is made after the shuffle
    e = entries.select("token", "key", "at", salt.alias("_salt")).repartition("token", "_salt")
    w = W.partitionBy("token", "_salt")
    e = e.withColumn("_b", best).withColumns({"_a": F.min("key").over(w), "_z": F.max("key").over(w), "_best": F.min("_b").over(w), "c": F.count(F.lit(1)).over(w)}).where("_salt > 0 or _a <> _z")
    e = saved(e.groupBy("token", "_salt", "key").agg(*(F.min(c).alias(c) for c in ("at", "_a", "_z", "_best", "c"))), "live")
    named = lambda d: d.select("token", "key", "at", F.col("_best.key").alias("hub"), F.col("_best.at").alias("hub_at"), "c")
    heavy = e.where("_salt > 0")
    parts = heavy.groupBy("token", "_salt").agg(*(F.min(c).alias(c) for c in ("_a", "_z", "_best", "c")))
    top = parts.groupBy("token").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.min("_best").alias("_best"), F.sum("c").alias("c")).where("_a <> _z")
    return named(e.where("_salt = 0")).unionByName(named(heavy.select("token", "key", "at").join(top, "token")))


def _kept(pairs: DataFrame, lengths: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that may be similar. pairs: x, y, n, m (sizes), left (what is left from the first common token on) and
    k, with the common tokens of both prefixes that are i tokens longer than the base at place i. Both must share as many
    tokens of prefixes as long as the less lengthened of the two asks for; and those with all later ones must be enough."""
    pairs = pairs.join(lengths.select(F.col("key").alias("x"), F.col("l").alias("x_l")), "x", "left").join(lengths.select(F.col("key").alias("y"), F.col("l").alias("y_l")), "y", "left")
    n, m, l = F.col("n"), F.col("m"), F.least(F.coalesce("x_l", F.lit(1)), F.coalesce("y_l", F.lit(1)))  # noqa: E741
    need, k = overlap_needed(n, m, num, den), F.get("k", l - 1)
    after = F.greatest(n - prefix_size(n, num, den), m - prefix_size(m, num, den)) - (l - 1)
    return pairs.where((den * F.least(n, m) >= num * F.greatest(n, m)) & (F.col("left") >= need) & (k >= l) & (k + F.greatest(after, F.lit(0)) >= need)).select("x", "y")


def place_of(x: Column) -> Column:
    return size_of(x) - left_of(x)


def _beyond(x: Column, num: int, den: int) -> Column:
    """How many places a token stands after the end of its set's base prefix; 0 within it."""
    return F.greatest(place_of(x) - prefix_size(size_of(x), num, den) + 1, F.lit(0))


def hub_pairs(live: DataFrame, num: int, den: int, lengths: DataFrame, most: int = 4) -> DataFrame:
    """(x, y): each set and the hubs of its tokens. What a hub's other tokens would add isn't known here; step 2 is exact.
    lengths: (key, l) of sets with lengthened prefixes."""
    at, hub_at = F.col("at"), F.col("hub_at")
    beyond = F.greatest(_beyond(at, num, den), _beyond(hub_at, num, den))
    rows = live.where("key <> hub").select(F.col("key").alias("x"), F.col("hub").alias("y"), size_of(at).alias("n"), size_of(hub_at).alias("m"), F.least(left_of(at), left_of(hub_at)).alias("left"), beyond.alias("beyond"))
    found = rows.groupBy("x", "y").agg(F.min("n").alias("n"), F.min("m").alias("m"), F.max("left").alias("left"), *(F.sum((F.col("beyond") <= i).cast("int")).alias(f"k{i}") for i in range(most)))
    return _kept(found.withColumn("k", F.array(*(f"k{i}" for i in range(most)))), lengths, num, den)


def _mixed(d: DataFrame) -> DataFrame:
    """Rows of tokens whose sets aren't all of one `own`."""
    w = W.partitionBy("token")
    few = d.where(F.col("c") <= MANY).withColumns({"_a": F.min("own").over(w), "_z": F.max("own").over(w)}).where("_a <> _z").drop("_a", "_z")
    many = d.where(F.col("c") > MANY)
    some = many.groupBy("token").agg(F.min("own").alias("_a"), F.max("own").alias("_z")).where("_a <> _z").select("token")
    return few.unionByName(many.join(some, "token", "left_semi"))


def _matching(seeds: DataFrame, live: DataFrame, num: int, den: int, lengths: DataFrame, most: int = 4) -> DataFrame:
    """The seeds (x, y, n, m, left) that have enough common prefix tokens; these are counted for seeds alone."""
    seeds = saved(seeds, "seeds")
    test = bitmap(keys_of(seeds), "key")
    if test is None:
        return seeds.select("x", "y")
    kinds = [F.collect_list(F.when(F.col("beyond") <= i, F.col("token"))).alias(f"p{i}") for i in range(most)]
    prefix = saved(live.where(test).withColumn("beyond", _beyond(F.col("at"), num, den)).groupBy("key").agg(*kinds), "prefixes")
    side = lambda c: prefix.select(F.col("key").alias(c), *(F.col(f"p{i}").alias(f"{c}_p{i}") for i in range(most)))
    both = seeds.join(side("x"), "x").join(side("y"), "y")
    k = F.array(*(F.size(F.array_intersect(f"x_p{i}", f"y_p{i}")) for i in range(most)))
    return _kept(both.select("x", "y", "n", "m", "left", k.alias("k")), lengths, num, den)


def rest_pairs(live: DataFrame, group: DataFrame, num: int, den: int, lengths: DataFrame) -> DataFrame:
    """(x, y) for sets that still need partners. group: (key, g); sets of one g need no pair.

    A pair is found by those of the common tokens of its base prefixes alone that the positional filter lets through
    (similar sets have one), so that the edited copies of a text don't all meet in the join.
    """
    base = live.where(_beyond(F.col("at"), num, den) == 0)
    d = base.select("token", "key", "at", "c").join(group, "key", "left").select("token", "key", "at", "c", F.coalesce("g", "key").alias("own"))
    d = saved(_mixed(d.withColumn("before", F.lag("token").over(W.partitionBy("key").orderBy("token")))), "mixed")
    # a token of many sets is split by bands of size: partners are in the same band or the next
    size_band = F.floor(F.log(size_of(F.col("at")).cast("double")) / F.log(F.lit(den / num))).cast("int")
    d = d.withColumn("band", F.when(F.col("c") > MANY, size_band).otherwise(0))
    x = d.select("token", F.col("key").alias("x"), F.col("at").alias("x_at"), "own", F.col("before").alias("x_before"), F.explode(F.when(F.col("c") > MANY, F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(0)))).alias("band"))
    y = d.select("token", F.col("key").alias("y"), F.col("at").alias("y_at"), F.col("own").alias("y_own"), F.col("before").alias("y_before"), "band")
    n, m = size_of(F.col("x_at")), size_of(F.col("y_at"))
    left = F.least(left_of(F.col("x_at")), left_of(F.col("y_at")))
    fits = (F.col("own") != F.col("y_own")) & (F.col("y") < F.col("x")) & (den * F.least(n, m) >= num * F.greatest(n, m))
    # where both sets have the same token before this one, that one brings the pair
    new = ~F.coalesce(F.col("x_before") == F.col("y_before"), F.lit(False))
    met = x.join(y, ["token", "band"]).where(fits & new & (left >= overlap_needed(n, m, num, den)))
    return _matching(met.groupBy("x", "y").agg(F.min(n).alias("n"), F.min(m).alias("m"), F.max(left).alias("left")), live, num, den, lengths)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, y, x_text, y_text); texts: (key, text)."""
    return pairs.join(texts.select(F.col("key").alias("x"), F.col("text").alias("x_text")), "x").join(texts.select(F.col("key").alias("y"), F.col("text").alias("y_text")), "y")


def keys_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct()


MOST_BITS = 1 << 20
MANY = 1000
SALTS = 64


def long_literal(values: list[int]) -> Column:
    """An array constant; for tables of a bounded size."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def bitmap(keys: DataFrame, *columns: str) -> Column | None:
    """A test of the like-named columns that is true for all of `keys` and few others; None where there are no keys.

    It has eight bits or more a key, MOST_BITS at most (an eighth of a MB); beyond some million keys the test saves less and less.
    """
    n = keys.count()
    if not n:
        return None
    bits = min(MOST_BITS, 1 << max(10, (8 * n).bit_length()))
    bit = F.pmod(F.xxhash64(*columns), F.lit(bits)).cast("int")
    words = keys.select(bit.alias("b")).distinct().selectExpr("cast(b div 64 as int) w", "shiftleft(1L, b % 64) v").groupBy("w").agg(F.bit_or("v").alias("v")).collect()
    found = {r[0]: r[1] for r in words}
    table = long_literal([found.get(i, 0) for i in range(bits // 64)])
    return F.getbit(F.get(table, F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1
