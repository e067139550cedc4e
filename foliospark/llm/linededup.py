"""Line deduplication as an exact set-similarity join, in DataFrame operations alone.

A line's tokens are its distinct words (by 64-bit hash). The steps:

1. lines: the sorted tokens of every line with a word, found once; equal sets are one class (128-bit name).
2. rarity: words are counted over all lines in cells by hash; the number of cells follows the input up to MOST_CELLS.
   Any order gives the same matches, rarer words first gives fewer candidates.
3. heads: of each class the first line alone goes on, with its prefix in the order of rarity. All other lines of a
   class are later matches of it.
4. candidates: heads that share a prefix token, if their sizes allow the similarity (length filter), if from the common
   token on enough tokens are left (positional filter) and if parity sketches (64 bits, 128 for long lines) of the two sets differ in no more
   places than the sets may (a bound, so nothing is lost). Tokens of GROUP heads at most are joined with themselves.
   For tokens of more heads these are numbered in the order of (id, line number), and every head is first held against
   the first head of each of its tokens; lines that this settles need no other partner, so that a group of M alike lines
   costs about M pairs.
5. verification of the Jaccard similarity by the tokens of both lines; the later line goes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .setjoin import bitmap, long_literal
from .shared import forget, release, saved

NUM, DEN = 4, 5
#: A line has at least so many tokens if another, unequal one can match it.
LEAST = DEN - 1
MOST_CELLS, LEVEL_BITS = 1 << 19, 4
TURN = 1 << (LEVEL_BITS - 1)
#: Tokens that this many lines have are dealt to SALTS parts.
HEAVY, SALTS = 1 << 16, 64
#: Tokens of more heads have their heads held against the first one before any two others meet.
GROUP = 1 << 9
#: The shuffle of one part of the other tokens alone is on disk; each part reads all heads, so that their number is fixed.
PARTS = 4
#: Prefix tokens of large groups are worked off in parts of about so many entries, in LEAST_PARTS at least.
PART_ENTRIES, LEAST_PARTS = 4 << 20, 2
#: Lines of more tokens have a sketch of one half of their tokens as well, which makes it two of 64 bits.
WIDE = 64
_RARE_GAP = "[\\t\\x0B\\x0C\\r]"


def _words(line: Column) -> Column:
    """Sorted hashes of the distinct words [^\\x20\\x09-\\x0D]+ of a line."""
    # most lines have blanks alone, and to split at one character takes no regular expression
    parts = F.when(line.rlike(_RARE_GAP), F.split(F.regexp_replace(line, _RARE_GAP, " "), " ")).otherwise(F.split(line, " "))
    hashes = F.transform(parts, lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit("")))))


def _lines(texts: DataFrame) -> DataFrame:
    """(id, name, no, line) of each line with a word; texts: (id, name, text)."""
    line = texts.where("text is not null").select("id", "name", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return line.where(F.col("line").rlike("[^ \\t\\x0B\\x0C\\r\\n]"))


def _levels(lines: DataFrame) -> tuple[Column, int, int, int]:
    """Packed frequency levels of all cells, the bits that name one of its numbers, and the levels from which tokens are heavy or may have
    large groups. A cell is named by a token's highest bits, which say where in the table its number is, and by four lower ones, its place there.
    Level 0: only one line has a word of this cell."""
    total = lines.agg(F.sum("n")).first()[0] or 0
    each = 64 // LEVEL_BITS
    bits = min(MOST_CELLS.bit_length() - 1, max(12, (total // 16).bit_length())) - (each - 1).bit_length()
    cells = lines.select(F.explode("tokens").alias("token"))
    cell = F.shiftleft(F.shiftrightunsigned("token", 64 - bits), 4).bitwiseOR(F.shiftrightunsigned("token", 2).bitwiseAND(F.lit(15)))
    cells = cells.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    cells = saved(cells, "cells")
    top = math.log2(max(2, cells.agg(F.max("c")).first()[0] or 0))
    most = (1 << LEVEL_BITS) - 1
    level = F.ceil(F.log2("c") * (most / top) - 1e-9).cast("bigint")
    word = F.expr(f"cast(cell div {each} as int)").alias("w")
    # with the highest bit turned round, the order of signed numbers is that of levels
    part = F.call_function("shiftleft", level.bitwiseXOR(F.lit(TURN)), F.pmod("cell", F.lit(each)).cast("int") * LEVEL_BITS)
    table = {r[0]: r[1] for r in cells.select(word, part.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).collect()}  # MOST_CELLS / 16 numbers
    forget(cells)
    return long_literal([table.get(i, 0) for i in range(1 << bits)]), bits, *(math.ceil(math.log2(c) * most / top - 1e-9) for c in (HEAVY, GROUP))


def _by_rarity(tokens: Column, table: Column, bits: int) -> Column:
    """Tokens that start with their level, in order. The operations are as few as can be, as each token takes them all."""

    def one(t: Column) -> Column:
        word = F.get(table, F.shiftrightunsigned(t, 64 - bits).cast("int"))
        level = F.shiftleft(F.call_function("shiftrightunsigned", word, t.bitwiseAND(F.lit(60)).cast("int")), 64 - LEVEL_BITS)
        # never null, which the sort needs to know to work on plain numbers
        return F.coalesce(level.bitwiseOR(F.shiftrightunsigned(t, LEVEL_BITS)), F.lit(0).cast("bigint"))

    return F.sort_array(F.transform(tokens, one))


def _level(token: Column) -> Column:
    return F.shiftright(token, 64 - LEVEL_BITS) + TURN


def _need(n: Column, m: Column) -> Column:
    """Least number of common tokens: ceil(NUM * (n + m) / (NUM + DEN))."""
    return F.floor((NUM * (n + m) + NUM + DEN - 1) / (NUM + DEN))


def _at(n: Column, pos: Column) -> Column:
    """A set's size and a token's place in one number."""
    return F.shiftleft(n.cast("bigint"), 32).bitwiseOR(pos.cast("bigint"))


def _fits(x: str, y: str) -> Column:
    """Length, positional and sketch filter for columns of these prefixes."""
    n, m = (F.shiftright(f"{c}at", 32).cast("int") for c in (x, y))
    left, more = (size - F.col(f"{c}at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int") for size, c in ((n, x), (m, y)))
    need = _need(n, m)
    all_, half = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in ("s1", "s2"))
    differ = F.when(F.least(n, m) > WIDE, F.bit_count(half) + F.bit_count(all_.bitwiseXOR(half))).otherwise(F.bit_count(all_))
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & (F.least(left, more) >= need) & (differ <= n + m - 2 * need)


_SET = ("k", "at", "s1", "s2")


def _parity(tokens: Column) -> Column:
    """A number whose bit i says if the tokens with i in their lowest six bits are odd in number."""
    one = F.lit(1).cast("bigint")
    # a shift takes the lower six bits of its distance
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63)).cast("int"))))


def _heads(lines: DataFrame) -> tuple[DataFrame, int, int]:
    """A row for each class: a number k, its first line, sizes, sketch and prefix; the levels of heavy tokens and of large groups."""
    table, bits, heavy, large = _levels(lines)
    n = F.col("n")
    prefix = F.slice(_by_rarity(F.col("tokens"), table, bits), F.lit(1), F.when(n < LEAST, 0).otherwise(n - F.floor((NUM * n + DEN - 1) / DEN).cast("int") + 1))
    half = F.when(n > WIDE, _parity(F.filter("tokens", lambda t: t.bitwiseAND(F.lit(64)) > 0))).otherwise(0).cast("bigint")
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "name", "no")
    # what follows the place is the same in all rows of a class
    row = F.struct(place.alias("first"), "n", _parity(F.col("tokens")).alias("s1"), half.alias("s2"), prefix.alias("prefix"))
    heads = lines.select("c1", "c2", row.alias("row")).groupBy("c1", "c2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("c"))
    return saved(heads.select(F.monotonically_increasing_id().alias("k"), "c1", "c2", "c", "row.*"), "heads"), heavy, large


def _entries(heads: DataFrame) -> DataFrame:
    """A row for each head and token of its prefix that another line may have as well."""
    e = heads.select("k", "n", "s1", "s2", F.posexplode("prefix").alias("pos", "token")).where(_level(F.col("token")) > 0)
    return e.select("token", "k", _at(F.col("n"), F.col("pos")).alias("at"), "s1", "s2")


def _large(heads: DataFrame, level: int) -> Column | None:
    """A test that is true for all tokens of more than GROUP heads and few others; None where there are none."""
    token = heads.select(F.explode("prefix").alias("token")).where(_level(F.col("token")) >= max(level, 1))
    large = saved(token.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP).select("token"), "large")
    test = bitmap(large, "token")
    forget(large)
    return test


def _met(heads: DataFrame, large: Column | None) -> list[DataFrame]:
    """(x, y): heads that share a token of a small group, part by part."""
    e, parts = _entries(heads), []
    e = e if large is None else e.where(~large)
    for part in range(PARTS):
        d = e.where(F.pmod("token", F.lit(PARTS)) == part)
        # both sides are the same rows, which are shuffled once
        x, y = (d.select("token", *(F.col(c).alias(f"{side}_{c}") for c in _SET)) for side in "xy")
        met = x.join(y, "token").where((F.col("y_k") < F.col("x_k")) & _fits("x_", "y_"))
        parts.append(saved(met.select(F.col("x_k").alias("x"), F.col("y_k").alias("y")).distinct(), "met"))
        release(heads.sparkSession)
    return parts


def _in_order(heads: DataFrame, large: Column) -> DataFrame:
    """The heads of large groups, k in the order of their first lines."""
    own = _entries(heads).where(large).select("k").distinct()
    return saved(heads.join(own, "k", "left_semi").orderBy("first").withColumn("k", F.monotonically_increasing_id()), "ordered")


def _live(heads: DataFrame, heavy: int, large: Column) -> list[DataFrame]:
    """A row for each head and prefix token of a large group, its place in the token's group (no place in a
    salted group), whether it is the last there, and `hub`, the group's first head, if the two may match. Several tables
    by token, made one after the other, so that the shuffle of one part alone is on disk; their number follows the entries."""
    entries = heads.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    n_parts = max(LEAST_PARTS, -(-entries // PART_ENTRIES))
    e = _entries(heads).where(large).withColumn("salt", F.when(_level(F.col("token")) >= heavy, 1 + F.pmod(F.xxhash64("k"), F.lit(SALTS))).otherwise(0).cast("int"))
    w = W.partitionBy("token", "salt").orderBy("k")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)  # the frame of row_number, so that one pass does both
    hub = F.when((F.col("place") > 1) & _fits("", "h_"), F.col("h_k"))
    parts = []
    for part in range(n_parts):
        d = e.where(F.pmod("token", F.lit(n_parts)) == part)
        d = d.withColumns({"place": F.row_number().over(w), "last": F.lead("k").over(w).isNull(), **{f"h_{c}": F.first(c).over(so_far) for c in _SET}})
        d = d.where("salt > 0 or place > 1 or not last")
        parts.append(saved(d.select("token", *_SET, F.when(F.col("salt") > 0, None).otherwise(F.col("place")).alias("place"), "last", hub.alias("hub")), "live"))
        release(heads.sparkSession)
    return parts


def _rest(live: DataFrame, settled: DataFrame, done: Column | None) -> DataFrame:
    """(x, y): heads that aren't settled and the earlier heads of their tokens, without the pairs with the first one.
    done: a test that is true for all of `settled`. Both sides of the join are the same rows, which are shuffled once;
    a number says what a row may be: 1 the later head, 2 the earlier one, 3 both."""
    later, earlier = F.expr("place is null or place > 2"), F.expr("place is null or (place > 1 and not last)")
    may = later.cast("int").bitwiseOR(F.shiftleft(earlier.cast("int"), 1))
    row = ("token", *_SET)
    if done is None:
        rows = live.select(*row, may.alias("may"))
    else:
        marked = live.where(done).join(settled.select("k", F.lit(True).alias("settled")), "k", "left")
        rows = live.where(~done).select(*row, may.alias("may")).unionByName(marked.select(*row, F.when(F.col("settled"), may.bitwiseAND(F.lit(2))).otherwise(may).alias("may")))
    rows = rows.where("may > 0")
    x, y = (rows.select("token", *(F.col(c).alias(f"{side}_{c}") for c in (*_SET, "may"))) for side in "xy")
    # one number of both sides, so that no side is filtered by itself and the two stay alike
    able = F.col("x_may").bitwiseAND(F.shiftright("y_may", 1)).bitwiseAND(F.lit(1)) == 1
    return x.join(y, "token").where(able & (F.col("y_k") < F.col("x_k")) & _fits("x_", "y_")).select(F.col("x_k").alias("x"), F.col("y_k").alias("y")).distinct()


def _rest_of(parts: list[DataFrame], settled: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs of all parts, and the tables that they are in."""
    done, pairs = bitmap(settled, "k"), []
    for part in parts:
        pairs.append(saved(_rest(part, settled, done), "rest"))
        forget(part)
        release(part.sparkSession)
    return reduce(DataFrame.unionByName, pairs).distinct(), pairs


def _verified(lines: DataFrame, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, first) of the later head of each pair that is similar enough."""
    pairs = saved(pairs, "pairs")
    keys = pairs.select(F.explode(F.array("x", "y")).alias("k")).distinct()
    firsts = saved(heads.join(keys, "k").select("k", "first", "first.id", "first.name", "first.no"), "candidates")
    test = bitmap(firsts, "id", "name", "no")
    if test is None:
        return pairs.select(F.col("x").alias("k"), F.lit(None).cast(heads.schema["first"].dataType).alias("first"))
    own = lines.where(test).select(F.col("id").alias("i"), F.col("name").alias("_name"), F.col("no").alias("_no"), "tokens")
    found = own.join(firsts, F.col("id").eqNullSafe(F.col("i")) & (F.col("_name") == F.col("name")) & (F.col("_no") == F.col("no")))
    sets = saved(found.select("k", "first", "tokens").dropDuplicates(["k"]), "sets")
    x, y = (sets.select(F.col("k").alias(c), F.struct("first", "k").alias(f"{c}_head"), F.col("tokens").alias(f"{c}_tokens")) for c in "xy")
    both = pairs.join(x, "x").join(y, "y").select("x_head", "y_head", F.size("x_tokens").alias("n"), F.size("y_tokens").alias("m"), F.size(F.array_intersect("x_tokens", "y_tokens")).alias("o"))
    later = both.where(DEN * F.col("o") >= NUM * (F.col("n") + F.col("m") - F.col("o"))).select(F.greatest("x_head", "y_head").alias("head"))
    out = saved(later.select("head.k", "head.first").dropDuplicates(["k"]), "settled")
    forget(pairs, firsts, sets)
    release(lines.sparkSession)
    return out


def _of_large_groups(lines: DataFrame, heads: DataFrame, heavy: int, large: Column) -> DataFrame:
    """(k, first) of the later head of each similar pair that shares a token of a large group; k are numbers of their own."""
    heads = _in_order(heads, large)
    live = _live(heads, heavy, large)
    one = _verified(lines, heads, reduce(DataFrame.unionByName, live).where("hub is not null").select(F.col("k").alias("x"), F.col("hub").alias("y")).distinct())
    pairs, tables = _rest_of(live, one)
    two = _verified(lines, heads, pairs)
    forget(*tables, heads)
    release(lines.sparkSession)
    return one.unionByName(two)


def removed_lines(texts: DataFrame) -> DataFrame:
    """(id, name, no) of every line that has an earlier match; texts: (id, name, text), name a hash of the text."""
    spark = texts.sparkSession
    tokens = _lines(texts).select("id", "name", "no", _words(F.col("line")).alias("tokens"))
    tokens = tokens.select("id", "name", "no", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("c1"), F.xxhash64(F.lit(1), "tokens").alias("c2"), "tokens")
    # a few words make most of a text: a dictionary takes a quarter of the place, and a slower compression little less
    lines = saved(tokens, "lines", compression="lz4_raw", **{"parquet.dictionary.page.size": str(64 << 20)})
    heads, heavy, level = _heads(lines)
    release(spark)
    large = _large(heads, level)
    met = _met(heads, large)
    later = _verified(lines, heads, reduce(DataFrame.unionByName, met).distinct()).select("first")
    forget(*met)
    if large is not None:
        later = later.unionByName(_of_large_groups(lines, heads, heavy, large).select("first"))
    later = later.select("first.id", "first.name", "first.no")
    own = F.struct("id", "name", "no")
    copied = heads.where("c > 1").select("c1", "c2", F.struct("first.id", "first.name", "first.no").alias("head"))
    copies = lines.select("id", "name", "no", "c1", "c2").join(copied, ["c1", "c2"]).where(~own.eqNullSafe(F.col("head")))
    gone = saved(copies.select("id", "name", "no").unionByName(later), "gone")
    forget(lines, heads)
    return gone


def _blocks(gone: DataFrame) -> DataFrame:
    """(i, n, gone): bits of the removed lines of each text, 64 lines to a number."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("no", F.lit(64)).cast("int"))
    rows = gone.groupBy("id", "name", F.expr("no div 64").alias("b")).agg(F.bit_or(bit).alias("v"))
    rows = rows.groupBy("id", "name").agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("found"))  # one text's
    gap = lambda s, i: s["b"] - F.when(i > 0, F.get("found", i - 1)["b"]).otherwise(-1) - 1
    dense = F.flatten(F.transform("found", lambda s, i: F.concat(F.array_repeat(F.lit(0).cast("bigint"), gap(s, i).cast("int")), F.array(s["v"]))))
    return rows.select(F.col("id").alias("i"), F.col("name").alias("n"), dense.alias("gone"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_as: str = "n_lines_removed") -> DataFrame:
    """The rows of `docs` with all their columns, without the lines that match an earlier line, and n_lines_removed.

    Two lines match where the Jaccard similarity of their sets of words is 0.8 or more. Lines without a word stay. A
    null text stays null, an empty one empty. Ids are of any type with an order; a null id comes first of all. Rows of
    one id (or none) with different texts are documents of their own, in the order of a hash of their texts; rows with
    the same id and text are treated alike. A text may have any number of lines. Where `docs` has a column called
    n_lines_removed (or `count_as`), that one stays, and the new one gets underscores at its end. An empty table gives no rows.
    """
    taken = {c.lower() for c in docs.columns}
    while count_as.lower() in taken:
        count_as += "_"
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    d = d.withColumn("name", F.xxhash64("text"))
    gone = removed_lines(d.select("id", "name", "text"))
    blocks = saved(_blocks(gone), "blocks")
    forget(gone)
    release(docs.sparkSession)
    out = lambda rows, text, n: rows.select(*((text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns), n.cast("int").alias(count_as))
    test = bitmap(blocks.select(F.col("i").alias("id"), F.col("n").alias("name")), "id", "name")
    if test is None:
        return out(d, F.col("text"), F.lit(0))
    same = out(d.where(~test), F.col("text"), F.lit(0))
    hit = d.where(test).join(blocks, F.col("id").eqNullSafe(F.col("i")) & (F.col("name") == F.col("n")), "left")
    is_gone = lambda x, i: F.coalesce(F.call_function("shiftrightunsigned", F.get("gone", F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")), F.lit(0).cast("bigint")) == 1
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~is_gone(x, i)), "\n"))
    n = F.coalesce(F.aggregate("gone", F.lit(0), lambda a, v: a + F.bit_count(v)), F.lit(0))
    return same.unionByName(out(hit, text, n))
