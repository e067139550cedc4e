"""Sharding by longest-processing-time scheduling: groups that stay together, largest first, each to the
least-loaded shard through a heap.

The driver sees a histogram, not the groups: sizes are put into classes of a 1024th of their power of two, at
most about 55,000 of them for any input. Groups of a class are as good as equal, so the heap takes a whole
class at once: as many each as the least-loaded rule would give, the last few one by one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import salted_rank

SHARDS = 16


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """classes: (class, groups, bytes of all). Returns (class, lo, hi, shard): the groups of rank lo to hi - 1 go to the shard."""
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for c, k, total in sorted(classes, reverse=True):
        each = total / k
        take = [0] * shards
        if k > 2 * shards:
            # the largest water level under which at most k groups are placed
            load = dict((s, x) for x, s in heap)
            lo, hi = 0.0, max(load.values()) + total
            fit = lambda level: [max(0, int((level - load[s]) // each)) for s in range(shards)]
            for _ in range(200):
                mid = (lo + hi) / 2
                if sum(fit(mid)) <= k:
                    lo = mid
                else:
                    hi = mid
            take = fit(lo)
            heap = [(load[s] + take[s] * each, s) for s in range(shards)]
            heapq.heapify(heap)
        for _ in range(k - sum(take)):
            x, s = heapq.heappop(heap)
            take[s] += 1
            heapq.heappush(heap, (x + each, s))
        at = 0
        for s, n in enumerate(take):
            if n:
                out.append((c, at, at + n, s))
                at += n
    return out


def shard_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """A row for each row of `docs`: the id, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot.

    Rows with equal texts are in one shard; null texts are one group (size 1, crc32 of nothing). Slots are
    gapless from 0 in each shard. Repeated rows get slots of their own. An empty table gives no rows.
    """
    text = F.col(f"`{text_col}`").cast("string")
    d = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("_group"),
    )
    groups = d.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    cut = F.greatest(F.lit(0), F.length(F.bin("_bytes")) - 11)
    groups = groups.withColumn("_class", F.col("_bytes") - F.pmod("_bytes", F.pow(F.lit(2.0), cut).cast("long")))
    counts = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b")).collect()  # bounded by the classes
    plan = docs.sparkSession.createDataFrame(schedule([(r[0], r[1], r[2]) for r in counts], shards), "_class bigint, _lo bigint, _hi bigint, shard int")
    ranked = salted_rank(groups.select("_group", "_class"), ["_class"], ["_group"], "_rank")
    placed = ranked.join(F.broadcast(plan), (ranked["_class"] == plan["_class"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).select("_group", "shard")
    out = salted_rank(d.join(placed, "_group").drop("_group"), ["shard"], ["_id", "text_crc32", "size"], "slot")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")
