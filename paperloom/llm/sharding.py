"""Sharding by best-fit-decreasing bin packing.

Groups (documents with equal texts) are indivisible.  Best-fit-decreasing only looks at sizes, so the
driver packs the histogram of group sizes, which has one row per *distinct* size (d distinct sizes need at
least d * d / 2 bytes of input), and a run of equal sizes is placed bin by bin.  The bins' remaining
capacities stand in a balanced tree.  Which group of a size goes where is then decided on the executors by
the group's rank within its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, numbered, utf8_bytes


class CapacityTree:
    """A balanced (treap) search tree of (remaining, bin); priorities come from the bin's number."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _join(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], CapacityTree._join(a[3], b))
        return (b[0], b[1], CapacityTree._join(a, b[2]), b[3])

    @staticmethod
    def _split(t, key):
        """Nodes under ``key``, and the others."""
        if t is None:
            return None, None
        if t[0] < key:
            low, high = CapacityTree._split(t[3], key)
            return (t[0], t[1], t[2], low), high
        low, high = CapacityTree._split(t[2], key)
        return low, (t[0], t[1], high, t[3])

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        node = (key, (key[1] * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFF, None, None)
        self.root = self._join(self._join(low, node), high)

    def remove(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        _, high = self._split(high, (key[0], key[1] + 1))
        self.root = self._join(low, high)

    def tightest(self, size: int):
        """The least (remaining, bin) that holds ``size``, or None."""
        t, best = self.root, None
        while t is not None:
            if t[0][0] >= size:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """``runs``: (size, count) by falling size.  Returns for each run its (bin, count) pieces in order;
    None if more than ``most`` bins would be needed or a size exceeds the capacity."""
    tree, bins, placed = CapacityTree(), 0, []
    for size, count in runs:
        pieces = []
        while count:
            spot = tree.tightest(size)
            if spot is None:
                if size > capacity or (most is not None and bins >= most):
                    return None
                spot = (capacity, bins)
                bins += 1
            else:
                tree.remove(spot)
            # After taking one, this bin is the tightest still, as long as another of that size fits.
            n = min(count, spot[0] // size) if size else count
            tree.insert((spot[0] - n * size, spot[1]))
            pieces.append((spot[1], n))
            count -= n
        placed.append(pieces)
    return placed


def plan_shards(runs: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Places all runs into ``shards`` bins of near equal load.

    A group of at least the mean load of what is left gets a bin of its own; the others are packed
    best-fit-decreasing at the least capacity (by doubling, then halving, the slack) that needs no more
    than the bins left.
    """
    alone, rest, used = [], list(runs), 0
    total = sum(s * n for s, n in rest)
    while rest and used < shards - 1 and rest[0][0] * (shards - used) >= total and rest[0][0]:
        size, n = rest[0]
        alone.append((size, used))
        used, total = used + 1, total - size
        rest = ([(size, n - 1)] if n > 1 else []) + rest[1:]
    bins = shards - used
    floor, high = max(-(-total // bins), rest[0][0] if rest else 0), 1
    low, best = -1, best_fit_decreasing(rest, floor, bins)
    if best is None:
        while (best := best_fit_decreasing(rest, floor + high, bins)) is None:
            low, high = high, high * 4
        low = max(low, 0)
        for _ in range(10):
            if high - low <= max(1, floor >> 16):
                break
            mid = (low + high) // 2
            tried = best_fit_decreasing(rest, floor + mid, bins)
            low, high, best = (mid, high, best) if tried is None else (low, mid, tried)
    placed = {size: [(b + used, n) for b, n in pieces] for (size, _), pieces in zip(rest, best, strict=True)}
    for size, b in reversed(alone):
        placed[size] = [(b, 1), *placed.get(size, [])]
    return [placed[size] for size, _ in runs]


PLAN = T.StructType([T.StructField("group_size", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("bins", T.ArrayType(T.IntegerType()))])


def shard_documents(docs: DataFrame, shards: int = 24, parts: int = 64) -> DataFrame:
    """documents -> doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size.

    Sizes are UTF-8 bytes plus 8.  Documents with equal texts share a shard; null counts as the empty
    text.  ``slot`` numbers a shard's rows from 0 without gaps, in an order fixed by ids and texts (rows
    equal in both are alike).  A very long text is one item like others; if it outweighs a shard's mean load, it
    is one by itself.  An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (utf8_bytes(F.col("text")) + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    base = materialize(base, "shard-base")
    groups = materialize(base.groupBy("digest").agg(F.sum("size").cast("long").alias("group_size")), "shard-groups")
    runs = [(r[0], r[1]) for r in groups.groupBy("group_size").count().orderBy(F.desc("group_size")).collect()]
    rows = []
    for (size, _), pieces in zip(runs, plan_shards(runs, shards), strict=True):
        ends, at = [], 0
        for _, n in pieces:
            at += n
            ends.append(at)
        rows.append((size, ends, [b for b, _ in pieces]))
    plan = materialize(docs.sparkSession.createDataFrame(rows, PLAN), "shard-plan")
    ranked = numbered(groups, "group_size", "rank", F.xxhash64("digest"), parts, [F.col("digest")])
    spot = F.element_at("bins", F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1)
    placed = materialize(ranked.join(plan, "group_size").select("digest", "group_size", spot.alias("shard")), "shard-placed")
    located = base.join(placed, "digest")
    out = numbered(located, "shard", "slot", F.xxhash64("doc_id", "digest"), parts * 8, [F.col("doc_id"), F.col("digest")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_size")
