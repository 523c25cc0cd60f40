"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash.  Per source, word counts are summed by hash bucket; the budget
falls into one bucket, and only that one is split again by the next hash bits, until it holds a single
hash value.  The result is one threshold per source: documents at or under it are taken once more than the
others.  Nothing is sorted, a larger budget only ever adds documents, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, null_safe, numbered, release, small, word_count

HASH_BITS, LEVEL_BITS = 60, 10
#: Most 24-byte keys of repeated rows that are sent to every task; above that the planner shuffles.
REPEATED_BROADCAST = 1_000_000


def _digest() -> Column:
    """60 bits (as 15 hexadecimal digits) of md5 over id, source and text."""
    part = lambda c: F.coalesce(c, F.lit("null"))
    whole = F.concat_ws("|", part(F.col("doc_id").cast("string")), part(F.md5("source")), part(F.md5("text")))
    return F.substring(F.md5(whole), 1, HASH_BITS // 4)


def with_hash(docs: DataFrame) -> DataFrame:
    """Adds ``__hash``, 60 bits for each row.

    Rows of the same id, source and text are told apart by a number, whichever gets which.  Only those are
    moved for it: they are numbered in parts, dealt by where they stand."""
    docs = docs.withColumn("__digest", _digest())
    repeated = docs.groupBy("__digest").agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1")
    repeated = materialize(repeated, "mix-repeated")
    as_number = lambda digits: F.conv(digits, 16, 10).cast("long")
    if repeated.isEmpty():
        return docs.withColumn("__hash", as_number(F.col("__digest"))).drop("__digest")
    marked = docs.join(small(repeated, REPEATED_BROADCAST), "__digest", "left")
    alone = marked.filter("__rows is null").withColumn("__hash", as_number(F.col("__digest"))).drop("__digest", "__rows")
    again = numbered(marked.filter("__rows is not null"), "__digest", "__number", F.monotonically_increasing_id(), 64, [F.lit(0)])
    other = F.substring(F.md5(F.concat_ws(":", "__digest", F.col("__number").cast("string"))), 1, HASH_BITS // 4)
    again = again.withColumn("__hash", as_number(F.when(F.col("__number") == 0, F.col("__digest")).otherwise(other))).drop("__digest", "__rows", "__number")
    return alone.unionByName(again)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Sources by code point, null last, take the weights in turn and share ``share`` times all words.  No
    target exceeds ``cap`` times its source; what is cut off goes to the others by weight.  One row per
    source is all that meets here.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(cap)
    filled = W.orderBy(F.col("__limit") / F.col("__w"), F.col("source").asc_nulls_last())
    before, rest = filled.rowsBetween(W.unboundedPreceding, -1), filled.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) * F.lit(share) - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / F.sum("__w").over(rest)
    leveled = totals.withColumn("__w", w).withColumn("__limit", limit).withColumn("__level", level)
    found = F.max(F.when(F.col("__level") <= F.col("__limit") / F.col("__w"), F.col("__level"))).over(W.partitionBy())
    return leveled.withColumn("__found", found).select("source", "source_size", F.least("__limit", F.coalesce(F.col("__found") * F.col("__w"), F.col("__limit"))).alias("target"))


def thresholds(base: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, size, hash) and (source, budget) -> (source, threshold): documents whose hash is at most
    the threshold hold about ``budget`` words; null where none is to be taken."""
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("under"), F.lit(0).cast("long").alias("prefix"))
    final = None
    for level in range(HASH_BITS // LEVEL_BITS):
        shift, above = HASH_BITS - (level + 1) * LEVEL_BITS, HASH_BITS - level * LEVEL_BITS
        rows = null_safe(base, state, ["source"])
        if level:
            rows = rows.filter(F.shiftright("hash", above) == F.col("prefix"))
        hist = rows.groupBy("source", "budget", "under", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("lo"), F.max("hash").alias("hi")
        )
        w = W.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("after", F.col("under") + F.sum("words").over(w))
        edge = hist.filter((F.col("after") > F.col("budget")) & (F.col("after") - F.col("words") <= F.col("budget")))
        edge = materialize(edge.select("source", "budget", (F.col("after") - F.col("words")).alias("under"), F.col("bucket").alias("prefix"), "words", "lo", "hi"), "mix-edge")
        done = edge.filter("lo = hi").select(
            "source", F.when(F.col("words") - (F.col("budget") - F.col("under")) < F.col("budget") - F.col("under"), F.col("lo")).otherwise(F.col("lo") - 1).alias("threshold")
        )
        final = done if final is None else final.unionByName(done)
        state = edge.filter("lo < hi").select("source", "budget", "under", "prefix")
        if state.isEmpty():
            break
    # A source without an edge has a budget of all its words.
    return null_safe(budgets.select("source"), final.withColumn("hit", F.lit(True)), ["source"], "left").select(
        "source", F.when(F.col("hit"), F.col("threshold")).otherwise(F.lit(1 << HASH_BITS)).alias("threshold")
    )


def source_plan(base: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, size, hash) -> one row per source: source_size, target, whole copies and threshold."""
    totals = materialize(source_targets(base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share, cap), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    budgets = totals.select("source", (F.col("target") - whole * F.col("source_size")).alias("budget"))
    limits = materialize(thresholds(base, budgets), "mix-limits")
    return materialize(null_safe(totals.withColumn("whole", whole), limits, ["source"]), "mix-plan")


def _base(docs: DataFrame) -> DataFrame:
    hashed = with_hash(docs.select("doc_id", "source", "text"))
    return materialize(hashed.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.col("__hash").alias("hash")), "mix-base")


def _copies(hash_: Column, cap: float) -> Column:
    return F.least(F.col("whole") + (hash_ <= F.col("threshold")).cast("int"), F.lit(int(cap)))


def mix_to_weights(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """documents -> doc_id, source, size, source_size, target, copies, taken.

    A document is taken ``floor(target / source_size)`` times, and once more if its hash is at or under
    its source's threshold.  Null texts have size 0, a null source is a source of its own (last in
    order), rows that repeat an id or a whole document are taken one by one, an empty table gives an empty result, and columns
    besides doc_id, text and source are ignored.
    """
    base = _base(docs)
    copies = _copies(F.col("hash"), cap)
    return null_safe(base, source_plan(base, weights, share, cap), ["source"]).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken")
    )


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it.

    Texts do not move but for rows that repeat a document: a row's copies follow from its hash and its
    source's row in the plan.
    """
    base = _base(docs)
    plan = source_plan(base, weights, share, cap).select("source", "whole", "threshold")
    release(base)
    renamed = plan.withColumnsRenamed({"whole": "__whole", "threshold": "__threshold"})
    copies = F.least(F.col("__whole") + (F.col("__hash") <= F.col("__threshold")).cast("int"), F.lit(int(cap)))
    return null_safe(with_hash(docs), renamed, ["source"]).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
