"""How five document filters interact, from one relational pass over the words.

Words are exploded, counted by (doc_id, word) and then by doc_id for totals and distinct words; the other
filters' flags are joined to these outer-wise.  A document fails one of 32 sets of filters, and for each
source 32 conditional counts hold all there is to know about any order of the filters: what each of the 120
orders removes at each step is a sum of such counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, null_safe, release, small

# The filters and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, "[#$%&*|]"
#: Most rows of a table that is sent to every task.
SENT = 200_000


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("look"))


def word_totals(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, look (a hash of the text), words, distinct_words.

    Texts move once, by document and by the part of the input they were read from, so that no document's
    copies gather beyond one part; both counts follow where they are.  Rows that repeat a document count
    their words together, hence the division by the number of rows.
    """
    rows = _rows(docs).select("doc_id", "look", F.spark_partition_id().alias("read_in"), "text").repartition("doc_id", "look", "read_in")
    words = rows.select("doc_id", "look", "read_in", F.posexplode(F.split("text", r"[\x20\x09-\x0D]+")).alias("at", "word"))
    by_word = words.groupBy("doc_id", "look", "read_in", "word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") == 0).alias("rows"))
    real = F.col("word") != ""
    by_part = by_word.groupBy("doc_id", "look", "read_in").agg(
        (F.sum(F.when(real, F.col("n")).otherwise(0)) / F.sum("rows")).cast("long").alias("words"), F.count_if(real).alias("distinct_words")
    )
    return by_part.groupBy("doc_id", "look").agg(F.max("words").alias("words"), F.max("distinct_words").alias("distinct_words"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents -> part, failed (bits of the failed filters, A first), good, toxic, one row per document."""
    flags = _rows(docs).select(
        "doc_id", "part", "look", F.sha2("text", 256).alias("digest"),
        (100 * (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))) > CAPITAL_PERCENT * F.length("text")).alias("c"),
        F.col("text").rlike(SYMBOLS).alias("d"),
    )
    flags = materialize(flags, "audit-flags")
    first = materialize(flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"), "audit-first")
    totals = materialize(word_totals(docs), "audit-words")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = materialize(marks.filter("(good = 1 or toxic = 1) and doc_id is not null"), "audit-marks")
    whole = flags.join(small(first, SENT), "digest", "left")
    whole = null_safe(whole, totals, ["doc_id", "look"], "left").join(small(marks, SENT), "doc_id", "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))]
    failed = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    marked = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    found = materialize(whole.select("part", failed.alias("failed"), marked("good"), marked("toxic")), "audit-failures")
    release(flags, first, totals, marks)
    return found


def _summed(counts: str, take) -> Column:
    """Sum of the counts of the sets of failed filters that ``take`` accepts."""
    zero = F.lit(0).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1)), zero, lambda a, m: a + F.when(take(m), F.get(F.col(counts), m)).otherwise(zero))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents and labels -> part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley: 600 rows per source.

    Null texts are empty and a null source is the part ''.  A null id equals no other document's and is
    never a repeat (filter E); rows that repeat an id are documents of their own, and those that repeat id
    and text fail E only beside a smaller id.  Of several labels for an id any 1 counts.  Texts of any
    length are counted whole; empty tables give an empty result; other columns are ignored.
    """
    of = failures(docs, labels)
    sets = range(2 ** len(FILTERS))
    count = lambda name, and_=F.lit(True): [F.count_if((F.col("failed") == m) & and_).alias(f"{name}{m}") for m in sets]
    counted = of.groupBy("part").agg(*count("n"), *count("g", F.col("good")), *count("t", F.col("toxic")))
    arrays = counted.select("part", *(F.array(*(F.col(f"{c}{m}") for m in sets)).alias(c) for c in "ngt"))
    counted = materialize(arrays, "audit-counts")
    release(of)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.expr("substring(filter_order, step, 1)")
    bit = F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)")
    before = sum((F.when(F.instr(F.col("filter_order"), f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("letter", letter).withColumn("bit", bit).withColumn("before", before)
    has = lambda m, c: m.bitwiseAND(F.col(c)) != 0
    removed = lambda m: has(m, "bit") & ~has(m, "before")
    steps = steps.select(
        "part", "filter_order", "step", "letter",
        _summed("n", lambda m: ~has(m, "bit") & ~has(m, "before")).alias("kept"),
        _summed("n", removed).alias("removed"),
        _summed("n", lambda m: has(m, "bit") & has(m, "before")).alias("redundant"),
        F.get(F.col("n"), F.col("bit")).alias("unique_fails"),
        _summed("g", removed).alias("good_lost"),
        _summed("t", removed).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")
