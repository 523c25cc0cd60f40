"""How far the sources of a language differ in their words, by inclusion and exclusion over supports.

A source's price of a term depends on the term's count alone, so a histogram of counts prices all terms
that only one of two sources has, and one constant those that neither has.  Only terms that both have are
met, in a join of sparse postings, where what the histograms took for them is put right:

    sum over kept terms of f(p, q) = sum over a's terms of f(p, q0) + sum over b's terms of f(p0, q)
        + (V - terms of a - terms of b) * f(p0, q0) + sum over common terms of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

with p0 and q0 the prices of a count of zero.  All sums are of integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release, trim, word_lists

#: Documents of a language that must hold a term, scale of the prices, ranks of the term report.
LEAST_DOCS, SCALE, RANKS = 3, 1_000_000_000, 200
#: Distinct (language, source, term) that a task holds before it passes their counts on.
HELD = 200_000
#: Bytes of terms stay, A-Z lowered; all others end a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, text) -> lang, source, term, n (occurrences), docs (documents that hold it)."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on():
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                    schema=schema,
                )
            held.clear()

        size = 0
        for b in batches:
            for s in range(0, b.num_rows, 200):
                for row in b.slice(s, 200).to_pylist():
                    n, docs = held.setdefault((row["lang"], row["source"]), (Counter(), Counter()))
                    before, own = len(n), Counter()
                    for terms in word_lists((row["text"] or b"").translate(_TERM_BYTES)):
                        own.update(terms)
                    n.update(own)
                    docs.update(own.keys())
                    size += len(n) - before
                    if size >= HELD:
                        yield from passed_on()
                        size = 0
        yield from passed_on()
        trim()

    found = _groups(docs, F.col("text").cast("binary").alias("text")).mapInArrow(scan, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), *more)


def price(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), in decimals, so that no product overflows."""
    return F.expr(f"(cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} + {kept} as decimal(20,0)) + 1")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _exact(c: Column) -> Column:
    return F.sum(c.cast("decimal(28,0)"))


def source_divergence(docs: DataFrame) -> DataFrame:
    """documents -> lang, source, part ('pair' or 'term'), item, value, rank.

    Null languages and sources are '', null texts empty.  A group without kept terms still has its pairs,
    of value 0 if its language keeps none; it has no terms to report.  Repeated rows count each time, texts
    of any length are read whole, an empty table gives an empty result, other columns are ignored.  Terms
    that tie go by their bytes.
    """
    counts = materialize(term_counts(docs), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS).drop("docs")
    postings = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "divergence-postings")
    of_lang = postings.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = _groups(docs).distinct().join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", zero("total"), zero("support"), zero("v"), zero("lang_total"))
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, price("0", "total", "v"))), "divergence-groups")

    priced = postings.join(groups.drop("support"), ["lang", "source"]).withColumn("p", price("n", "total", "v"))
    priced = materialize(priced.withColumn("q", price("lang_n", "lang_total", "v")).select("lang", "source", "term", "n", "p", "q", "p0"), "divergence-priced")
    terms = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= RANKS)

    # One row for each ordered pair of a language's sources, as in the result.
    b = groups.select("lang", F.col("source").alias("b"), F.col("support").alias("b_support"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", F.col("source").alias("a"), "support", "v", "p0").join(b, "lang").filter("a <> b").withColumn("f0", distance("p0", "q0"))
    pairs = materialize(pairs, "divergence-pairs")
    histogram = materialize(priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times")), "divergence-histogram")
    mine = histogram.withColumnRenamed("source", "a").join(pairs, ["lang", "a"]).groupBy("lang", "a", "b").agg(_exact(distance("p", "q0").cast("decimal(19,0)") * F.col("times")).alias("mine"))
    theirs = histogram.select("lang", F.col("source").alias("b"), F.col("p").alias("q"), "times").join(pairs, ["lang", "b"])
    theirs = theirs.groupBy("lang", "a", "b").agg(_exact(distance("p0", "q").cast("decimal(19,0)") * F.col("times")).alias("theirs"))
    x = priced.select("lang", "term", F.col("source").alias("a"), "p", "p0")
    y = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    right = lambda p, q, p0, q0: _exact(distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0))
    common = x.join(y, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(right("p", "q", "p0", "q0").alias("there"), right("q", "p", "q0", "p0").alias("back"))
    common = common.select("lang", F.explode(F.array(F.struct("a", "b", F.col("there").alias("both")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("both")))).alias("pair"))
    common = materialize(common.select("lang", "pair.*"), "divergence-common")
    whole = pairs
    for part in (mine, theirs, common):
        whole = whole.join(part, ["lang", "a", "b"], "left")
    neither = (F.col("v") - F.col("support") - F.col("b_support")).cast("decimal(20,0)") * F.col("f0").cast("decimal(20,0)")
    value = sum((F.coalesce(c, F.lit(0)) for c in ("mine", "theirs", "both")), F.coalesce(neither, F.lit(0)))
    whole = whole.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.cast("long").alias("value"))
    found = materialize(whole.withColumn("rank", F.row_number().over(by_value)).unionByName(terms), "divergence-result")
    release(counts, postings, groups, priced, pairs, histogram, common)
    return found
