"""Word boxes to lines, phrases and heading runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def line_segments(words: DataFrame, tolerance: float = 4.0, gap: float = 2.5) -> DataFrame:
    """doc_id, page_idx, text, x0, y0, x1, y1, conf -> lines: line_no, text, box, height, conf.

    Words go by rounded height, then from left to right; a word continues the line of the word before it
    if it is as high and the gap is at most ``gap`` times that word's height (at least 10).
    """
    w = W.partitionBy("doc_id", "page_idx").orderBy(F.bround(F.col("y0") / tolerance), "x0", "word_idx")
    before = lambda c: F.lag(c).over(w)
    joins = (F.abs(F.col("y0") - before("y0")) <= tolerance) & (F.col("x0") - before("x1") <= F.greatest(before("y1") - before("y0"), F.lit(10.0)) * gap)
    flagged = words.withColumns({"starts": (~F.coalesce(joins, F.lit(False))).cast("int"), "pos": F.row_number().over(w)})
    numbered = flagged.withColumn("line_no", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    lines = numbered.groupBy("doc_id", "page_idx", "line_no").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("conf").alias("conf"))
    return lines.withColumn("height", F.col("y1") - F.col("y0"))


def phrases(lines: DataFrame) -> DataFrame:
    """Lines, and pairs of consecutive lines no more than 1.5 line heights apart, in reading order (ord)."""
    w = W.partitionBy("doc_id", "page_idx").orderBy("line_no")
    nxt = {c: F.lead(c).over(w).alias(f"n_{c}") for c in ("text", "x0", "y0", "x1", "y1", "conf")}
    pairs = lines.select("*", *nxt.values())
    close = (F.col("n_y0") - F.col("y1")).between(0, F.col("height") * 1.5)
    single = F.struct((F.col("line_no") * 2).alias("ord"), "text", "x0", "y0", "x1", "y1", "height", "conf")
    double = F.struct(
        (F.col("line_no") * 2 + 1).alias("ord"), F.concat_ws(" ", "text", "n_text").alias("text"), F.least("x0", "n_x0").alias("x0"), F.col("y0"), F.greatest("x1", "n_x1").alias("x1"),
        F.col("n_y1").alias("y1"), (F.col("n_y1") - F.col("y0")).alias("height"), ((F.col("conf") + F.col("n_conf")) / 2).alias("conf"),
    )
    both = F.when(close, F.array(single, double)).otherwise(F.array(single))
    return pairs.select("doc_id", "page_idx", F.explode(both).alias("p")).select("doc_id", "page_idx", "p.*")


def runs(rows: DataFrame, group: list[str], order: str, flag: str, most: int = 4, out: str = "run") -> DataFrame:
    """Numbers the runs of consecutive flagged rows, cutting runs after ``most`` rows; other rows go."""
    w = W.partitionBy(*group).orderBy(order)
    island = F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("__island", island).filter(F.col(flag))
    place = F.row_number().over(W.partitionBy(*group, "__island").orderBy(order)) - 1
    return marked.withColumn(out, F.struct(F.col("__island").alias("island"), F.floor(place / most).alias("chunk"))).drop("__island")


def company_phrases(found: DataFrame, page_height: Column, matches: DataFrame | None = None, k: int = 4, high: float = 65.0) -> DataFrame:
    """The ``k`` best company phrases of each page: doc_id, page_idx, badge, text, score, is_high.

    Points: keyword 35 or 15, place on the page 25, 15 or 10, height 15 or 8, capitals 10, and 0.3 times a
    roster score of 75 or more (``matches``: name, score over the normal form).  Of phrases with the same
    normal form the first counts; ties keep reading order.
    """
    cleaned = X.without_edge_marks(F.col("text"))
    rows = found.withColumn("text", cleaned).filter(F.size(F.split("text", r"\s+")) >= 2).withColumn("form", X.company_form(F.col("text"))).filter("form <> ''")
    if matches is not None:
        rows = rows.join(matches.select(F.col("name").alias("form"), F.col("score").alias("fuzzy")), "form", "left")
    else:
        rows = rows.withColumn("fuzzy", F.lit(None).cast("int"))
    listed = F.col("fuzzy") >= 75
    kind = X.keyword_class(F.col("form"))
    y = F.col("y0") / page_height
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]", ""))
    score = (
        F.when(kind == "strong", 35.0).when(kind == "weak", 15.0).otherwise(0.0)
        + F.when(y < 0.25, 25.0).when(y < 0.40, 15.0).when(y > 0.80, 10.0).otherwise(0.0)
        + F.when(F.col("height") >= 14, 15.0).when(F.col("height") >= 11, 8.0).otherwise(0.0)
        + F.when(capitals >= letters * 0.75, 10.0).otherwise(0.0)
        + F.when(listed, F.col("fuzzy") * 0.3).otherwise(0.0)
    )
    kept = rows.filter((kind == "strong") | listed).withColumn("score", F.bround(score, 1))
    first = kept.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "page_idx", "form").orderBy("ord"))).filter("n = 1")
    w = W.partitionBy("doc_id", "page_idx").orderBy(F.desc("score"), "ord")
    ranked = first.withColumn("badge", F.row_number().over(w)).filter(F.col("badge") <= k)
    return ranked.select("doc_id", "page_idx", "badge", "text", "score", (F.col("score") >= high).alias("is_high"))
