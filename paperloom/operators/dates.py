"""Document dates in page texts and word positions.

Parsing is explicit: month first, day first where the month would exceed twelve; ``as_of`` stands for today.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import context_keywords
from ..functions.windows import contexts_of
from ..sources.shared import written

# Month names and the patterns of dates, labels, control numbers and routing slips.
MONTHS = r"Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
NUMERIC = r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}\b"
NUMERIC_SHORT = r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2}\b"
MONTH_FIRST = rf"\b(?:{MONTHS})\.?\s+\d{{1,2}},?\s+\d{{4}}\b"
DAY_FIRST = rf"\b\d{{1,2}}\s+(?:{MONTHS})\.?\s+\d{{4}}\b"
PATTERNS = (NUMERIC, NUMERIC_SHORT, MONTH_FIRST, DAY_FIRST)
LABEL = r"\b(?:doc\w*|dc\w{1,5})\s+(?:date|dte|dat|dae)"
CONTROL = r"\b\d{0,2}9002000\d{3}\b"
CONTROL_DATE = r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{4}\b"
ROUTING = r"(?:document\s+routing\s+slip|routing\s+slip|date\s+requested)"
GLITCHED = r"\b(\d{1,2})[/\-!.](\d{1,2})[/\-!1.](\d{4})\b"
ISO_TIME = r"\b(\d{4})[-/](\d{2})[-/ ](\d{2})[\sT]*\d{1,2}[:\s]?\d{2}[:\s]?\d{2}\b"
ISO_DAY = r"\b(\d{4})[-/](\d{2})[-/](\d{2})\b"
CORRUPTED = r"\b[A-Z]?(\d{2,4})[-/](\d{2})[-/](\d{2})\b"
YEAR_FLOOR, ROUTING_FLOOR = 1950, 2017
ROUTING_CONFIDENCE, FALLBACK_MOST, REVIEW_GAP, STOP_SCORE = 95, 70, 20, 85
MONTH_KEYS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def ymd(y: Column, m: Column, d: Column) -> Column:
    """A date from its parts, null if there is none."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used: as a plain expression each use would
    repeat it, and nested uses would multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_range(date: Column, as_of: Column, floor: int = YEAR_FLOOR) -> Column:
    return once(date, lambda d: F.when((F.year(d) >= floor) & (d <= as_of), d))


def parsed_date(text: Column, as_of: Column, floor: int = YEAR_FLOOR) -> Column:
    """The date of a matched text in one of the four forms."""
    parts = F.struct(*(_int(F.regexp_extract(text, r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$", i)).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))))
    year = lambda c: F.when(c < 100, c + F.when(c < 69, 2000).otherwise(1900)).otherwise(c)
    numeric = once(parts, lambda x: ymd(year(x["c"]), F.when(x["a"] <= 12, x["a"]).otherwise(x["b"]), F.when(x["a"] <= 12, x["b"]).otherwise(x["a"])))
    name = F.lower(F.substring(F.regexp_extract(text, f"(?i)({MONTHS})", 1), 1, 3))
    month = once(name, lambda n: F.when(n != "", F.array_position(F.array(*map(F.lit, MONTH_KEYS)), n).cast("int")))
    day, yr = _int(F.regexp_extract(text, r"\b(\d{1,2})\b", 1)), _int(F.regexp_extract(text, r"\b(\d{4})\b", 1))
    return in_range(F.coalesce(numeric, ymd(yr, month, day)), as_of, floor)


def ambiguous(text: Column) -> Column:
    """A numeric date whose first two parts could both be months."""
    a, b = (_int(F.regexp_extract(text, r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]\d{2,4}$", i)) for i in (1, 2))
    return F.coalesce((a <= 12) & (b <= 12), F.lit(False))


def date_candidates(pages: DataFrame, as_of: Column) -> DataFrame:
    """doc_id, page_idx, ord, matched, date, keywords, ambiguous: dates with 100 characters around them.

    White space is one space each; contexts of neighbouring dates overlap, as they do on the page.
    """
    text = F.regexp_replace(F.trim("page_text"), r"\s+", " ")
    c = F.col("x")
    one = lambda x: F.struct((x["kind"] * 10**6 + x["nth"]).alias("ord"), x["matched"].alias("matched"), (x["kind"] < 2).alias("numeric"), x["context"].alias("context"))
    found = pages.select("doc_id", "page_idx", F.explode(contexts_of(text, PATTERNS, 100)).alias("x")).select("doc_id", "page_idx", one(c).alias("c"))
    rows = found.select("doc_id", "page_idx", "c.ord", "c.matched", parsed_date(F.col("c.matched"), as_of).alias("date"), context_keywords(F.col("c.context")).alias("keywords"), (F.col("c.numeric") & ambiguous(F.col("c.matched"))).alias("ambiguous"))
    return rows.filter("date is not null")


def routing_date(text: Column, as_of: Column) -> Column:
    """struct(date, source) near a control number or a routing slip's header, null without one.

    Any day up to the end of ``as_of``'s year will do: slips are dated ahead."""
    as_of = F.make_date(F.year(as_of), F.lit(12), F.lit(31))
    fit = lambda d: in_range(d, as_of, ROUTING_FLOOR)
    parts = lambda c, p, order=(1, 2, 3): ymd(*(_int(F.regexp_extract(c, p, i)) for i in order))
    after_control = F.regexp_extract_all(text, F.lit(rf"{CONTROL}(?=([\s\S]{{0,80}}))"), F.lit(1))
    control = F.transform(after_control, lambda w: F.struct(fit(parsed_date(F.regexp_extract(w, f"({CONTROL_DATE})", 1), as_of)).alias("date"), F.lit("control_number").alias("source")))

    def ladder(w: Column) -> Column:
        numbers = F.struct(*(_int(F.regexp_extract(w, GLITCHED, i)).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "y"))))
        mmdd = once(numbers, lambda x: fit(ymd(x["y"], F.when(x["a"] <= 12, x["a"]).otherwise(x["b"]), F.when(x["a"] <= 12, x["b"]).otherwise(x["a"]))))
        year = lambda y: F.when(y < 100, y + 2000).otherwise(y)
        one = lambda m: fit(ymd(once(_int(F.regexp_extract(m, CORRUPTED, 1)), year), _int(F.regexp_extract(m, CORRUPTED, 2)), _int(F.regexp_extract(m, CORRUPTED, 3))))
        bad = F.transform(F.regexp_extract_all(w, F.lit(f"({CORRUPTED})"), F.lit(1)), one)
        rungs = (("routing_slip_mmdd", mmdd), ("routing_slip_iso", fit(parts(w, ISO_TIME))), ("routing_slip_date_only", fit(parts(w, ISO_DAY))), ("routing_slip_corrupted", F.get(F.filter(bad, lambda x: x.isNotNull()), F.lit(0))))
        found = F.array(*(F.struct(d.alias("date"), F.lit(source).alias("source")) for source, d in rungs))
        return F.get(F.filter(found, lambda x: x["date"].isNotNull()), F.lit(0))

    header = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?=({ROUTING}[\s\S]{{0,285}}))"), F.lit(1)), lambda w: once(F.substring(w, 1, 300), ladder))
    return F.get(F.filter(F.concat(control, header), lambda x: x["date"].isNotNull()), F.lit(0))


def control_anchor(text: Column, as_of: Column) -> Column:
    """struct(date, confirmed): the first date within 60 characters of a control number."""
    windows = F.regexp_extract_all(text, F.lit(rf"{CONTROL}(?=([\s\S]{{0,60}}))"), F.lit(1))
    one = lambda w: F.struct(parsed_date(F.regexp_extract(w, f"({CONTROL_DATE})", 1), as_of).alias("date"), F.regexp_extract(w, rf"{CONTROL_DATE}([\s\S]*)$", 1).rlike(ISO_TIME).alias("confirmed"))
    return F.get(F.filter(F.transform(windows, one), lambda x: x["date"].isNotNull()), F.lit(0))


def first_date(text: Column, as_of: Column) -> Column:
    """The date of the first pattern, in the patterns' order, whose first match is a date."""
    # One lambda keeps the parser once in the plan.
    found = F.transform(F.array(*(F.regexp_extract(text, f"(?i)({p})", 1) for p in PATTERNS)), lambda m: F.when(m != "", parsed_date(m, as_of)))
    return F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))


def labeled_dates(words: DataFrame, as_of: Column, share: float = 0.02, reach: int = 80) -> DataFrame:
    """doc_id, page_idx, word_idx, text, left, top, width, page_height -> (doc_id, page_idx, date).

    A label's date is the first date word to its right in its row, else the first at or below and right of
    it, else the first date in the ``reach`` characters that follow the label in reading order.  Labels are two
    words that stand side by side; words are numbered without gaps.
    """
    w = W.partitionBy("doc_id", "page_idx").orderBy("word_idx")
    marked = words.withColumns({"next": F.lead("text").over(w), "next_right": F.lead(F.col("left") + F.col("width")).over(w)})
    labels = marked.filter(F.concat_ws(" ", "text", "next").rlike(f"(?i)^{LABEL}")).select("doc_id", "page_idx", F.col("word_idx").alias("label"), F.col("top").alias("ly"), F.col("next_right").alias("lx"), F.greatest(F.col("page_height") * share, F.lit(10.0)).alias("tol"))
    # Few words are dates: only these are parsed.
    dated = words.withColumn("date", once(F.regexp_extract("text", "({}|{})".format(NUMERIC, NUMERIC_SHORT), 1), lambda m: F.when(m != "", parsed_date(m, as_of))))
    # Words take two characters at least, so this many reach as far as the text after a label.
    near = F.col("word_idx").between(F.col("label"), F.col("label") + reach // 2 + 2)
    pairs = labels.join(dated, ["doc_id", "page_idx"]).filter(F.col("date").isNotNull() | near)
    row = F.col("date").isNotNull() & (F.abs(F.col("top") - F.col("ly")) <= F.col("tol")) & (F.col("left") > F.col("lx"))
    below = F.col("date").isNotNull() & (F.col("top") >= F.col("ly")) & (F.col("left") >= F.col("lx"))
    best = pairs.groupBy("doc_id", "page_idx", "label").agg(
        F.min_by("date", F.when(row, F.col("word_idx"))).alias("a"), F.min_by("date", F.when(below, F.col("word_idx"))).alias("b"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(near, F.struct("word_idx", "text")))), lambda x: x["text"]), " ").alias("line"),
    )
    after = F.substring(F.regexp_replace("line", rf"(?i)^{LABEL}", ""), 1, reach)
    return best.select("doc_id", "page_idx", F.coalesce("a", "b", first_date(after, as_of)).alias("date")).filter("date is not null").distinct()


def _best_mentions(candidates: DataFrame) -> DataFrame:
    """(doc_id, page_idx, date, ord, conf, keywords, ambiguous): the surest mention of a date on a page."""
    best = candidates.groupBy("doc_id", "page_idx", "date").agg(F.max_by(F.struct("conf", "keywords", "ambiguous"), F.struct("conf", -F.col("ord"))).alias("b"), F.min("ord").alias("ord"))
    return best.select("doc_id", "page_idx", "date", "ord", "b.*")


def _anchored(rows: DataFrame, labeled: DataFrame, control: DataFrame) -> DataFrame:
    """Rows with whether a label (``labeled``) and whether a control number (``confirmed``, else null) names their date."""
    rows = rows.join(labeled.select("doc_id", "page_idx", "date").distinct().withColumn("labeled", F.lit(True)), ["doc_id", "page_idx", "date"], "left")
    return rows.join(control.select("doc_id", "page_idx", "date", "confirmed"), ["doc_id", "page_idx", "date"], "left")


def _own_score() -> Column:
    return F.lit(20.0) + F.size("keywords") * 15 + F.least("conf", F.lit(100.0)) * 0.3 + F.when(F.col("ambiguous"), -35.0).otherwise(20.0)


def _anchor_bonus() -> Column:
    return F.when(F.col("labeled") & F.col("confirmed").isNotNull(), 100).when(F.col("confirmed"), 90).when(F.col("confirmed").isNotNull(), 60).when(F.col("labeled"), 80).otherwise(0)


def disagreeing_pages(labeled: DataFrame, control: DataFrame) -> DataFrame:
    """(doc_id, page_idx) where labels and control numbers name dates and none in common."""
    both = labeled.groupBy("doc_id", "page_idx").agg(F.collect_set("date").alias("l")).join(control.groupBy("doc_id", "page_idx").agg(F.collect_set("date").alias("c")), ["doc_id", "page_idx"])
    return both.filter(~F.arrays_overlap("l", "c")).select("doc_id", "page_idx")


def quick_confidence(pages: DataFrame, candidates: DataFrame, labeled: DataFrame, control: DataFrame) -> DataFrame:
    """(doc_id, page_idx, quick, anchored) of every page: the confidence, 100 at most, that the pages up to it give.

    It is the best score so far, labels and control numbers included wherever they disagree; null before the
    first candidate.  A page is anchored if a label or a control number on it names a date.
    """
    rows = _anchored(_best_mentions(candidates), labeled, control)
    scores = rows.groupBy("doc_id", "page_idx").agg(F.max(_own_score() + _anchor_bonus()).alias("score"))
    firsts = rows.groupBy("doc_id", "date").agg(F.min("page_idx").alias("page_idx")).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("new"))
    anchors = labeled.select("doc_id", "page_idx").union(control.select("doc_id", "page_idx")).distinct().withColumn("anchored", F.lit(True))
    on = ["doc_id", "page_idx"]
    every = pages.select(*on).distinct().join(scores, on, "left").join(firsts, on, "left").join(anchors, on, "left")
    so_far = W.partitionBy("doc_id").orderBy("page_idx").rowsBetween(W.unboundedPreceding, 0)
    quick = F.max("score").over(so_far) + F.when(F.sum(F.coalesce("new", F.lit(0))).over(so_far) <= 1, 15.0).otherwise(0.0)
    return every.select(*on, F.floor(F.least(quick, F.lit(100.0))).cast("int").alias("quick"), F.coalesce("anchored", F.lit(False)).alias("anchored"))


def quick_stops(quick: DataFrame) -> DataFrame:
    """(doc_id, stop): the first anchored page after the first one with enough confidence; later pages are not read."""
    return quick.filter((F.col("page_idx") >= 1) & (F.col("quick") >= STOP_SCORE) & F.col("anchored")).groupBy("doc_id").agg(F.min("page_idx").alias("stop"))


def scored(candidates: DataFrame, labeled: DataFrame, control: DataFrame, until: DataFrame | None = None) -> DataFrame:
    """Candidates (doc_id, page_idx, ord, date, conf, keywords, ambiguous) with their scores.

    Of a date on a page the surest mention counts, with the place of the first.  Labels and control
    numbers add to a date's score, except on pages where they name different dates.
    """
    if until is not None:
        candidates = candidates.join(until, "doc_id", "left").filter(F.col("stop").isNull() | (F.col("page_idx") <= F.col("stop"))).drop("stop")
    best = _best_mentions(candidates)
    dates = best.groupBy("doc_id").agg(F.count_distinct("date").alias("dates"))
    rows = _anchored(best.join(dates, "doc_id"), labeled, control)
    rows = rows.join(disagreeing_pages(labeled, control).withColumn("differ", F.lit(True)), ["doc_id", "page_idx"], "left")
    score = _own_score() + F.when(F.col("dates") <= 1, 15.0).otherwise(0.0) + F.when(F.coalesce("differ", F.lit(False)), 0).otherwise(_anchor_bonus())
    return rows.select("doc_id", "page_idx", "date", "ord", score.alias("score"), F.coalesce("differ", F.lit(False)).alias("differ"))


def decided(docs: DataFrame, scores: DataFrame, routing: DataFrame, differing: DataFrame | None = None) -> DataFrame:
    """doc_id, date, confidence, method, needs_review: a routing date decides, else the best candidate.

    ``differing``: pages (doc_id, page_idx) where anchors disagree, with candidates or without.
    """
    per_date = scores.groupBy("doc_id", "date").agg(F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), "page_idx", "ord")).alias("place"), F.bool_or("differ").alias("differ"))
    w = W.partitionBy("doc_id").orderBy("place")
    ranked = per_date.withColumns({"rn": F.row_number().over(w), "next": F.lead("score").over(w), "any_differ": F.bool_or("differ").over(W.partitionBy("doc_id"))}).filter("rn = 1")
    best = ranked.select("doc_id", "date", F.floor(F.least("score", F.lit(float(FALLBACK_MOST)))).cast("int").alias("confidence"), (F.col("any_differ") | F.coalesce(F.col("score") - F.col("next") < REVIEW_GAP, F.lit(False))).alias("needs_review"))
    out = docs.select("doc_id").join(routing.select("doc_id", F.col("date").alias("r")), "doc_id", "left").join(best, "doc_id", "left")
    if differing is not None:
        out = out.join(differing.select("doc_id").distinct().withColumn("elsewhere", F.lit(True)), "doc_id", "left")
        out = out.withColumn("needs_review", F.col("needs_review") | F.coalesce("elsewhere", F.lit(False)))
    routed = F.col("r").isNotNull()
    return out.select(
        "doc_id", F.coalesce("r", "date").alias("date"), F.when(routed, ROUTING_CONFIDENCE).otherwise(F.coalesce("confidence", F.lit(0))).alias("confidence"),
        F.when(routed, "routing_slip").when(F.col("date").isNotNull(), "scored").otherwise("none").alias("method"), F.when(routed, F.lit(False)).otherwise(F.coalesce("needs_review", F.lit(False))).alias("needs_review"),
    )


def stop_pages(page_scores: DataFrame) -> DataFrame:
    """doc_id, page_idx, score, anchored -> doc_id, stop: the first page after the first one where the best
    score so far suffices and that page is anchored; later pages are not read."""
    w = W.partitionBy("doc_id").orderBy("page_idx").rowsBetween(W.unboundedPreceding, 0)
    so_far = page_scores.withColumn("best", F.max("score").over(w))
    return so_far.filter((F.col("page_idx") >= 1) & (F.col("best") >= STOP_SCORE) & F.col("anchored")).groupBy("doc_id").agg(F.min("page_idx").alias("stop"))


def document_dates(pages: DataFrame, words: DataFrame, as_of: Column, include_date: bool = True, skipped: DataFrame | None = None, conf: Column | None = None) -> DataFrame:
    """From pages (doc_id, page_idx, page_text) and words (as ``labeled_dates`` takes them) to doc_id, date,
    confidence, method, needs_review, one row per document.

    Pages in ``skipped`` (doc_id, page_idx: blank ones and separators) give no candidates, but a routing slip on any
    page decides.  Reading stops at the page that makes the document's date sure.  Without ``include_date`` no
    date is looked for and the method is "skipped".  ``conf``: confidence of a candidate's reading.
    """
    docs = pages.select("doc_id").distinct()
    if not include_date:
        return docs.select("doc_id", F.lit(None).cast("date").alias("date"), F.lit(0).alias("confidence"), F.lit("skipped").alias("method"), F.lit(False).alias("needs_review"))
    pages = pages.select("doc_id", "page_idx", "page_text")
    slips = pages.select("doc_id", "page_idx", routing_date(F.col("page_text"), as_of).alias("r")).filter("r.date is not null")
    # Written, as every later step leaves out what the slips settle and would read them all again.
    routing = written(slips.groupBy("doc_id").agg(F.min_by("r.date", "page_idx").alias("date")), "routing-dates")
    # What a routing slip settles needs no scores.
    read = pages.join(routing, "doc_id", "left_anti")
    if skipped is not None:
        read = read.join(skipped.select("doc_id", "page_idx"), ["doc_id", "page_idx"], "left_anti")
    found = written(date_candidates(read, as_of).withColumn("conf", F.lit(100.0) if conf is None else conf), "date-candidates")
    labeled = written(labeled_dates(words.join(read.select("doc_id", "page_idx"), ["doc_id", "page_idx"], "left_semi"), as_of), "labeled-dates")
    control = read.select("doc_id", "page_idx", control_anchor(F.col("page_text"), as_of).alias("c")).select("doc_id", "page_idx", "c.date", "c.confirmed").filter("date is not null")
    control = written(control, "control-dates")
    stops = written(quick_stops(quick_confidence(read, found, labeled, control)), "date-stops")
    until = lambda rows: rows.join(stops, "doc_id", "left").filter(F.col("stop").isNull() | (F.col("page_idx") <= F.col("stop"))).drop("stop")
    labeled, control = until(labeled), until(control)
    return decided(docs, scored(until(found), labeled, control), routing, disagreeing_pages(labeled, control).join(found, "doc_id", "left_semi"))
