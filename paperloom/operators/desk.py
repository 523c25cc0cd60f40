"""The review desk: lists shown to a reviewer, state of a scan, staged paths, word boxes and small page rules.

Everywhere: an empty table gives an empty result, and columns that are not named pass through or are
ignored; helper columns start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .naming import numbered_globally
from .reconcile import REMAINING

# Points per inch, the recognition resolution and its least confidence.
POINTS, SCAN_DPI, LEAST_CONFIDENCE = 72.0, 150, 20


# ---- lists ---------------------------------------------------------------------------------------


def native_text(pages: DataFrame, probe: int = 3, least: int = 40) -> DataFrame:
    """doc_id, has_text: whether the first ``probe`` pages hold ``least`` characters, so that none need be recognised.

    White space around a page's text does not count; null texts are empty; documents without these pages have no row.
    """
    length = F.length(F.regexp_replace(F.coalesce("page_text", F.lit("")), r"^\s+|\s+$", ""))
    return pages.filter(F.col("page_idx") < probe).groupBy("doc_id").agg((F.sum(length) >= least).alias("has_text"))


def pending(docs: DataFrame) -> DataFrame:
    """Documents that were not reviewed; a null mark is not reviewed."""
    return docs.filter(~F.coalesce("reviewed", F.lit(False)))


def found_in_roster(roster: DataFrame, query: str) -> DataFrame:
    """Entries that contain the query in any case; all entries for a blank one.  Sorted."""
    asked = query.strip().lower()
    return (roster.filter(F.lower("entry").contains(asked)) if asked else roster).orderBy("entry")


def roster_without(roster: DataFrame, names: DataFrame) -> DataFrame:
    """The roster without the given entries, each spelt exactly."""
    return roster.join(names.select("entry").distinct(), "entry", "left_anti")


def first_failures(failures: DataFrame, most: int = 20) -> DataFrame:
    """(ord, name, error) -> ord, line: the first ``most`` failures, then how many more there are."""
    head = failures.orderBy("ord").limit(most).select("ord", F.concat_ws(": ", "name", "error").alias("line"))
    more = failures.agg(F.count(F.lit(1)).alias("__n"), F.max("ord").alias("__last")).filter(F.col("__n") > most)
    return head.unionByName(more.select((F.col("__last") + 1).alias("ord"), F.concat(F.lit("... and "), (F.col("__n") - most).cast("string"), F.lit(" more")).alias("line")))


def first_pages(pages: DataFrame, most: int) -> DataFrame:
    """Pages up to a number per document; page numbers start at 0."""
    return pages.filter(F.col("page_idx") < most)


def flagged(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents with their date candidates as one nested list in order; documents without any have an empty one.

    ``candidates``: doc_id, ord, matched, date, confidence, keywords."""
    kind = "array<struct<matched: string, date: string, confidence: double, keywords: array<string>>>"
    listed = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "matched", F.col("date").cast("string").alias("date"), F.col("confidence").cast("double").alias("confidence"), "keywords"))).alias("__c"))
    without_ord = F.transform("__c", lambda c: F.struct(c["matched"].alias("matched"), c["date"].alias("date"), c["confidence"].alias("confidence"), c["keywords"].alias("keywords")))
    return docs.join(listed, "doc_id", "left").withColumn("candidates", F.coalesce(without_ord, F.array().cast(kind))).drop("__c")


def confirmed_rows(docs: DataFrame, with_dates: bool) -> DataFrame:
    """Confirmed documents (with a date, if dates are on), quality results (struct ``qc``) flattened."""
    kept = docs.filter((F.col("status") == "confirmed") & (F.col("date").isNotNull() | F.lit(not with_dates)))
    return kept.select(
        "path", "division", "company", "name", F.coalesce(F.col("date").cast("string"), F.lit("")).alias("detected_date"), F.coalesce("confidence", F.lit(100)).alias("confidence"),
        F.coalesce("qc.status", F.lit("")).alias("qc_status"), F.coalesce("qc.reasons", F.lit("")).alias("qc_failure_reasons"), F.coalesce("qc.blank", F.lit(False)).alias("qc_blank_detected"),
    )


def clones(docs: DataFrame) -> DataFrame:
    """Copies of the rows with ids of their own."""
    return docs.withColumn("identity", F.concat(F.lit("doc-"), F.uuid()))


# ---- scan state ----------------------------------------------------------------------------------


def scan_state(plan: DataFrame, processed: DataFrame, group: str | None = None) -> DataFrame:
    """(path, ord) and (path) -> plan (in order) and processed (sorted) as arrays; no row without a plan.

    With ``group``, one state per value of that column of both tables."""
    by = [group] if group else []
    planned = plan.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("plan")).filter(F.size("plan") > 0)
    done = processed.groupBy(*by).agg(F.sort_array(F.collect_set("path")).alias("processed"))
    joined = planned.join(done, group, "left") if group else planned.join(F.broadcast(done), how="left")  # one row each
    return joined.withColumn("processed", F.coalesce("processed", F.array().cast("array<string>")))


def plan_for_run(report: DataFrame) -> DataFrame:
    """(path, status) -> path, existing: every input in the order of paths, and whether it is done."""
    return report.select("path", (~F.col("status").isin(*REMAINING)).alias("existing")).orderBy("path")


def applied(docs: DataFrame) -> DataFrame:
    """Saved rows made whole: contents decoded, missing ids filled in from path and name, ``pending`` marked."""
    identity = F.concat(F.lit("doc-"), F.substring(F.sha1(F.concat_ws("|", "path", "name")), 1, 24))
    return docs.withColumns({"content": F.unbase64("content"), "identity": F.coalesce(F.nullif("identity", F.lit("")), identity), "pending": ~F.coalesce("reviewed", F.lit(False))})


def serialized(docs: DataFrame, active: Column) -> DataFrame:
    """Rows as JSON; contents are kept, as text, for the active document alone."""
    kept = docs.withColumn("content", F.when(active, F.base64("content")))
    return kept.select("doc_id", F.to_json(F.struct(*sorted(c for c in docs.columns))).alias("json"))


def index_or_memory(index: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """Rows of a stored index, and those in memory that it lacks."""
    return index.unionByName(memory.join(index.select(key).distinct(), key, "left_anti"))


# ---- paths ---------------------------------------------------------------------------------------


def staged_paths(remaining: DataFrame, input_root: str, stage: str) -> DataFrame:
    """(path) -> path, staged: under the stage and the input root's own name; paths outside keep their name alone."""
    root = input_root.rstrip("/")
    base = f"{stage.rstrip('/')}/{root.rpartition('/')[2]}/"
    inside = F.col("path").startswith(f"{root}/")
    return remaining.withColumn("staged", F.concat(F.lit(base), F.when(inside, F.substring("path", len(root) + 2, 2**31 - 1)).otherwise(F.element_at(F.split("path", "/"), -1))))


def passed_paths(docs: DataFrame, output_root: str) -> DataFrame:
    """Confirmed documents with a final name -> source and target under passed/; the source's folder is the
    cleaned company name (``folder``)."""
    done = docs.filter((F.col("status") == "confirmed") & (F.coalesce("final_name", F.lit("")) != ""))
    return done.select("doc_id", F.concat_ws("/", F.lit(output_root), "division", "folder", "final_name").alias("source"), F.concat_ws("/", F.lit(output_root), F.lit("passed"), "division", "company", "final_name").alias("target"))


def next_number(files: DataFrame, asked: DataFrame) -> DataFrame:
    """files (folder, name) and asked (folder, prefix, suffix) -> asked with number: one more than there are
    files in the folder whose names start and end so."""
    hits = asked.distinct().join(files, "folder").filter(F.col("name").startswith(F.col("prefix")) & F.col("name").endswith(F.col("suffix")) & (F.length("name") >= F.length("prefix") + F.length("suffix")))
    counts = hits.groupBy("folder", "prefix", "suffix").agg(F.count(F.lit(1)).alias("__n"))
    return asked.join(counts, ["folder", "prefix", "suffix"], "left").withColumn("number", F.coalesce("__n", F.lit(0)) + 1).drop("__n")


# ---- word boxes ----------------------------------------------------------------------------------


def page_boxes(wanted: DataFrame, cache: DataFrame, digital: DataFrame, scanned: DataFrame, top: float | None = None) -> DataFrame:
    """wanted (sha, page_idx, height): each page's boxes from the first source that has any: the cache, digital
    words, else recognised ones, which are scaled from pixels to points and need some confidence.

    All three: sha, page_idx, ord, text, x0, y0, x1, y1, conf.  ``top``: share of the height that boxes other
    than cached ones must begin in."""
    box = ["sha", "page_idx", "ord", "text", "x0", "y0", "x1", "y1", "conf"]
    key = ["sha", "page_idx"]
    said = lambda d: d.withColumn("text", F.trim("text")).filter(F.coalesce("text", F.lit("")) != "")
    within = lambda d: d.join(wanted, key).filter(F.col("y0") <= F.col("height") * top).select(*box) if top is not None else d.join(wanted.select(*key), key, "left_semi").select(*box)
    scale = POINTS / SCAN_DPI
    seen = scanned.filter(F.col("conf") >= LEAST_CONFIDENCE).withColumns({c: F.col(c) * scale for c in ("x0", "y0", "x1", "y1")})
    first = cache.join(wanted.select(*key), key, "left_semi").select(*box)
    second = within(said(digital)).withColumn("conf", F.lit(100.0)).join(first.select(*key).distinct(), key, "left_anti")
    third = within(said(seen)).join(first.select(*key).unionByName(second.select(*key)).distinct(), key, "left_anti")
    tagged = [d.select(*box, F.lit(s).alias("source")) for d, s in ((first, "cache"), (second, "digital"), (third, "scanned"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def line_at(points: DataFrame, lines: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """points (id, page, px, py) and lines (page, line_ord, text, x0, y0, x1, y1) -> id, text: the first line whose
    box, widened by the tolerance, holds the point, else the nearest to the side of it at its height."""
    hit = points.join(lines, "page").filter((F.col("py") >= F.col("y0") - tolerance) & (F.col("py") <= F.col("y1") + tolerance))
    inside = (F.col("px") >= F.col("x0") - tolerance) & (F.col("px") <= F.col("x1") + tolerance)
    aside = F.when(F.col("px").between(F.col("x0"), F.col("x1")), 0.0).otherwise(F.least(F.abs(F.col("px") - F.col("x0")), F.abs(F.col("px") - F.col("x1"))))
    return hit.groupBy("id").agg(F.min_by("text", F.struct(F.when(inside, 0).otherwise(1), F.when(inside, 0.0).otherwise(aside), "line_ord")).alias("text"))


def reading_quality(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_idx, conf) -> mean of the positive confidences (0 without any) and their number."""
    positive = F.when(F.col("conf") > 0, F.col("conf"))
    return boxes.groupBy("doc_id", "page_idx").agg(F.coalesce(F.avg(positive), F.lit(0.0)).alias("mean_conf"), F.count(positive).alias("n_words"))


def mirrored(normal: Column, flipped: Column, normal_words: Column, flipped_words: Column, delta: float = 15.0, least_words: int = 5) -> Column:
    """What reading a page as it is and flipped says: mirrored, review or straight; pages with few words are straight."""
    gain = flipped - normal
    few = (normal_words < least_words) & (flipped_words < least_words)
    return F.when(few, "straight").when(gain >= delta, "mirrored").when(gain > 0, "review").otherwise("straight")


def unmarked(marks: Column, page: Column) -> Column:
    """Page marks (blank or separator) without a page."""
    return F.array_except(marks, F.array(page))


def display_size(width: Column, height: Column, rotation: Column) -> Column:
    """Size of a page as it is shown: sides change places on a quarter turn."""
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def reviewed_in_order(docs: DataFrame) -> DataFrame:
    """Documents with ``pos``, their place from 0 by name (none first), then path."""
    named = docs.withColumn("__name", F.coalesce("name", F.lit("")))
    return numbered_globally(named, ["__name", "path"], 0, "pos").drop("__name")


def resumed_plan(plan: DataFrame, processed: DataFrame) -> DataFrame:
    """path, pos: the plan's paths that are not processed, each once, with their place from 0 by path."""
    return numbered_globally(plan.select("path").distinct().join(processed.select("path").distinct(), "path", "left_anti"), ["path"], 0, "pos")
