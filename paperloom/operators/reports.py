"""What a reconciliation and a finalize run report: tables for export, a text in sections, and the audit log.

Inputs are rows (status, path, rel_path, output_match, score, reason) and outputs (status, rel_path,
matched_inputs: array of paths, reason).  Null scores, matches and reasons are shown as empty; empty tables
give headings with "(none)"; repeated rows are listed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import month_stamp
from .reconcile import REMAINING

# The report's sections and the statuses in them.
DONE = ("DONE_SESSION", "DONE_MANIFEST", "DONE_TEXT_MATCH", "DONE_IMAGE_MATCH")
SECTIONS = (("REMAINING - scan these", REMAINING), ("SHARED / MERGED - done, verify", ("SHARED_OUTPUT",)), ("DONE", DONE))
OUTPUT_SECTIONS = (("ORPHAN OUTPUTS - no input matched", "ORPHAN_OUTPUT"), ("RAW COPIES - present in output but not finalized", "RAW_COPY"))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def shown_score(score: Column) -> Column:
    """Three decimals; empty for none and zero."""
    return F.when(score != 0, F.format_string("%.3f", F.bround(score.cast("double"), 3))).otherwise("")


def remaining_table(rows: DataFrame) -> DataFrame:
    """status, input_file, rel_path, output_match, score, reason of every input, as text."""
    return rows.select("status", _name(F.col("path")).alias("input_file"), "rel_path", _or_empty("output_match").alias("output_match"), shown_score(F.col("score")).alias("score"), _or_empty("reason").alias("reason"))


def outputs_table(outputs: DataFrame) -> DataFrame:
    """status, output_file, rel_path, matched_inputs, reason of every output, as text."""
    names = F.array_join(F.transform(F.coalesce("matched_inputs", F.array().cast("array<string>")), _name), "; ")
    return outputs.select("status", _name(F.col("rel_path")).alias("output_file"), "rel_path", names.alias("matched_inputs"), _or_empty("reason").alias("reason"))


def json_rows(rows: DataFrame, pages: str = "matched_output_pages") -> DataFrame:
    """One JSON text per row; the set of pages is sorted, and empty where there is none."""
    empty = F.array().cast(rows.schema[pages].dataType)
    return rows.withColumn(pages, F.sort_array(F.array_distinct(F.coalesce(pages, empty)))).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def text_report(rows: DataFrame, outputs: DataFrame, heading: dict[str, str], title: str = "Remaining documents report") -> DataFrame:
    """(section, part, key, line): the report's lines, which stand in the order of the first three columns.

    Section 0 is the heading with the counts; then come the inputs and the outputs by status, each section with
    its title (part 0), its rows by rel_path (part 1; "(none)" without rows) and an empty line (part 2).
    """
    spark = rows.sparkSession
    top = [title, "=" * 48, *(f"{k}: {v}" for k, v in heading.items()), ""]
    fixed = [(0, 0, f"{i:02d}", line) for i, line in enumerate(top)] + [(0, 2, "", "")]
    for i, (name, _) in enumerate((*SECTIONS, *OUTPUT_SECTIONS), 1):
        fixed += [(i, 0, "", f"--- {name} ---"), (i, 2, "", "")]
    schema = "section int, part int, key string, line string"
    status = F.col("status")
    one = lambda c: F.count(F.when(c, 1))
    n = rows.agg(F.count(F.lit(1)).alias("a"), one(status.isin(*DONE, "SHARED_OUTPUT")).alias("b"), one(status.isin(*REMAINING)).alias("c"), one(status == "SHARED_OUTPUT").alias("d"))
    counted = [("Input PDFs", "a"), ("Done", "b"), ("Remaining", "c"), ("Shared/merged", "d")]
    line = lambda key, label, c: F.struct(F.lit(0).alias("section"), F.lit(1).alias("part"), F.lit(key).alias("key"), F.concat(F.lit(f"{label}: "), F.col(c).cast("string")).alias("line"))
    counts = n.select(F.inline(F.array(*(line(f"{i}", label, c) for i, (label, c) in enumerate(counted)))))
    orphans = outputs.agg(one(status == "ORPHAN_OUTPUT").alias("o")).select(F.inline(F.array(line("4", "Orphan outputs", "o"))))

    score = shown_score(F.col("score"))
    suffix = F.when(_or_empty("output_match") != "", F.concat(F.lit(" -> "), "output_match")).otherwise("")
    text = F.concat(F.format_string("  %-34s ", "status"), _or_empty("rel_path"), suffix, F.when(score != "", F.concat(F.lit(" ["), score, F.lit("]"))).otherwise(""), F.lit("  ("), _or_empty("reason"), F.lit(")"))
    section = F.coalesce(*(F.when(status.isin(*members), i) for i, (_, members) in enumerate(SECTIONS, 1)))
    listed = rows.select(section.alias("section"), F.lit(1).alias("part"), _or_empty("rel_path").alias("key"), text.alias("line"))
    section = F.coalesce(*(F.when(status == member, i) for i, (_, member) in enumerate(OUTPUT_SECTIONS, len(SECTIONS) + 1)))
    text = F.concat(F.lit("  "), _or_empty("rel_path"), F.lit("  ("), _or_empty("reason"), F.lit(")"))
    listed = listed.union(outputs.select(section, F.lit(1), _or_empty("rel_path"), text)).filter("section is not null")
    none = spark.createDataFrame([(i, 1, "", "  (none)") for i in range(1, len(SECTIONS) + len(OUTPUT_SECTIONS) + 1)], schema)
    none = none.join(listed.select("section").distinct(), "section", "left_anti")
    return spark.createDataFrame(fixed, schema).union(counts).union(orphans).union(listed).union(none.select("section", "part", "key", "line"))


def page_list(pages: Column) -> Column:
    """Page numbers in brackets; empty without any."""
    return F.when(F.size(pages) > 0, F.concat(F.lit("["), F.array_join(pages.cast("array<string>"), ", "), F.lit("]"))).otherwise("")


def rename_log(plan: DataFrame, docs: DataFrame, now: Column, root: str = "", include_date: bool = True) -> DataFrame:
    """Sixteen columns for every confirmed document: what it became, or the error that kept it from that.

    plan: as ``finalize_plan`` gives it; docs: doc_id, status, path, division, company, date, confidence, method,
    blank, docsep, n_pages.  A document without a confidence was confirmed by hand and has 100.
    """
    rows = docs.filter("status = 'confirmed'").join(plan.select("doc_id", "seq", "folder", "placed"), "doc_id", "left")
    placed = F.col("placed").isNotNull()
    pages = F.when(F.col("n_pages") > 0, F.sequence(F.lit(0), F.greatest(F.col("n_pages"), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    gone = lambda c: F.when(placed, F.greatest(F.size(F.array_intersect(c, pages)), F.lit(0))).otherwise(0)
    day = _or_empty(F.date_format("date", "yyyy-MM-dd"))
    error = F.when(F.trim(_or_empty("company")) == "", "error: no company").when(F.lit(include_date) & F.col("date").isNull(), "error: no date").otherwise("error: not placed")
    return rows.select(
        now.cast("string").alias("timestamp"), F.col("path").alias("original_path"), _or_empty("placed").alias("new_filename"),
        F.when(placed, F.concat_ws("/", F.nullif(F.lit(root), F.lit("")), F.nullif("folder", F.lit("")), "placed")).otherwise("").alias("new_path"),
        F.col("division").alias("division_code"), _or_empty("company").alias("company_name"), day.alias("document_date"),
        F.when(placed & F.lit(include_date), _or_empty(month_stamp(F.col("date")))).otherwise("").alias("yyyymm"), _or_empty(F.col("seq").cast("string")).alias("sequence_number"),
        F.coalesce("confidence", F.lit(100)).cast("int").alias("confidence"), _or_empty("method").alias("method"),
        page_list(F.col("blank")).alias("blank_pages"), gone("blank").alias("blank_removed"), page_list(F.col("docsep")).alias("docsep_pages"), gone("docsep").alias("docsep_removed"),
        F.when(placed, "copied").otherwise(error).alias("status"),
    )
