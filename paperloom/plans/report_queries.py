"""Queries over the reports, the date driver, the ladder of company tiers and the text readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import company_form, month_stamp
from ..operators import dates, reports, resolve
from ..sources import sinks, tables
from ..sources.shared import shared_folder
from ..sources.tables import roster, table
from .composite_queries import _confirmed, as_of
from .finalize import finalize_plan
from .registry import query

ROWS_SQL = """rows AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'DONE_TEXT_MATCH' WHEN 'P' THEN 'SHARED_OUTPUT' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'BORDERLINE' ELSE 'REMAINING_NO_OUTPUT' END END AS status,
 'd' || (o_custkey % 9) || '/' || o_orderkey || '.pdf' AS rel_path, CASE WHEN o_orderkey % 3 > 0 THEN 'out' || o_custkey || '.pdf' ELSE '' END AS output_match, CASE WHEN o_orderkey % 5 > 0 THEN (o_custkey % 11) / 10.0::DOUBLE END AS score, o_orderpriority AS reason FROM orders)"""
OUTPUTS_SQL = "outs AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ORPHAN_OUTPUT' WHEN 1 THEN 'RAW_COPY' ELSE 'MATCHED' END AS status, p_brand || '/' || p_partkey || '.pdf' AS rel_path, p_type AS reason FROM part)"
SCORE_TEXT = "CASE WHEN coalesce(score, 0) <> 0 THEN printf('%.3f', score) ELSE '' END"


def _rows(spark, d):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    rel = F.concat(F.lit("d"), (F.col("o_custkey") % 9).cast("string"), F.lit("/"), k.cast("string"), F.lit(".pdf"))
    state = F.when(status == "F", "DONE_TEXT_MATCH").when(status == "P", "SHARED_OUTPUT").when(k % 2 == 0, "BORDERLINE").otherwise("REMAINING_NO_OUTPUT")
    return table(spark, d, "orders").select(
        k, state.alias("status"), F.concat(F.lit("/data/in/"), rel).alias("path"), rel.alias("rel_path"), F.when(k % 3 > 0, F.concat(F.lit("out"), F.col("o_custkey").cast("string"), F.lit(".pdf"))).alias("output_match"),
        F.when(k % 5 > 0, (F.col("o_custkey") % 11) / 10).alias("score"), F.col("o_orderpriority").alias("reason"),
    )


def _outputs(spark, d):
    size = F.col("p_size") % 3
    return table(spark, d, "part").select(
        "p_partkey", F.when(size == 0, "ORPHAN_OUTPUT").when(size == 1, "RAW_COPY").otherwise("MATCHED").alias("status"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("rel_path"),
        F.when(size == 2, F.array(F.concat(F.lit("/in/a/"), "p_brand"), F.lit("/in/b.pdf"))).alias("matched_inputs"), F.col("p_type").alias("reason"),
    )


@query("k_remaining_table", f"WITH {ROWS_SQL} SELECT status, o_orderkey || '.pdf' AS input_file, rel_path, output_match, {SCORE_TEXT} AS score, reason FROM rows")
def k_remaining_table(spark, d):
    return reports.remaining_table(_rows(spark, d))


@query("k_output_files", f"WITH {OUTPUTS_SQL} SELECT status, p_partkey || '.pdf' AS output_file, rel_path, CASE WHEN status = 'MATCHED' THEN split_part(rel_path, '/', 1) || '; b.pdf' ELSE '' END AS matched_inputs, reason FROM outs")
def k_output_files(spark, d):
    return reports.outputs_table(_outputs(spark, d))


@query("k_text_report", f"""WITH {ROWS_SQL}, {OUTPUTS_SQL},
heads AS (SELECT * FROM (VALUES (1, 'REMAINING - scan these'), (2, 'SHARED / MERGED - done, verify'), (3, 'DONE'), (4, 'ORPHAN OUTPUTS - no input matched'), (5, 'RAW COPIES - present in output but not finalized')) AS h(section, name)),
listed AS (SELECT CASE status WHEN 'DONE_TEXT_MATCH' THEN 3 WHEN 'SHARED_OUTPUT' THEN 2 ELSE 1 END AS section, 1 AS part, rel_path AS key,
  '  ' || rpad(status, 34, ' ') || ' ' || rel_path || CASE WHEN output_match <> '' THEN ' -> ' || output_match ELSE '' END || CASE WHEN coalesce(score, 0) <> 0 THEN ' [' || {SCORE_TEXT} || ']' ELSE '' END || '  (' || reason || ')' AS line FROM rows
  UNION ALL SELECT CASE status WHEN 'ORPHAN_OUTPUT' THEN 4 ELSE 5 END, 1, rel_path, '  ' || rel_path || '  (' || reason || ')' FROM outs WHERE status <> 'MATCHED')
SELECT * FROM listed UNION ALL SELECT section, 1, '', '  (none)' FROM heads WHERE section NOT IN (SELECT section FROM listed)
UNION ALL SELECT section, 0, '', '--- ' || name || ' ---' FROM heads UNION ALL SELECT section, 2, '', '' FROM heads
UNION ALL SELECT * FROM (VALUES (0, 0, '00', 'Remaining documents report'), (0, 0, '01', repeat('=', 48)), (0, 0, '02', 'Input: /data/in'), (0, 0, '03', ''), (0, 2, '', ''))
UNION ALL SELECT 0, 1, '0', 'Input PDFs: ' || count(*) FROM rows UNION ALL SELECT 0, 1, '1', 'Done: ' || count(*) FROM rows WHERE status IN ('DONE_TEXT_MATCH', 'SHARED_OUTPUT')
UNION ALL SELECT 0, 1, '2', 'Remaining: ' || count(*) FROM rows WHERE status IN ('BORDERLINE', 'REMAINING_NO_OUTPUT') UNION ALL SELECT 0, 1, '3', 'Shared/merged: ' || count(*) FROM rows WHERE status = 'SHARED_OUTPUT'
UNION ALL SELECT 0, 1, '4', 'Orphan outputs: ' || count(*) FROM outs WHERE status = 'ORPHAN_OUTPUT'""")
def k_text_report(spark, d):
    return reports.text_report(_rows(spark, d), _outputs(spark, d), {"Input": "/data/in"})


@query("k_json_rows", "SELECT '{\"doc_id\":' || l_orderkey || ',\"status\":null,\"matched_output_pages\":[' || string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) || ']}' AS json FROM lineitem GROUP BY l_orderkey")
def k_json_rows(spark, d):
    pages = F.collect_list("l_linenumber").alias("matched_output_pages")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.lit(None).cast("string").alias("status"), pages)
    return reports.json_rows(rows)


@query("k_rename_log", """WITH q AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate::DATE END AS day, (o_custkey % 25)::VARCHAR AS div, o_orderpriority AS company, 'd' || (o_custkey % 40) AS folder, o_orderkey % 6 AS n, o_orderkey % 11 > 0 AS ok FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, ok ORDER BY doc_id) AS seq FROM q),
s AS (SELECT *, upper(lpad(seq::VARCHAR, 4, '0') || '_' || lpad(div, 3, '0') || '_' || company) || '.pdf' AS placed FROM r)
SELECT '2024-01-02' AS timestamp, 'p' || doc_id AS original_path, CASE WHEN ok THEN placed ELSE '' END AS new_filename, CASE WHEN ok THEN 'out/' || folder || '/' || placed ELSE '' END AS new_path, div AS division_code, CASE WHEN ok THEN company ELSE '' END AS company_name,
 coalesce(strftime(day, '%Y-%m-%d'), '') AS document_date, CASE WHEN ok THEN coalesce(strftime(day, '%Y%m'), '') ELSE '' END AS yyyymm, CASE WHEN ok THEN seq::VARCHAR ELSE '' END AS sequence_number, CASE WHEN doc_id % 2 = 0 THEN 100 ELSE 70 END AS confidence, 'scored' AS method,
 '[1]' AS blank_pages, CASE WHEN ok AND n > 1 THEN 1 ELSE 0 END AS blank_removed, '[0, 3]' AS docsep_pages, CASE WHEN ok THEN (n > 0)::INTEGER + (n > 3)::INTEGER ELSE 0 END AS docsep_removed, CASE WHEN ok THEN 'copied' ELSE 'error: no company' END AS status FROM s""")
def k_rename_log(spark, d):
    docs = _confirmed(spark, d)
    log = docs.withColumns({"path": F.concat(F.lit("p"), F.col("doc_id").cast("string")), "confidence": F.when(F.col("doc_id") % 2 == 1, 70), "method": F.lit("scored")})
    return reports.rename_log(finalize_plan(docs), log, F.lit("2024-01-02"), "out")


@query("f_month_stamp", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m') WHEN o_orderkey % 3 = 1 THEN '201907' ELSE '202401' END AS stamp FROM orders")
def f_month_stamp(spark, d):
    k = F.col("o_orderkey") % 3
    return table(spark, d, "orders").select("o_orderkey", month_stamp(F.when(k == 0, F.to_date("o_orderdate")), F.when(k == 1, "2019-07-03").otherwise("none"), F.lit("2024-01-31").cast("date")).alias("stamp"))


QUICK_SQL = """c AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_idx, l_shipdate::DATE AS date, 20 + 15 * (l_linenumber % 3) + l_quantity::DOUBLE * 0.3 + CASE WHEN l_linenumber % 2 = 0 THEN -35 ELSE 20 END
  + CASE WHEN l_returnflag = 'R' AND l_linenumber % 4 = 0 THEN 100 WHEN l_returnflag = 'R' THEN 80 WHEN l_linenumber % 4 = 0 THEN 90 ELSE 0 END AS score, l_returnflag = 'R' OR l_linenumber % 4 = 0 AS anchored FROM lineitem),
f AS (SELECT doc_id, page_idx, count(*) AS new FROM (SELECT doc_id, date, min(page_idx) AS page_idx FROM c GROUP BY 1, 2) GROUP BY 1, 2),
g AS (SELECT doc_id, page_idx, max(score) AS score, bool_or(anchored) AS anchored FROM c GROUP BY 1, 2),
quick AS (SELECT doc_id, page_idx, floor(least(max(score) OVER w + CASE WHEN sum(coalesce(new, 0)) OVER w <= 1 THEN 15 ELSE 0 END, 100))::INTEGER AS quick, anchored FROM g LEFT JOIN f USING (doc_id, page_idx) WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx))"""


def _quick(spark, d):
    n = F.col("l_linenumber")
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (n - 1).alias("page_idx"), F.lit(0).alias("ord"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("double").alias("conf"),
        F.slice(F.array(F.lit("date"), F.lit("ref")), F.lit(1), (n % 3).cast("int")).alias("keywords"), (n % 2 == 0).alias("ambiguous"), "l_returnflag",
    )
    control = c.filter("(page_idx + 1) % 4 = 0").select("doc_id", "page_idx", "date", F.lit(True).alias("confirmed"))
    return dates.quick_confidence(c, c, c.filter("l_returnflag = 'R'"), control)


@query("d_quick", f"WITH {QUICK_SQL} SELECT * FROM quick")
def d_quick(spark, d):
    return _quick(spark, d)


@query("d_quick_stop", f"WITH {QUICK_SQL} SELECT doc_id, min(page_idx) AS stop FROM quick WHERE page_idx >= 1 AND quick >= 85 AND anchored GROUP BY 1")
def d_quick_stop(spark, d):
    return dates.quick_stops(_quick(spark, d))


def _spread(spark, d):
    """Orders in as many parts as the session's shuffles have: what reads their texts is bound by the processor, and a small file is one part."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")


@query("d_label_text", "SELECT o_orderkey AS doc_id, 0 AS page_idx, o_orderdate::DATE AS date FROM orders")
def d_label_text(spark, d):
    """Labelled dates in words of their own, which only the text after the label gives."""
    line = F.split(F.concat(F.lit("Our Document Date: "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" thanks")), " ")
    words = _spread(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page_idx"), F.posexplode(line).alias("word_idx", "text"))
    return dates.labeled_dates(words.withColumns({"left": F.col("word_idx") * 50.0, "top": F.lit(20.0), "width": F.lit(40.0), "page_height": F.lit(800.0)}), as_of())


@query("d_document_dates", """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN DATE '2020-05-17' WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN DATE '2010-03-05' ELSE DATE '2015-01-02' END AS date,
 CASE WHEN o_orderkey % 4 = 0 THEN 95 ELSE 70 END AS confidence, CASE WHEN o_orderkey % 4 = 0 THEN 'routing_slip' ELSE 'scored' END AS method, o_orderkey % 4 = 2 AS needs_review FROM orders""")
def d_document_dates(spark, d):
    """Documents of three pages: a routing slip on a skipped page; one date; two equal ones; and a control number on the
    second page, after which the third is not read."""
    k = F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    first = F.when(k == 1, F.concat(F.lit("issued "), day, F.lit(" here"))).when(k == 2, "Letter of March 5, 2010 and one of April 6, 2011 follow").otherwise("On March 5, 2010 we wrote")
    second = F.when(k == 0, "Document Routing Slip x 2020-05-17 10:04:53").when(k == 3, "no 9002000777 dated 01/02/2015 2017-09-20 10:04:53")
    third = F.when(k == 3, "issued, dated and effective June 7, 2012")
    pages = _spread(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(first, second, third)).alias("page_idx", "page_text"))
    words = pages.filter("false").select("doc_id", "page_idx", F.lit(0).alias("word_idx"), F.lit("").alias("text"), *(F.lit(0.0).alias(c) for c in ("left", "top", "width", "page_height")))
    return dates.document_dates(pages, words, as_of(), skipped=pages.filter("doc_id % 4 = 0 and page_idx = 1"))


@query("d_skipped", "SELECT DISTINCT doc_id, NULL::DATE AS date, 0 AS confidence, 'skipped' AS method, false AS needs_review FROM documents")
def d_skipped(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.lit(0).alias("page_idx"), F.col("text").alias("page_text"))
    return dates.document_dates(pages, pages, as_of(), include_date=False)


@query("c_ladder", """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 < 3 THEN upper(p_name) || ' INS CORP' ELSE '' END AS name, CASE p_partkey % 4 WHEN 0 THEN 'caption' WHEN 1 THEN 'caption' WHEN 2 THEN 'routing_slip' ELSE 'unresolved' END AS tier,
 p_partkey % 4 = 0 AS cross_validated, CASE WHEN p_partkey % 4 < 3 THEN 100 ELSE 0 END AS confidence, CASE WHEN p_partkey % 4 < 3 THEN 'high' ELSE 'none' END AS label, p_partkey % 4 = 3 AS needs_review FROM part""")
def c_ladder(spark, d):
    """Captions on a later page with a case header beat other ones; some letters have a subject line only, or nothing."""
    k, name = F.col("p_partkey") % 4, F.concat("p_name", F.lit(" Insurance Corporation"))
    caption = F.concat(F.lit("Republic of the Philippines\nJ. Cruz, Complainant, -versus- "), name, F.lit(", Respondent.\n"))
    other = F.when(k < 2, "Someone Else versus Wrong Surety Company, and so on")
    subject = F.when(k.isin(0, 2), F.concat(F.lit("Subject: "), name, F.lit(", a claim\n")))
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.array(other, F.when(k < 2, caption), subject, F.lit("nothing here"))).alias("page_idx", "page_text"))
    return resolve.tier_ladder(pages, roster(spark, d).withColumn("entry", company_form(F.col("entry")))).drop("company_name")


@query("j_roster_import", "SELECT DISTINCT upper(p_name) || ' INS CORP' AS entry FROM part WHERE p_name >= 'm'")
def j_roster_import(spark, d):
    """Names from text files with a heading each, without those that the roster has."""
    path = f"{shared_folder(spark)}/paperloom/roster-{uuid.uuid4().hex}"
    names = table(spark, d, "part").select("p_name", "p_size", F.concat("p_name", F.lit(" Insurance Corporation")).alias("Customer Name"))
    sinks.export_csv(names.select("Customer Name", "p_size"), path)
    held = names.filter("p_name < 'm'").select(company_form(F.col("Customer Name")).alias("entry"))
    return tables.read_roster(spark, path, held)


@query("s_known_roster", "SELECT DISTINCT upper(p_name) || ' INS CORP' AS entry FROM part")
def s_known_roster(spark, d):
    """A roster in JSON files, one of each brand, that a user without one of their own starts from."""
    path = f"{shared_folder(spark)}/paperloom/known-{uuid.uuid4().hex}"
    names = table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.collect_set(F.concat(F.upper("p_name"), F.lit(" INS CORP")))).alias("value"))
    names.write.partitionBy("p_brand").text(path)
    return tables.read_known(spark, f"{path}-own", seed=path)
