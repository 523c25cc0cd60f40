"""Company and date extraction over composed letters, and their decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import dates, detectors, layout, resolve, session
from ..sources.shared import written
from ..sources.tables import LETTERS_SQL, composed, letter_rows, letters, roster, table
from .finalize import finalize_plan
from .registry import query
from .relational_queries import _boxes

def as_of():
    return F.make_date(F.lit(2030), F.lit(1), F.lit(1))


def _detect(spark, d, f):
    return letters(spark, d).select("doc_id", f(F.col("page_text")).alias("name"))


@query("c_caption", f"WITH {LETTERS_SQL} SELECT doc_id, p || ' INS CORP' AS name FROM letters")
def c_caption(spark, d):
    return _detect(spark, d, detectors.caption)


@query("c_caption_wide", f"WITH {LETTERS_SQL} SELECT doc_id, 'COMPLAINANT VERSUS ' || p || ' INS CORP' AS name FROM letters")
def c_caption_wide(spark, d):
    return _detect(spark, d, detectors.caption_wide)


@query("c_routing", f"WITH {LETTERS_SQL} SELECT doc_id, p || ' INS CO' AS name FROM letters")
def c_routing(spark, d):
    return _detect(spark, d, detectors.routing_slip)


@query("c_caption_keywords", f"WITH {LETTERS_SQL} SELECT doc_id, p || ' INS CORP' AS name FROM letters")
def c_caption_keywords(spark, d):
    """The letterhead's keyword is the first one before the respondent."""
    span = F.regexp_replace("page_text", r"(?s)^.*Complainant, versus", "versus")
    return letters(spark, d).select("doc_id", detectors.caption_keywords(span).alias("name"))


@query("c_header", f"WITH {LETTERS_SQL} SELECT doc_id, p || ' INS CORP' AS name FROM letters")
def c_header(spark, d):
    text = F.concat(F.lit("The President of the "), "company", F.lit(", Respondent"))
    return letters(spark, d).select("doc_id", detectors.header_corroborated(text).alias("name"))


@query("c_letterhead", f"WITH {LETTERS_SQL} SELECT doc_id, company || ' Makati City' AS name FROM letters")
def c_letterhead(spark, d):
    return detectors.letterheads(letters(spark, d)).select("doc_id", "name")


@query("c_signature", f"WITH {LETTERS_SQL} SELECT doc_id, company AS name FROM letters")
def c_signature(spark, d):
    return detectors.signatures(letters(spark, d)).select("doc_id", "name")


@query("c_sender_region", f"WITH {LETTERS_SQL} SELECT doc_id, company || ' Makati City Very truly yours,' || chr(10) || company || chr(10) || ' truly yours,' || chr(10) || company || chr(10) AS sender FROM letters")
def c_sender_region(spark, d):
    return detectors.sender_region(letters(spark, d)).select("doc_id", "sender")


@query("c_candidates", f"WITH {LETTERS_SQL}, c AS (SELECT unnest(['caption', 'caption', 'caption', 'routing_slip', 'letterhead', 'signature']) AS source, unnest([0.9, 0.9, 0.9, 0.8, 0.85, 0.8]::DOUBLE[]) AS weight) SELECT source, weight, count(*) AS n FROM letters, c GROUP BY source, weight")
def c_candidates(spark, d):
    return detectors.candidates(letters(spark, d)).groupBy("source", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("c_combine", f"WITH {LETTERS_SQL} SELECT doc_id, company AS company_name, 'high' AS label, true AS cross_validated, false AS needs_review FROM letters")
def c_combine(spark, d):
    docs = letters(spark, d)
    found = resolve.text_candidates(docs)
    out = resolve.combined(docs, found, resolve.roster_matches(found, roster(spark, d)))
    return out.select("doc_id", "company_name", "label", "cross_validated", "needs_review")


@query("c_resolve", f"WITH {LETTERS_SQL} SELECT doc_id, company AS company_name, 'high' AS label, true AS cross_validated, false AS needs_review FROM letters")
def c_resolve(spark, d):
    """All eight detectors over all letters, in folders named after their companies."""
    docs, names = composed(written(letter_rows(spark, d), "letter-rows")), roster(spark, d)
    folders = docs.select("doc_id", F.lit(0).alias("ord"), F.lower("company").alias("name"))
    hints = table(spark, d, "nation").select(F.lit("letterheads").alias("kind"), F.upper("n_name").alias("key"), F.upper("n_name").alias("company"))
    return resolve.resolved(docs, docs, names, folders, hints).select("doc_id", "company_name", "label", "cross_validated", "needs_review")


@query("c_layout_candidates")
def c_layout_candidates(spark, d):
    """The four best company phrases of each page by layout (C19)."""
    p = layout.phrases(layout.line_segments(_boxes(spark, d)))
    return layout.company_phrases(p.withColumn("text", F.concat("text", F.when(F.col("ord") % 7 == 0, " Insurance Corp").otherwise(""))), F.lit(792.0))


@query("c_folder_hint", "SELECT p_partkey, upper(p_name) || ' INSURANCE CORPORATION' AS name FROM part WHERE p_partkey % 2 = 0")
def c_folder_hint(spark, d):
    folders = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " insurance corporation").otherwise(" scans")).alias("name"))
    return resolve.folder_hints(folders, roster(spark, d)).select("p_partkey", "name")


FORMS_SQL = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%y') WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE strftime(o_orderdate, '%-d %b %Y') END AS matched, o_orderdate::DATE AS day FROM orders"


@query("f_date_parse", f"WITH f AS ({FORMS_SQL}) SELECT o_orderkey, matched, CASE WHEN o_orderkey % 4 = 1 AND day(day) <= 12 THEN make_date(year(day), day(day), month(day)) ELSE day END AS date, o_orderkey % 4 < 2 AND day(day) <= 12 AS ambiguous FROM f")
def f_date_parse(spark, d):
    day, form = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(form == 0, F.date_format(day, "MM/dd/yyyy")).when(form == 1, F.date_format(day, "dd-MM-yy")).when(form == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "d MMM yyyy"))
    m = table(spark, d, "orders").select("o_orderkey", text.alias("matched"))
    return m.withColumns({"date": dates.parsed_date(F.col("matched"), as_of()), "ambiguous": dates.ambiguous(F.col("matched"))})


CONTEXT_SQL = f"""{LETTERS_SQL}, x AS (SELECT doc_id, sent, strftime(sent, '%m/%d/%Y') AS m, trim(regexp_replace(page_text, '\\s+', ' ', 'g')) AS t FROM letters),
c AS (SELECT *, list_filter(['date', 'dated', 'as of', 'issued', 'effective', 'ref', 're:'], lambda k: contains(lower(right(split_part(t, m, 1), 100) || m || left(split_part(t, m, 2), 100)), k)) AS kw FROM x)"""


@query("d_candidates", f"WITH {CONTEXT_SQL} SELECT doc_id, m AS matched, sent AS date, array_to_string(kw, ',') AS keywords, day(sent) <= 12 AS ambiguous FROM c")
def d_candidates(spark, d):
    return dates.date_candidates(letters(spark, d), as_of()).select("doc_id", "matched", "date", F.array_join("keywords", ",").alias("keywords"), "ambiguous")


SLIP_SQL = "(SELECT o_orderkey, (o_orderdate + INTERVAL 20 YEAR)::DATE AS day FROM orders)"


@query("d_routing_date", f"SELECT o_orderkey, CASE WHEN year(day) >= 2017 THEN day END AS date, CASE WHEN year(day) >= 2017 THEN CASE o_orderkey % 5 WHEN 0 THEN 'routing_slip_mmdd' WHEN 1 THEN 'routing_slip_iso' WHEN 2 THEN 'routing_slip_date_only' WHEN 3 THEN 'routing_slip_corrupted' ELSE 'control_number' END END AS source FROM {SLIP_SQL}")
def d_routing_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date(F.add_months("o_orderdate", 240)).alias("day"))
    form, day = F.col("o_orderkey") % 5, F.col("day")
    text = (
        F.when(form == 0, F.concat(F.lit("Document Routing Slip x "), F.date_format(day, "MM/dd"), F.lit("!"), F.date_format(day, "yyyy"), F.lit(" y")))
        .when(form == 1, F.concat(F.lit("routing  slip "), F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:04:53")))
        .when(form == 2, F.concat(F.lit("Date Requested "), F.date_format(day, "yyyy-MM-dd"), F.lit(" by mail")))
        .when(form == 3, F.concat(F.lit("ROUTING SLIP W"), F.date_format(day, "yy-MM-dd"), F.lit(" z")))
        .otherwise(F.concat(F.lit("no 179002000123 on "), F.date_format(day, "MM/dd/yyyy")))
    )
    return o.select("o_orderkey", dates.routing_date(text, as_of()).alias("r")).select("o_orderkey", "r.date", "r.source")


def _scored(spark, d):
    c = dates.date_candidates(letters(spark, d), as_of()).withColumn("conf", F.lit(90.0))
    labeled = c.filter("doc_id % 3 = 0").select("doc_id", "page_idx", "date")
    control = c.filter("doc_id % 5 = 0").select("doc_id", "page_idx", F.when(F.col("doc_id") % 15 == 0, F.date_add("date", 1)).otherwise(F.col("date")).alias("date"), (F.col("doc_id") % 2 == 0).alias("confirmed"))
    return dates.scored(c, labeled, control)


SCORE_SQL = f"""{CONTEXT_SQL}, s AS (SELECT doc_id, sent, 20.0::DOUBLE + 15 * len(kw) + 27 + 15 + CASE WHEN day(sent) <= 12 THEN -35 ELSE 20 END + CASE WHEN doc_id % 15 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 90 ELSE 60 END WHEN doc_id % 3 = 0 THEN 80 ELSE 0 END AS score FROM c)"""


@query("d_scores", f"WITH {SCORE_SQL} SELECT doc_id, sent AS date, score FROM s")
def d_scores(spark, d):
    return _scored(spark, d).select("doc_id", "date", "score")


@query("d_final", f"WITH {SCORE_SQL} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN DATE '2020-05-17' ELSE sent END AS date, CASE WHEN doc_id % 7 = 0 THEN 95 ELSE floor(least(score, 70.0::DOUBLE))::INTEGER END AS confidence, CASE WHEN doc_id % 7 = 0 THEN 'routing_slip' ELSE 'scored' END AS method, doc_id % 7 > 0 AND doc_id % 15 = 0 AS needs_review FROM s")
def d_final(spark, d):
    docs = letters(spark, d)
    routing = docs.filter("doc_id % 7 = 0").select("doc_id", F.make_date(F.lit(2020), F.lit(5), F.lit(17)).alias("date"))
    return dates.decided(docs, _scored(spark, d), routing)


@query("d_stop_page", "WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_idx, max(l_quantity * 2) AS score, bool_or(l_returnflag = 'R') AS anchored FROM lineitem GROUP BY 1, 2), b AS (SELECT *, max(score) OVER (PARTITION BY doc_id ORDER BY page_idx) AS best FROM p) SELECT doc_id, min(page_idx) AS stop FROM b WHERE page_idx >= 1 AND best >= 85 AND anchored GROUP BY doc_id")
def d_stop_page(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_idx")).agg(F.max(F.col("l_quantity") * 2).alias("score"), F.bool_or(F.col("l_returnflag") == "R").alias("anchored"))
    return dates.stop_pages(p)


@query("d_control_anchor", f"SELECT o_orderkey, day AS date, o_orderkey % 2 = 0 AS confirmed FROM {SLIP_SQL}")
def d_control_anchor(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date(F.add_months("o_orderdate", 240)).alias("day"))
    text = F.concat(F.lit("ref 9002000777 dated "), F.date_format("day", "MM/dd/yyyy"), F.when(F.col("o_orderkey") % 2 == 0, " 2017-09-20 10:04:53").otherwise(" none"))
    return o.select("o_orderkey", dates.control_anchor(text, as_of()).alias("c")).select("o_orderkey", "c.date", "c.confirmed")


@query("d_labeled_dates", "SELECT o_orderkey AS doc_id, 0 AS page_idx, o_orderdate::DATE AS date FROM orders")
def d_labeled_dates(spark, d):
    o = table(spark, d, "orders")
    below = F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(300.0)
    word = lambda i, text, left, top: F.struct(F.lit(i).alias("word_idx"), text.alias("text"), F.lit(left).alias("left"), top.alias("top"))
    far = F.date_format(F.date_add("o_orderdate", 40), "MM/dd/yyyy")
    boxes = F.array(word(0, far, 10.0, F.lit(0.0)), word(1, F.lit("Document"), 10.0, F.lit(50.0)), word(2, F.lit("Date:"), 80.0, F.lit(50.0)), word(3, F.date_format("o_orderdate", "MM/dd/yyyy"), 200.0, F.lit(50.0) + below), word(4, far, 200.0, F.lit(500.0)))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page_idx"), F.explode(boxes).alias("w")).select("doc_id", "page_idx", "w.*", F.lit(40.0).alias("width"), F.lit(800.0).alias("page_height"))
    return dates.labeled_dates(rows, as_of())


@query("k_repair_session", "SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey::VARCHAR) FILTER (WHERE c_custkey % 3 > 0) AS processed FROM customer GROUP BY c_nationkey")
def k_repair_session(spark, d):
    """What a plan has done once the paths left over are taken out (per division)."""
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").cast("string").alias("path"), (F.col("c_custkey") % 3 == 0).alias("open"))
    done = session.remaining(c, c.filter("open").select("path"))
    return done.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("processed"))


@query("k_repaired_plan", "SELECT 'reprocess' AS mode, c_custkey::VARCHAR AS path, false AS processed FROM customer WHERE c_custkey % 5 IN (0, 2, 4) UNION ALL SELECT 'review', c_custkey::VARCHAR, c_custkey % 5 IN (1, 3) FROM customer")
def k_repaired_plan(spark, d):
    """What a session plans after a repair of either mode."""
    status = F.element_at(F.array(*map(F.lit, ("REMAINING_NO_OUTPUT", "DONE_TEXT_MATCH", "BORDERLINE", "SHARED_OUTPUT", "UNREADABLE"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    report = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), status.alias("status"))
    plans = [session.repaired_plan(report, m).select(F.lit(m).alias("mode"), "path", "processed") for m in ("reprocess", "review")]
    return plans[0].union(plans[1])


@query("k_repaired_documents", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'confirmed_docs' END AS list FROM orders WHERE o_orderkey % 3 = 0")
def k_repaired_documents(spark, d):
    """A session's documents after a repair that scans again: those that a scan lists are gone."""
    key = F.col("o_orderkey")
    which = F.when(key % 3 == 1, "all_flagged_docs").when(key % 3 == 2, "auto_confirmed_docs").when(F.col("o_orderstatus") != "O", "confirmed_docs")
    return session.repaired_documents(table(spark, d, "orders").select(key, which.alias("list")), "reprocess")


def _confirmed(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("flagged").alias("status"), F.when(key % 9 != 0, F.to_date("o_orderdate")).alias("date"),
        (F.col("o_custkey") % 25).cast("string").alias("division"), F.when(key % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("company"), F.concat(F.lit("d"), (F.col("o_custkey") % 40).cast("string")).alias("rel_dir"),
        (key % 6).cast("int").alias("n_pages"), F.array(F.lit(1)).alias("blank"), F.array(F.lit(0), F.lit(3)).alias("docsep"),
    )


@query("k_finalize_plan", """WITH q AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate::DATE END AS day, lpad((o_custkey % 25)::VARCHAR, 3, '0') AS div, o_orderpriority AS company, 'd' || (o_custkey % 40) AS folder, o_orderkey % 6 AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 11 > 0),
s AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY doc_id) AS seq FROM q)
SELECT doc_id, seq::INTEGER AS seq, folder, upper(lpad(seq::VARCHAR, 4, '0') || '_' || div || '_' || company) || '.pdf' AS placed, array_to_string(list_filter(range(0, n), lambda p: p NOT IN (0, 1, 3)), ',') AS kept_pages FROM s""")
def k_finalize_plan(spark, d):
    return finalize_plan(_confirmed(spark, d)).withColumn("kept_pages", F.array_join(F.col("kept_pages").cast("array<string>"), ","))


def _layout_sql(folder: str, seq: str, where: str, name: str) -> str:
    """The plan in one of the other layouts."""
    return f"""WITH q AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate::DATE END AS day, printf('%03d', o_custkey % 25) AS div, o_orderpriority AS company, o_orderkey % 6 AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 11 > 0),
s AS (SELECT *, {folder} AS folder, {seq} AS seq FROM q WHERE {where})
SELECT doc_id, seq::INTEGER AS seq, folder, upper({name}) || '.pdf' AS placed, array_to_string(list_filter(range(0, n), lambda p: p NOT IN (0, 1, 3)), ',') AS kept_pages FROM s"""


@query("k_finalize_flat", _layout_sql("''", "(SELECT max(c_custkey % 500) FROM customer) + row_number() OVER (ORDER BY day, doc_id)", "day IS NOT NULL", "strftime(day, '%Y%m') || printf('%04d', seq) || '_' || div || '_' || company"))
def k_finalize_flat(spark, d):
    """One folder, dates in the names; numbers go on after the files that are there, one for each customer."""
    there = table(spark, d, "customer").select(F.lit("").alias("folder"), F.format_string("%04d_001_OLD.pdf", F.col("c_custkey") % 500).alias("name"))
    plan = finalize_plan(_confirmed(spark, d), "flat", include_date=True, existing=there)
    return plan.withColumn("kept_pages", F.array_join(F.col("kept_pages").cast("array<string>"), ","))


@query("k_finalize_company", _layout_sql("div || '/' || company", "row_number() OVER (PARTITION BY div ORDER BY doc_id)", "true", "printf('%04d', seq) || '_' || div || '_' || company"))
def k_finalize_company(spark, d):
    """A folder for every division and company; without dates the order of the scan numbers each division."""
    plan = finalize_plan(_confirmed(spark, d), "company")
    return plan.withColumn("kept_pages", F.array_join(F.col("kept_pages").cast("array<string>"), ","))
