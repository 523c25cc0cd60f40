"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..sources.tables import kept_paths, table
from .registry import query

FORM_SQL = "trim(regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("p_division_code", "SELECT c_custkey, CASE WHEN regexp_matches(trim(raw), '^[0-9]+$') AND length(trim(raw)) < 3 THEN lpad(trim(raw), 3, '0') ELSE trim(raw) END AS division FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE ' ' || (c_nationkey * (1 + c_custkey % 300))::VARCHAR || ' ' END AS raw FROM customer)")
def p_division_code(spark, d):
    raw = F.when(F.col("c_custkey") % 7 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit(" "), (F.col("c_nationkey") * (1 + F.col("c_custkey") % 300)).cast("string"), F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", X.division_code(raw).alias("division"))


@query("p_sanitize", """SELECT p_partkey, regexp_replace(p_name || ':' || p_type || '/' || p_brand || '?*|<>"' || chr(92), '[<>:"/' || chr(92) || chr(92) || '|?*]', '_', 'g') AS safe FROM part""")
def p_sanitize(spark, d):
    raw = F.concat("p_name", F.lit(":"), "p_type", F.lit("/"), "p_brand", F.lit('?*|<>"\\'))
    return table(spark, d, "part").select("p_partkey", X.safe_filename(raw).alias("safe"))


NAMES_SQL = """(SELECT o_orderkey, o_orderkey % 12000 AS seq, lpad((o_custkey % 25)::VARCHAR, 3, '0') AS div, replace(o_orderpriority, '/', '_') AS company, strftime(o_orderdate, '%Y%m') AS ym FROM orders)"""


def _names(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", (F.col("o_orderkey") % 12000).alias("seq"), X.division_code((F.col("o_custkey") % 25).cast("string")).alias("div"), F.col("o_orderpriority").alias("company"), F.date_format("o_orderdate", "yyyyMM").alias("ym"))


@query("p_build_name", f"SELECT o_orderkey, upper(ym || CASE WHEN seq > 9999 THEN seq::VARCHAR ELSE lpad(seq::VARCHAR, 4, '0') END || '_' || div || '_' || company || '_x') || '.pdf' AS dated, CASE WHEN seq > 9999 THEN seq::VARCHAR ELSE lpad(seq::VARCHAR, 4, '0') END || '_' || div || '_' || company || '.pdf' AS plain FROM {NAMES_SQL}")
def p_build_name(spark, d):
    n = _names(spark, d)
    dated = X.final_filename(F.col("seq"), F.col("div"), F.col("company"), F.col("ym"), suffix=F.lit("_x"))
    plain = X.final_filename(F.col("seq"), F.col("div"), F.col("company"), F.col("ym"), include_date=False, uppercase=False)
    return n.select("o_orderkey", dated.alias("dated"), plain.alias("plain"))


@query("p_parse_stem", f"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ym || printf('%04d', seq) || '_' || div || '_' || company || '_B' WHEN 1 THEN lpad((seq % 10000)::VARCHAR, 4, '0') || '_' || div || '_' || company WHEN 2 THEN seq || '_' || div ELSE 'raw copy_' || div || '_' || company END AS stem FROM {NAMES_SQL}),
p AS (SELECT *, string_split(stem, '_') AS t FROM s)
SELECT o_orderkey, CASE WHEN ok THEN CASE WHEN length(t[1]) >= 10 THEN t[1][1:6] ELSE '' END END AS yyyymm, CASE WHEN ok THEN (CASE WHEN length(t[1]) >= 10 THEN t[1][7:] ELSE t[1] END)::INTEGER END AS seq, CASE WHEN ok THEN t[2] END AS division, CASE WHEN ok THEN array_to_string(t[3:], '_') END AS company
FROM (SELECT *, len(t) >= 3 AND regexp_matches(t[1], '^([0-9]{{10,}}|[0-9]{{4}})$') AS ok FROM p)""")
def p_parse_stem(spark, d):
    n = _names(spark, d)
    four = lambda c: F.format_string("%04d", c)
    k = F.col("o_orderkey") % 4
    stem = (
        F.when(k == 0, F.concat("ym", four(F.col("seq")), F.lit("_"), "div", F.lit("_"), "company", F.lit("_B")))
        .when(k == 1, F.concat(four(F.col("seq") % 10000), F.lit("_"), "div", F.lit("_"), "company"))
        .when(k == 2, F.concat(F.col("seq").cast("string"), F.lit("_"), "div"))
        .otherwise(F.concat(F.lit("raw copy_"), "div", F.lit("_"), "company"))
    )
    return n.select("o_orderkey", X.parsed_stem(stem).alias("p")).select("o_orderkey", "p.yyyymm", "p.seq", "p.division", "p.company")


@query("p_is_final", f"SELECT o_orderkey, regexp_matches(name, '^([0-9]{{6}})?[0-9]{{4}}_[^_]+_.+\\.pdf$', 'i') AS is_final FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ym ELSE '' END || lpad((seq % 10000)::VARCHAR, 4, '0') || CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '_' END || div || '_' || company || CASE WHEN o_orderkey % 7 = 0 THEN '.PDF' ELSE '.pdf' END AS name FROM {NAMES_SQL})")
def p_is_final(spark, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("out/"), F.when(k % 3 == 0, F.col("ym")).otherwise(""), F.format_string("%04d", F.col("seq") % 10000), F.when(k % 5 == 0, "-").otherwise("_"), "div", F.lit("_"), "company", F.when(k % 7 == 0, ".PDF").otherwise(".pdf"))
    return _names(spark, d).select("o_orderkey", X.is_final_name(name).alias("is_final"))


@query("p_path_division", """WITH s AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS rel FROM pages), p AS (SELECT page_id, string_split(rel, '/') AS t FROM s)
SELECT page_id, CASE WHEN len(t) >= 2 THEN t[1] ELSE '' END AS division, CASE WHEN len(t) >= 3 THEN array_to_string(t[2:len(t) - 1], '/') WHEN len(t) = 2 THEN t[1] ELSE 'All Documents' END AS company FROM p""")
def p_path_division(spark, d):
    rel = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, d, "pages").select("page_id", X.path_parts(rel).alias("p")).select("page_id", "p.division", "p.company")


@query("s_scan_pdfs_by_folder", """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'logs' WHEN doc_id % 13 = 0 THEN '.hidden' ELSE source END || '/' || lang AS rel_dir, n_chars FROM documents)
SELECT rel_dir, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM f WHERE rel_dir NOT LIKE 'logs/%' AND rel_dir NOT LIKE '.%' GROUP BY rel_dir""")
def s_scan_pdfs_by_folder(spark, d):
    k = F.col("doc_id")
    top = F.when(k % 11 == 0, "logs").when(k % 13 == 0, ".hidden").otherwise(F.col("source"))
    files = table(spark, d, "documents").select(F.concat_ws("/", top, F.col("lang"), F.concat(k.cast("string"), F.lit(".pdf"))).alias("rel_path"), "n_chars")
    return kept_paths(files).groupBy("rel_dir").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))


GATE_SQL = "SELECT l_orderkey, l_linenumber, (l_quantity * 2)::INTEGER AS conf, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_shipdate::DATE END AS day, l_discount < 0.08 AS qc, 80 + l_linenumber * 4 AS date_conf FROM lineitem"


@query("p_gate", f"SELECT l_orderkey, l_linenumber, qc AND conf >= 90 AND coalesce(day >= DATE '1996-01-01' AND day <= DATE '2000-12-31', false) AND date_conf >= 90 AS passed, qc AND conf >= 90 AS passed_undated FROM ({GATE_SQL})")
def p_gate(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).cast("int").alias("conf"), F.when(F.col("l_linenumber") != 3, F.to_date("l_shipdate")).alias("day"), (F.col("l_discount") < 0.08).alias("qc"), (80 + F.col("l_linenumber") * 4).alias("date_conf"))
    gate = lambda dates: X.auto_confirmed(F.col("qc"), F.col("conf"), F.col("day"), F.col("date_conf"), F.make_date(F.lit(2000), F.lit(12), F.lit(31)), 1996, dates)
    return rows.select("l_orderkey", "l_linenumber", gate(True).alias("passed"), gate(False).alias("passed_undated"))


@query("p_heading", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'en'),
h AS (SELECT doc_id, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3 AND (length(regexp_replace(line, '[^A-Z]', '', 'g')) / greatest(1, length(line)) >= 0.7 OR (regexp_matches(line, '[A-Z]') AND NOT regexp_matches(line, '[A-Za-z][A-Z]') AND NOT regexp_matches(line, '(^|[^A-Za-z])[a-z]'))) AS h FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE h) AS headings FROM h GROUP BY doc_id""")
def p_heading(spark, d):
    lines = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(X.is_heading(F.col("line"))).alias("headings"))


LOG_SQL = """(SELECT event_id, CASE event_type WHEN 'purchase' THEN '[AUTO] doc ' || user_id || '.pdf -> ' || strftime(ts, '%Y-%m-%d') || ' (' || (user_id % 100) || '%)' || CASE WHEN event_id % 2 = 0 THEN ' | ' || (event_id % 5) || ' blank' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ' | QC:Passed' ELSE ' | QC:FAIL ink' END
 WHEN 'view' THEN '[FLAGGED] doc ' || user_id || '.pdf (' || (user_id % 100) || '%)' WHEN 'error' THEN '[ERROR] doc ' || user_id || '.pdf: timeout: page ' || (event_id % 9) WHEN 'click' THEN '[BLANK] doc ' || user_id || '.pdf: ALL BLANK' ELSE 'heartbeat' END AS msg FROM events)"""


def _log(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    name = F.concat(F.lit("doc "), u.cast("string"), F.lit(".pdf"))
    share = F.concat(F.lit("("), (u % 100).cast("string"), F.lit("%)"))
    auto = F.concat(F.lit("[AUTO] "), name, F.lit(" -> "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" "), share, F.when(e % 2 == 0, F.concat(F.lit(" | "), (e % 5).cast("string"), F.lit(" blank"))).otherwise(""), F.when(e % 3 == 0, " | QC:Passed").otherwise(" | QC:FAIL ink"))
    msg = (
        F.when(F.col("event_type") == "purchase", auto)
        .when(F.col("event_type") == "view", F.concat(F.lit("[FLAGGED] "), name, F.lit(" "), share))
        .when(F.col("event_type") == "error", F.concat(F.lit("[ERROR] "), name, F.lit(": timeout: page "), (e % 9).cast("string")))
        .when(F.col("event_type") == "click", F.concat(F.lit("[BLANK] "), name, F.lit(": ALL BLANK")))
        .otherwise("heartbeat")
    )
    return table(spark, d, "events").select("event_id", msg.alias("msg"))


def parsed_log(log):
    """Activity-log messages -> status, filename, date, confidence, blanks, qc; other messages go."""
    msg = F.regexp_replace("msg", r" \| QC:.*$", "")
    status = F.regexp_extract("msg", r"\[(AUTO|FLAGGED|ERROR|BLANK|DOCSEP)\] ", 1)
    detail = F.regexp_replace(F.regexp_replace(msg, r"^.*?\[[A-Z]+\] ", ""), r" \| [^|]*$", "")
    blank = F.regexp_extract(msg, r" \| (.*?) blank", 1)
    named = log.withColumns({"status": status, "detail": detail, "blank": blank}).filter(F.col("status") != "")
    s = F.col("status")
    after = F.regexp_replace("detail", "^.*?: ", "")
    return named.select(
        "event_id",
        "status",
        F.when(s == "AUTO", F.regexp_replace("detail", " -> .*$", "")).when(s == "FLAGGED", F.regexp_replace("detail", r" \([^(]*$", "")).otherwise(F.regexp_replace("detail", ": .*$", "")).alias("filename"),
        F.when(s == "AUTO", F.regexp_extract("detail", r" -> (.*?)( \(|$)", 1)).otherwise("").alias("date"),
        F.when(s.isin("AUTO", "FLAGGED"), F.regexp_extract("detail", r".*\((.*?)\)", 1)).when(s.isin("ERROR", "DOCSEP"), after).otherwise("").alias("confidence"),
        F.when(s == "BLANK", F.when(after.contains("ALL BLANK"), "ALL").otherwise(after)).when(s.isin("AUTO", "FLAGGED"), F.col("blank")).otherwise("").alias("blanks"),
        F.when(F.col("msg").contains(" | QC:FAIL"), "FAIL").when(F.col("msg").contains(" | QC:Passed"), "OK").otherwise("").alias("qc"),
    )


@query("p_log_parse", f"""WITH m AS (SELECT event_id, msg, regexp_replace(msg, ' \\| QC:.*$', '') AS t, regexp_extract(msg, '\\[(AUTO|FLAGGED|ERROR|BLANK|DOCSEP)\\] ', 1) AS status FROM {LOG_SQL}),
p AS (SELECT *, regexp_replace(substr(t, strpos(t, '] ') + 2), ' \\| [^|]*$', '') AS dt FROM m WHERE status <> '')
SELECT event_id, status, CASE status WHEN 'AUTO' THEN split_part(dt, ' -> ', 1) WHEN 'FLAGGED' THEN regexp_replace(dt, ' \\([^(]*$', '') ELSE split_part(dt, ': ', 1) END AS filename,
CASE status WHEN 'AUTO' THEN split_part(split_part(dt, ' -> ', 2), ' (', 1) ELSE '' END AS date,
CASE WHEN status IN ('AUTO', 'FLAGGED') THEN split_part(split_part(dt, '(', 2), ')', 1) WHEN status = 'ERROR' THEN substr(dt, strpos(dt, ': ') + 2) ELSE '' END AS confidence,
CASE status WHEN 'BLANK' THEN 'ALL' WHEN 'AUTO' THEN regexp_extract(t, ' \\| (.*?) blank', 1) ELSE '' END AS blanks,
CASE WHEN msg LIKE '% | QC:FAIL%' THEN 'FAIL' WHEN msg LIKE '% | QC:Passed%' THEN 'OK' ELSE '' END AS qc FROM p""")
def p_log_parse(spark, d):
    return parsed_log(_log(spark, d))


@query("a_kpi_counters", f"SELECT regexp_extract(msg, '\\[(AUTO|FLAGGED|ERROR|BLANK|DOCSEP)\\] ', 1) AS status, count(*) AS n FROM {LOG_SQL} WHERE msg LIKE '[%' GROUP BY 1")
def a_kpi_counters(spark, d):
    return parsed_log(_log(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("f_version_compare", """WITH v AS (SELECT p_partkey, 'v' || (p_size % 3) || '.' || (p_size % 11) || '.' || (p_partkey % 13) AS remote, '1.' || (p_size % 11) || '.10' AS current FROM part),
a AS (SELECT *, list_transform(regexp_extract_all(remote, '[0-9]+'), lambda x: x::INTEGER) AS r, list_transform(regexp_extract_all(current, '[0-9]+'), lambda x: x::INTEGER) AS c FROM v) SELECT p_partkey, remote, current, r > c AS newer FROM a""")
def f_version_compare(spark, d):
    dot = F.lit(".")
    text = lambda c: c.cast("string")
    size, key = F.col("p_size"), F.col("p_partkey")
    v = table(spark, d, "part").select("p_partkey", F.concat(F.lit("v"), text(size % 3), dot, text(size % 11), dot, text(key % 13)).alias("remote"), F.concat(F.lit("1."), text(size % 11), F.lit(".10")).alias("current"))
    return v.withColumn("newer", X.version_parts(F.col("remote")) > X.version_parts(F.col("current")))


@query("f_company_form", "SELECT p_partkey, " + FORM_SQL.format("regexp_replace(regexp_replace(upper(n), '\\bCORPORATION\\b', 'CORP', 'g'), '\\bINSURANCE\\b', 'INS', 'g')") + " AS form, " + FORM_SQL.format("n") + " AS match_form FROM (SELECT p_partkey, '  ' || p_name || ', Insurance  Corporation (' || p_brand || ')' AS n FROM part)")
def f_company_form(spark, d):
    n = F.concat(F.lit("  "), "p_name", F.lit(", Insurance  Corporation ("), "p_brand", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", X.company_form(n).alias("form"), X.match_form(n).alias("match_form"))


@query("f_keyword_class", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' WHEN 2 THEN 'strong' ELSE 'none' END AS class FROM part")
def f_keyword_class(spark, d):
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, " health  care").when(k == 1, " Holdings").when(k == 2, " pre-need x").otherwise(" incorrect"))
    return table(spark, d, "part").select("p_partkey", X.keyword_class(name).alias("class"))


@query("f_context_keywords", """SELECT doc_id, array_to_string(list_filter(['date', 'dated', 'as of', 'issued', 'effective', 'ref', 're:'], lambda k: contains(lower(text), k)), ',') AS keywords FROM documents""")
def f_context_keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.context_keywords(F.col("text")), ",").alias("keywords"))


ORDER_SQL = """(SELECT p_partkey, range(0, p_size) AS o, p_partkey % 60 AS dragged, (p_partkey * 7) % 50 AS target, p_partkey % 2 = 0 AS after, p_size AS n FROM part)"""


@query("g_move_pages", f"""WITH r AS (SELECT *, list_filter(o, lambda x: x <> dragged) AS rest, CASE WHEN target < dragged THEN target ELSE target - 1 END + CASE WHEN after THEN 1 ELSE 0 END AS spot FROM {ORDER_SQL})
SELECT p_partkey, array_to_string(CASE WHEN dragged < n AND target < n AND dragged <> target THEN list_concat(list_concat(rest[1:spot], [dragged]), rest[spot + 1:]) ELSE o END, ',') AS new_order FROM r""")
def g_move_pages(spark, d):
    k = F.col("p_partkey")
    order = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda x: x)
    return table(spark, d, "part").select("p_partkey", order.alias("o"), (k % 60).cast("int").alias("dragged"), ((k * 7) % 50).cast("int").alias("target"), (k % 2 == 0).alias("after")).select("p_partkey", F.array_join(A.reordered(F.col("o"), F.col("dragged"), F.col("target"), F.col("after")).cast("array<string>"), ",").alias("new_order"))


@query("g_marker_remap", f"""SELECT p_partkey, array_to_string(list_sort(list_transform(list_filter([0, 3, 5], lambda m: m < n AND m % 2 = 1 OR m = 0 AND n > 0), lambda m: n - 1 - m)), ',') AS markers FROM {ORDER_SQL}""")
def g_marker_remap(spark, d):
    n = F.col("p_size")
    flipped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: n - 1 - i)
    return table(spark, d, "part").select("p_partkey", F.array_join(A.remapped(F.array(F.lit(0), F.lit(3), F.lit(5)), flipped).cast("array<string>"), ",").alias("markers"))


@query("g_mark_blank", """SELECT p_partkey, array_to_string(list_sort(list_distinct([1, 4, p])), ',') AS blank, array_to_string(list_filter([2, 4, 6], lambda x: x <> p), ',') AS docsep FROM (SELECT p_partkey, (p_partkey % 8)::INTEGER AS p FROM part)""")
def g_mark_blank(spark, d):
    ints = lambda *v: F.array(*map(F.lit, v))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    marks = A.marked_blank(ints(1, 4), ints(2, 4, 6), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, d, "part").select("p_partkey", marks.alias("m")).select("p_partkey", text(F.col("m.blank")).alias("blank"), text(F.col("m.docsep")).alias("docsep"))


@query("g_page_transfer", """SELECT p_partkey, n - len(t) AS left_pages, CASE WHEN n > len(t) THEN array_to_string(list_concat(list_concat(['b0', 'b1'][1:k], list_transform(t, lambda i: 'a' || i)), ['b0', 'b1'][k + 1:]), ',') END AS target FROM (SELECT p_partkey, p_size AS n, (p_partkey % 3)::INTEGER AS k, list_filter([0, 2, 4], lambda i: i < p_size) AS t FROM part)""")
def g_page_transfer(spark, d):
    """Pages 0, 2 and 4 of a document move into a two-page one, unless that would empty the source."""
    n, k = F.col("p_size"), (F.col("p_partkey") % 3).cast("int")
    pages = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("a"), i.cast("string")))
    at = F.array(F.lit(0), F.lit(2), F.lit(4))
    rows = table(spark, d, "part").select("p_partkey", A.taken(pages, at).alias("t"), A.without(pages, at).alias("w"), k.alias("k"))
    return rows.select("p_partkey", F.size("w").cast("long").alias("left_pages"), F.when(F.size("w") > 0, F.array_join(A.inserted(F.array(F.lit("b0"), F.lit("b1")), F.col("t"), F.col("k")), ",")).alias("target"))


@query("f_crop_map", """SELECT p_partkey, CASE WHEN w >= 2 AND h >= 2 THEN round(x0, 6) END AS x0, CASE WHEN w >= 2 AND h >= 2 THEN round(y0, 6) END AS y0, CASE WHEN w >= 2 AND h >= 2 THEN round(x0 + w, 6) END AS x1, CASE WHEN w >= 2 AND h >= 2 THEN round(y0 + h, 6) END AS y1 FROM (
SELECT p_partkey, CASE r WHEN 0 THEN u0 WHEN 1 THEN v0 WHEN 2 THEN 1 - u1 ELSE 1 - v1 END * 612 AS x0, CASE r WHEN 0 THEN v0 WHEN 1 THEN 1 - u1 WHEN 2 THEN 1 - v1 ELSE u0 END * 792 AS y0,
 CASE WHEN r IN (0, 2) THEN u1 - u0 ELSE v1 - v0 END * 612 AS w, CASE WHEN r IN (0, 2) THEN v1 - v0 ELSE u1 - u0 END * 792 AS h
FROM (SELECT p_partkey, (p_partkey % 4)::INTEGER AS r, 0.1::DOUBLE AS u0, least((greatest(p_size, 5) * 12)::DOUBLE, 500.0::DOUBLE) / 500 AS u1, 0.25::DOUBLE AS v0, 0.75::DOUBLE AS v1 FROM part))""")
def f_crop_map(spark, d):
    lit = lambda x: F.lit(float(x))
    rect = A.display_to_page(lit(612), lit(792), (F.col("p_partkey") % 4) * 90, lit(500), lit(400), lit(50), lit(100), (F.greatest("p_size", F.lit(5)) * 12).cast("double"), lit(300))
    rows = table(spark, d, "part").select("p_partkey", rect.alias("r"))
    return rows.select("p_partkey", *(F.round(f"r.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")))
