"""Queries over the review desk's operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import desk
from ..sources import box_cache
from ..sources.shared import shared_folder
from ..sources.tables import roster, table
from .registry import query


@query("p_pending", "SELECT o_orderkey FROM orders WHERE NOT coalesce(CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END, false)")
def p_pending(spark, d):
    reviewed = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return desk.pending(table(spark, d, "orders").withColumn("reviewed", reviewed)).select("o_orderkey")


@query("p_roster_search", "SELECT DISTINCT upper(p_name) || ' INSURANCE CORPORATION' AS entry FROM part WHERE contains(lower(p_name || ' insurance corporation'), 'an')")
def p_roster_search(spark, d):
    return desk.found_in_roster(roster(spark, d).select("entry"), "  AN ")


@query("j_roster_delete", "SELECT DISTINCT upper(p_name) || ' INSURANCE CORPORATION' AS entry FROM part WHERE p_name >= 'm'")
def j_roster_delete(spark, d):
    gone = table(spark, d, "part").filter("p_name < 'm'").select(F.concat(F.upper("p_name"), F.lit(" INSURANCE CORPORATION")).alias("entry"))
    return desk.roster_without(roster(spark, d).select("entry"), gone)


@query("o_first_failures", "SELECT * FROM (SELECT c_custkey AS ord, c_name || ': ' || c_mktsegment AS line FROM customer ORDER BY 1 LIMIT 20) UNION ALL SELECT max(c_custkey) + 1, '... and ' || (count(*) - 20) || ' more' FROM customer HAVING count(*) > 20")
def o_first_failures(spark, d):
    return desk.first_failures(table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("error")))


@query("o_max_pages", "SELECT l_orderkey AS doc_id, count(*) AS pages FROM lineitem WHERE l_linenumber - 1 < 3 GROUP BY 1")
def o_max_pages(spark, d):
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_idx"))
    return desk.first_pages(pages, 3).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))


@query("p_flagged", """SELECT o_orderkey AS doc_id, coalesce(c.n, 0) AS n, coalesce(c.matched, '') AS matched FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS matched FROM lineitem WHERE l_quantity > 25 GROUP BY 1) c ON l_orderkey = o_orderkey""")
def p_flagged(spark, d):
    c = table(spark, d, "lineitem").filter("l_quantity > 25").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("matched"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("confidence"), F.array("l_returnflag").alias("keywords")
    )
    out = desk.flagged(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), c)
    return out.select("doc_id", F.size("candidates").cast("long").alias("n"), F.array_join(F.transform("candidates", lambda x: x["matched"]), ",").alias("matched"))


@query("k_confirmed_rows", """SELECT o_clerk AS path, o_orderpriority AS division, o_comment AS company, o_clerk AS name, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate::DATE, '%Y-%m-%d') ELSE '' END AS detected_date,
 CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE (o_orderkey % 90)::INTEGER END AS confidence, CASE WHEN o_orderkey % 5 > 0 THEN 'ok' ELSE '' END AS qc_status, CASE WHEN o_orderkey % 5 > 0 THEN 'none' ELSE '' END AS qc_failure_reasons, o_orderkey % 5 > 0 AND o_orderkey % 2 = 0 AS qc_blank_detected
FROM (SELECT *, o_orderstatus AS o_comment FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate, 'p' || o_orderkey AS o_clerk FROM orders)) WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0""")
def k_confirmed_rows(spark, d):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("p"), k.cast("string"))
    qc = F.when(k % 5 > 0, F.struct(F.lit("ok").alias("status"), F.lit("none").alias("reasons"), (k % 2 == 0).alias("blank")))
    docs = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("flagged").alias("status"), path.alias("path"), path.alias("name"), F.col("o_orderpriority").alias("division"), F.col("o_orderstatus").alias("company"),
        F.when(k % 3 > 0, F.to_date("o_orderdate")).alias("date"), F.when(k % 4 > 0, (k % 90).cast("int")).alias("confidence"), qc.alias("qc"),
    )
    return desk.confirmed_rows(docs, True)


@query("t_scan_state", """SELECT p_brand, string_agg('in/' || p_partkey, ',' ORDER BY p_partkey DESC) AS plan, coalesce(string_agg('in/' || p_partkey, ',' ORDER BY 'in/' || p_partkey) FILTER (WHERE p_size % 3 = 0), '') AS processed FROM part GROUP BY p_brand""")
def t_scan_state(spark, d):
    p = table(spark, d, "part").select("p_brand", (-F.col("p_partkey")).alias("ord"), F.concat(F.lit("in/"), F.col("p_partkey").cast("string")).alias("path"), "p_size")
    out = desk.scan_state(p, p.filter("p_size % 3 = 0"), "p_brand")
    return out.select("p_brand", F.array_join("plan", ",").alias("plan"), F.array_join("processed", ",").alias("processed"))


@query("r_plan_for_run", "SELECT 'in/' || o_orderkey AS path, o_orderstatus IN ('F', 'P') AS existing FROM orders")
def r_plan_for_run(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "DONE_SESSION").when(F.col("o_orderstatus") == "P", "SHARED_OUTPUT").otherwise("BORDERLINE")
    return desk.plan_for_run(table(spark, d, "orders").select(F.concat(F.lit("in/"), F.col("o_orderkey").cast("string")).alias("path"), status.alias("status")))


@query("t_apply", "SELECT doc_id, text AS content, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || substr(sha1(source || '|' || lang), 1, 24) ELSE 'id' || doc_id END AS identity, NOT coalesce(CASE WHEN doc_id % 5 > 0 THEN doc_id % 2 = 0 END, false) AS pending FROM documents")
def t_apply(spark, d):
    k = F.col("doc_id")
    saved = table(spark, d, "documents").select(
        "doc_id", F.base64(F.encode("text", "UTF-8")).alias("content"), F.when(k % 3 == 0, F.when(k % 2 == 0, "")).otherwise(F.concat(F.lit("id"), k.cast("string"))).alias("identity"),
        F.col("source").alias("path"), F.col("lang").alias("name"), F.when(k % 5 > 0, k % 2 == 0).alias("reviewed"),
    )
    return desk.applied(saved).select("doc_id", F.decode("content", "UTF-8").alias("content"), "identity", "pending")


@query("t_serialize", "SELECT doc_id, '{' || CASE WHEN doc_id % 50 = 0 THEN '\"content\":\"' || to_base64(lang::BLOB) || '\",' ELSE '' END || '\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}' AS json FROM documents")
def t_serialize(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.encode("lang", "UTF-8").alias("content"))
    return desk.serialized(docs, F.col("doc_id") % 50 == 0)


@query("s_index_or_memory", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, lower(s_name) FROM supplier WHERE s_suppkey % 3 > 0")
def s_index_or_memory(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return desk.index_or_memory(s.filter("s_suppkey % 3 = 0"), s.withColumn("s_name", F.lower("s_name")), "s_suppkey")


@query("k_staged_paths", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'stage/scans/' || doc_id || '.pdf' ELSE 'stage/scans/' || source || '/' || doc_id || '.pdf' END AS staged FROM documents")
def k_staged_paths(spark, d):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/other/"), name)).otherwise(F.concat(F.lit("/data/scans/"), F.col("source"), F.lit("/"), name))
    return desk.staged_paths(table(spark, d, "documents").select("doc_id", path.alias("path")), "/data/scans/", "stage").select("doc_id", "staged")


@query("k_passed_paths", "SELECT o_orderkey AS doc_id, 'out/' || o_custkey || '/A_B/' || o_orderkey || '.pdf' AS source, 'out/passed/' || o_custkey || '/A/B/' || o_orderkey || '.pdf' AS target FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0")
def k_passed_paths(spark, d):
    k = F.col("o_orderkey")
    docs = table(spark, d, "orders").select(
        k.alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("flagged").alias("status"), F.col("o_custkey").cast("string").alias("division"), F.lit("A/B").alias("company"), F.lit("A_B").alias("folder"),
        F.when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".pdf"))).when(k % 3 == 2, F.concat(k.cast("string"), F.lit(".pdf"))).alias("final_name"),
    )
    return desk.passed_paths(docs, "out")


@query("a_next_number", "SELECT p_brand AS folder, '1' AS prefix, '.pdf' AS suffix, count(*) FILTER (WHERE starts_with(p_partkey::VARCHAR, '1')) + 1 AS number FROM part GROUP BY p_brand")
def a_next_number(spark, d):
    files = table(spark, d, "part").select(F.col("p_brand").alias("folder"), F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("name"))
    return desk.next_number(files, files.select("folder", F.lit("1").alias("prefix"), F.lit(".pdf").alias("suffix")).distinct())


@query("s_page_boxes", """SELECT source, count(*) AS boxes, round(sum(y0), 6) AS y FROM (
SELECT l_orderkey, 'cache' AS source, l_tax::DOUBLE AS y0 FROM lineitem WHERE l_orderkey % 3 = 0
UNION ALL SELECT l_orderkey, 'digital', l_quantity::DOUBLE FROM lineitem WHERE l_orderkey % 3 > 0 AND l_orderkey % 2 = 0 AND l_quantity <= 20
UNION ALL SELECT l_orderkey, 'scanned', l_quantity * 0.48::DOUBLE FROM lineitem WHERE l_orderkey % 3 > 0 AND NOT (l_orderkey % 2 = 0 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity <= 20)) AND l_discount * 1000 >= 20 AND l_quantity * 0.48::DOUBLE <= 20) GROUP BY source""")
def s_page_boxes(spark, d):
    li = table(spark, d, "lineitem")
    box = lambda rows, y, conf: rows.select(F.col("l_orderkey").cast("string").alias("sha"), F.lit(0).alias("page_idx"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("text"), *(F.col(y).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), conf.cast("double").alias("conf"))
    wanted = li.select(F.col("l_orderkey").cast("string").alias("sha"), F.lit(0).alias("page_idx"), F.lit(40.0).alias("height")).distinct()
    conf = F.col("l_discount") * 1000
    found = desk.page_boxes(wanted, box(li.filter("l_orderkey % 3 = 0"), "l_tax", F.lit(90)), box(li.filter("l_orderkey % 2 = 0"), "l_quantity", F.lit(5)), box(li, "l_quantity", conf), 0.5)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("boxes"), F.round(F.sum("y0"), 6).alias("y"))


BOX_CACHE_SQL = """WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity::DOUBLE AS q, l_discount * 1000 AS conf FROM lineitem),
d AS (SELECT DISTINCT k FROM b WHERE k % 2 = 0),
f AS (SELECT k, n, q, 'digital' AS source FROM b WHERE k % 2 = 0 UNION ALL SELECT k, n, q * 0.48::DOUBLE, 'scanned' FROM b WHERE k % 2 = 1 AND conf >= 20)
SELECT CASE WHEN k % 3 = 0 THEN 'cache' ELSE source END AS source, count(*) AS boxes, count(DISTINCT k) AS pages, round(sum(q), 6) AS y FROM f GROUP BY 1"""


@query("k_box_cache", BOX_CACHE_SQL)
def k_box_cache(spark, d):
    """A third of the pages is read first; when all are, these come from the cache and nothing of them is recognised again."""
    li = table(spark, d, "lineitem")
    box = lambda rows, conf: rows.select(F.col("l_orderkey").cast("string").alias("sha"), F.lit(0).alias("page_idx"), F.col("l_linenumber").cast("int").alias("ord"), F.col("l_returnflag").alias("text"), *(F.col("l_quantity").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), conf.cast("double").alias("conf"))
    wanted = li.select(F.col("l_orderkey").cast("string").alias("sha"), F.lit(0).alias("page_idx"), F.lit(40.0).alias("height")).distinct()
    digital, scanned = box(li.filter("l_orderkey % 2 = 0"), F.lit(5)), box(li, F.col("l_discount") * 1000)
    path = f"{shared_folder(spark)}/paperloom/box-cache-{uuid.uuid4().hex}"
    recognise = lambda pages: scanned.join(pages, ["sha", "page_idx"], "left_semi")
    box_cache.boxes_through_cache(path, wanted.filter("sha % 3 = 0"), digital, recognise)
    found = box_cache.boxes_through_cache(path, wanted, digital, recognise)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("boxes"), F.count_distinct("sha").alias("pages"), F.round(F.sum("y0"), 6).alias("y"))


@query("j_line_at", """WITH l AS (SELECT l_orderkey AS page, l_linenumber AS line_ord, 'line ' || l_linenumber AS text, l_linenumber * 10.0::DOUBLE AS x0, l_quantity::DOUBLE AS y0, l_linenumber * 10.0::DOUBLE + 30 AS x1, l_quantity::DOUBLE + 8 AS y1 FROM lineitem),
p AS (SELECT o_orderkey AS id, o_orderkey AS page, (o_custkey % 90)::DOUBLE AS px, (o_custkey % 50)::DOUBLE AS py FROM orders),
h AS (SELECT *, px BETWEEN x0 - 6 AND x1 + 6 AS inside, CASE WHEN px BETWEEN x0 AND x1 THEN 0 ELSE least(abs(px - x0), abs(px - x1)) END AS far FROM p JOIN l USING (page) WHERE py BETWEEN y0 - 6 AND y1 + 6)
SELECT id, text FROM (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY NOT inside, CASE WHEN inside THEN 0 ELSE far END, line_ord) AS rn FROM h) WHERE rn = 1""")
def j_line_at(spark, d):
    n, q = F.col("l_linenumber") * 10.0, F.col("l_quantity").cast("double")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_ord"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"), n.alias("x0"), q.alias("y0"), (n + 30).alias("x1"), (q + 8).alias("y1"))
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 90).cast("double").alias("px"), (F.col("o_custkey") % 50).cast("double").alias("py"))
    return desk.line_at(points, lines)


@query("a_reading_quality", "SELECT l_orderkey AS doc_id, 0 AS page_idx, round(coalesce(avg(c) FILTER (WHERE c > 0), 0), 9) AS mean_conf, count(*) FILTER (WHERE c > 0) AS n_words FROM (SELECT l_orderkey, l_discount::DOUBLE * 1000 - 20 AS c FROM lineitem) GROUP BY 1")
def a_reading_quality(spark, d):
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_idx"), (F.col("l_discount").cast("double") * 1000 - 20).alias("conf"))
    return desk.reading_quality(boxes).withColumn("mean_conf", F.round("mean_conf", 9))


@query("p_mirrored", "SELECT p_partkey, CASE WHEN p_size < 5 AND p_partkey % 9 < 5 THEN 'straight' WHEN p_partkey % 40 - p_size >= 15 THEN 'mirrored' WHEN p_partkey % 40 > p_size THEN 'review' ELSE 'straight' END AS verdict FROM part")
def p_mirrored(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", desk.mirrored(n.cast("double"), (k % 40).cast("double"), n, k % 9).alias("verdict"))


@query("g_unmark", "SELECT p_partkey, array_to_string(list_filter([0, 1, 2, 3], lambda x: x <> p_size % 5), ',') AS marks, CASE WHEN p_size % 4 IN (1, 3) THEN 792 ELSE 612 END AS width, CASE WHEN p_size % 4 IN (1, 3) THEN 612 ELSE 792 END AS height FROM part")
def g_unmark(spark, d):
    """Pages unmarked, and the size at which a page is shown."""
    marks = desk.unmarked(F.array(*map(F.lit, range(4))), (F.col("p_size") % 5).cast("int"))
    shown = desk.display_size(F.lit(612), F.lit(792), F.col("p_size") % 4 * 90)
    return table(spark, d, "part").select("p_partkey", F.array_join(marks.cast("array<string>"), ",").alias("marks"), shown.alias("s")).select("p_partkey", "marks", "s.width", "s.height")


@query("j_session_lists", "SELECT o_orderkey AS doc_id, o_orderkey % 7 = 0 AS reviewed, o_orderkey % 11 = 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 3 > 0) AS pending, o_orderkey % 13 = 0 AS auto FROM orders")
def j_session_lists(spark, d):
    """The lists of a saved session, with what its plan left open."""
    from ..operators.reconcile import session_flags

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("in/"), F.col("o_orderkey").cast("string")).alias("path"))
    part = lambda rule: o.filter(rule)
    return session_flags(o, part("doc_id % 7 = 0"), part("doc_id % 11 = 0"), part("doc_id % 13 = 0"), part("doc_id % 2 = 0"), part("doc_id % 3 = 0")).drop("planned")


@query("o_reviewed_order", "SELECT p_partkey, row_number() OVER (ORDER BY coalesce(nullif(p_brand, 'Brand#1'), ''), 'in/' || p_partkey) - 1 AS pos FROM part")
def o_reviewed_order(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#1")).alias("name"), F.concat(F.lit("in/"), F.col("p_partkey").cast("string")).alias("path"))
    return desk.reviewed_in_order(p).select("p_partkey", "pos")


@query("o_resumed_plan", "SELECT path, row_number() OVER (ORDER BY path) - 1 AS pos FROM (SELECT DISTINCT 'in/' || o_custkey AS path FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0))")
def o_resumed_plan(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("in/"), F.col("o_custkey").cast("string")).alias("path"))
    return desk.resumed_plan(o, o.filter("o_orderkey % 20 = 0"))
