"""Smaller operators: paths, predicates, counters, merges and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import images
from ..functions.text import ANY_KEYWORD_RE, STRONG_RE, company_form, is_regulator
from ..operators import desk, resolve, similarity
from ..sources import sinks
from ..sources.tables import roster, table
from .registry import query
from .relational_queries import STATUS_SQL, _misspelt, _status


@query("p_output_paths", "SELECT doc_id, source || ' output' AS output_root, source || ' output/' || lang AS mirrored FROM documents")
def p_output_paths(spark, d):
    """The sibling output root, and the input's folder rebuilt under it."""
    root = F.concat("source", F.lit(" output"))
    inside = F.concat_ws("/", "source", "lang")
    rel = F.expr("substring(__p, length(source) + 2)")
    return table(spark, d, "documents").withColumn("__p", inside).select("doc_id", root.alias("output_root"), F.concat_ws("/", root, rel).alias("mirrored"))


@query("p_valid_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN try_cast((1995 + o_orderkey % 4) || '-02-' || lpad((26 + o_orderkey % 5)::VARCHAR, 2, '0') AS DATE) END AS confirmed FROM orders")
def p_valid_date(spark, d):
    """Dates entered by hand; what is no date is ignored."""
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "not a date").otherwise(F.concat((1995 + k % 4).cast("string"), F.lit("-02-"), F.lpad((26 + k % 5).cast("string"), 2, "0")))
    return table(spark, d, "orders").select("o_orderkey", F.try_to_date(raw, "yyyy-MM-dd").alias("confirmed"))


@query("p_native_probe", "SELECT conv_id, sum(length(trim(text, ' ' || chr(10))))::BIGINT >= 40 AS has_text FROM conversations WHERE turn < 3 GROUP BY conv_id")
def p_native_probe(spark, d):
    """Whether the first three pages hold enough text to do without recognition."""
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_idx"), F.col("text").alias("page_text"))
    return desk.native_text(pages).withColumnRenamed("doc_id", "conv_id")


@query("p_blank_verified", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) >= 2)) < 2 AS blank FROM documents")
def p_blank_verified(spark, d):
    """A page with fewer than two words of two letters is really blank."""
    found = F.filter(F.split("text", r"\s+"), lambda w: F.length(w) >= 2)
    return table(spark, d, "documents").select("doc_id", (F.size(found) < 2).alias("blank"))


@query("p_rename_guard", "SELECT p_partkey, CASE WHEN contains(n, '/') THEN NULL WHEN lower(n) LIKE '%.pdf' THEN n ELSE n || '.pdf' END AS name, regexp_extract(n, '^[0-9]{8}') AS leading FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/' || p_name WHEN 1 THEN '20200117_' || p_name || '.PDF' ELSE p_name END AS n FROM part)")
def p_rename_guard(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("a/"), "p_name")).when(k == 1, F.concat(F.lit("20200117_"), "p_name", F.lit(".PDF"))).otherwise(F.col("p_name"))
    fixed = F.when(F.col("n").rlike(r"[/\\]"), None).when(F.lower("n").endswith(".pdf"), F.col("n")).otherwise(F.concat("n", F.lit(".pdf")))
    return table(spark, d, "part").select("p_partkey", raw.alias("n")).select("p_partkey", fixed.alias("name"), F.regexp_extract("n", "^[0-9]{8}", 0).alias("leading"))


@query("p_division_valid", "SELECT c_custkey, code <> '' AND NOT regexp_matches(code, '[<>:\"/|?*]') AS ok FROM (SELECT c_custkey, trim(CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'a:b' ELSE ' 12 ' END) AS code FROM customer)")
def p_division_valid(spark, d):
    code = F.trim(F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 3 == 1, "a:b").otherwise(" 12 "))
    return table(spark, d, "customer").select("c_custkey", ((code != "") & ~code.rlike(r'[<>:"/\\|?*]')).alias("ok"))


@query("p_regulators", "SELECT n_nationkey, n_nationkey % 2 = 0 AS regulator FROM nation")
def p_regulators(spark, d):
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, " Insurance-Commission").otherwise(" insurance co"))
    return table(spark, d, "nation").select("n_nationkey", is_regulator(name).alias("regulator"))


@query("f_drag_payload", "SELECT p_partkey, 'pane' || (p_partkey % 2) AS pane, array_to_string(list_sort(list_distinct([p_size, p_size // 2, 3])), ',') AS positions FROM part WHERE p_partkey % 5 > 0")
def f_drag_payload(spark, d):
    """prefix:pane:positions, positions as distinct ascending numbers; other strings give nothing."""
    half = F.floor(F.col("p_size") / 2)
    raw = F.when(F.col("p_partkey") % 5 == 0, "other").otherwise(F.concat(F.lit("pages:pane"), (F.col("p_partkey") % 2).cast("string"), F.lit(":"), F.concat_ws(",", F.col("p_size").cast("string"), half.cast("string"), F.lit(" 3 "))))
    parts = F.split("raw", ":", 3)
    numbers = F.transform(F.split(parts[2], ","), lambda x: F.trim(x).try_cast("int"))
    good = table(spark, d, "part").select("p_partkey", raw.alias("raw")).filter("raw rlike '^pages:[^:]+:'")
    return good.select("p_partkey", parts[1].alias("pane"), F.array_join(F.sort_array(F.array_distinct(numbers)).cast("array<string>"), ",").alias("positions"))


@query("f_doc_identity", "SELECT doc_id, 'doc-' || substr(sha1(source || '/' || lang || '|' || doc_id || '.pdf'), 1, 24) AS identity FROM documents")
def f_doc_identity(spark, d):
    """A stable id of a document: a prefix and 24 digits of the hash of its path and name."""
    seed = F.concat_ws("|", F.concat_ws("/", "source", "lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc-"), F.substring(F.sha1(seed), 1, 24)).alias("identity"))


@query("w_copy_name", "SELECT p_brand, 'scan(' || list_min(list_filter(range(1, 1000), lambda n: NOT list_contains(u, n))) || ').pdf' AS copy FROM (SELECT p_brand, list(DISTINCT p_size) AS u FROM part GROUP BY p_brand)")
def w_copy_name(spark, d):
    """The first free number for a copy's name."""
    used = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("u"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("u") + 1), F.col("u").cast("array<int>")))
    return used.select("p_brand", F.concat(F.lit("scan("), free.cast("string"), F.lit(").pdf")).alias("copy"))


@query("w_progress", "SELECT user_id, event_id, ((sum(round(value * 100)::BIGINT) OVER w * (count(*) OVER (PARTITION BY user_id) - row_number() OVER w)) // row_number() OVER w)::BIGINT AS eta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w_progress(spark, d):
    """Time left, in hundredths: the running mean times what remains."""
    by = W.partitionBy("user_id")
    w = by.orderBy("ts", "event_id")
    done, spent = F.row_number().over(w), F.sum(F.round(F.col("value") * 100).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))
    left = F.count(F.lit(1)).over(by) - done
    rows = table(spark, d, "events").select("user_id", "event_id", done.alias("done"), (spent * left).alias("x"))
    return rows.select("user_id", "event_id", F.expr("x div done").alias("eta"))


@query("w_first_caption", "SELECT l_orderkey, arg_max(l_linenumber, (s, -l_linenumber)) AS page FROM (SELECT l_orderkey, l_linenumber, 4 * max((l_quantity > 40)::INTEGER) + 2 * max((l_tax > 0.04)::INTEGER) + max((l_discount > 0.05)::INTEGER) AS s FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey")
def w_first_caption(spark, d):
    """The page with the most telling caption, the earliest among equals."""
    flag = lambda c: F.max(c.cast("int"))
    pages = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((flag(F.col("l_quantity") > 40) * 4 + flag(F.col("l_tax") > 0.04) * 2 + flag(F.col("l_discount") > 0.05)).alias("s"))
    return pages.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("s", -F.col("l_linenumber"))).alias("page"))


@query("g_merge_markers", "WITH o AS (SELECT p_brand, p_partkey, p_size, coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS skip FROM part) SELECT p_brand, string_agg((skip + m)::VARCHAR, ',' ORDER BY skip + m) AS blanks FROM (SELECT *, unnest([0, 2]) AS m FROM o) WHERE m < p_size GROUP BY p_brand")
def g_merge_markers(spark, d):
    """Documents merged in order: page marks move by the pages before them."""
    w = W.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(W.unboundedPreceding, -1)
    docs = table(spark, d, "part").select("p_brand", "p_size", F.coalesce(F.sum("p_size").over(w), F.lit(0)).alias("at"))
    marks = F.filter(F.array(F.lit(0), F.lit(2)), lambda m: m < F.col("p_size"))
    moved = docs.select("p_brand", "at", F.explode(marks).alias("m")).withColumn("page", F.col("at") + F.col("m"))
    return moved.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("page")).cast("array<string>"), ",").alias("blanks"))


@query("j_key_restore", "SELECT o.c_custkey, coalesce(n.c_name, o.c_mktsegment) AS bytes FROM customer o LEFT JOIN customer n ON n.c_custkey = o.c_custkey AND n.c_custkey % 4 = 0")
def j_key_restore(spark, d):
    """Pending contents carried over by key."""
    c = table(spark, d, "customer")
    kept = c.filter("c_custkey % 4 = 0").select("c_custkey", F.col("c_name").alias("kept"))
    return c.join(kept, "c_custkey", "left").select("c_custkey", F.coalesce("kept", "c_mktsegment").alias("bytes"))


@query("j_register_replace", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier WHERE s_suppkey % 3 = 0")
def j_register_replace(spark, d):
    """Finalized rows replace those of the same path."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    new = s.filter("s_suppkey % 3 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"))
    return s.join(new.select("s_suppkey"), "s_suppkey", "left_anti").unionByName(new)


@query("a_queue_counters", f"SELECT count(*) FILTER (WHERE status = 'flagged') AS pending, count(*) FILTER (WHERE status = 'confirmed') AS auto, count(*) FILTER (WHERE status IN ('error', 'failed')) AS failed FROM {STATUS_SQL}")
def a_queue_counters(spark, d):
    s = F.col("status")
    return _status(spark, d).agg(F.count_if(s == "flagged").alias("pending"), F.count_if(s == "confirmed").alias("auto"), F.count_if(s.isin("error", "failed")).alias("failed"))


@query("k_report_lines", f"SELECT 0 AS ord, printf('%-36s %8d', status, count(*)) AS line FROM {STATUS_SQL} GROUP BY status")
def k_report_lines(spark, d):
    return sinks.report_lines(_status(spark, d))


@query("k_json_report", "SELECT source, to_json(list_sort(list_distinct(list(lang))))::VARCHAR AS langs FROM documents GROUP BY source")
def k_json_report(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.to_json(F.sort_array(F.collect_set("lang"))).alias("langs"))


@query("k_max_files", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5 THEN 'planned' ELSE 'skipped' END AS state FROM documents")
def k_max_files(spark, d):
    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.when(n <= 5, "planned").otherwise("skipped").alias("state"))


@query("f_keyword_windows", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS windows FROM part")
def f_keyword_windows(spark, d):
    from ..operators.detectors import keyword_windows

    text = F.concat(F.lit("a letter about "), "p_name", F.when(F.col("p_partkey") % 2 == 0, " Mutual and others in town").otherwise(" and others"))
    return table(spark, d, "part").select("p_partkey", F.size(keyword_windows(text)).alias("windows"))


@query("c_tier_match")
def c_tier_match(spark, d):
    """Roster matches graded by the tier that named them (C8)."""
    names = _misspelt(spark, d).withColumn("tier", F.when(F.col("p_partkey") % 2 == 0, "caption").otherwise("full_keyword"))
    return resolve.tier_matches(names, resolve.roster_matches(names, roster(spark, d))).select("p_partkey", "tier", "company_name", "confidence", "label", "needs_review")


@query("j_roster_snap")
def j_roster_snap(spark, d):
    names = _misspelt(spark, d)
    return resolve.snapped(names, resolve.roster_matches(names, roster(spark, d))).select("p_partkey", "chosen")


@query("j_image_match")
def j_image_match(spark, d):
    """Image pages built from whole texts, as high as their length asks; copies of a text are copies of a page."""
    docs = table(spark, d, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("b"))
    height = F.greatest(F.lit(30), F.ceil(F.length("b") / 40)).cast("int")
    docs = docs.select("doc_id", F.lit(0).alias("page_idx"), F.lit(40).alias("width"), height.alias("height"), "b")
    pages = images.fingerprints(docs.withColumn("pixels", F.encode(F.rpad("b", F.col("height") * 40, F.lit("A")), "UTF-8")))
    a, b = pages.filter("doc_id % 2 = 0"), pages.filter("doc_id % 2 = 1")
    return similarity.best_image_matches(a, b).select("doc_id", "out_id", "ambiguous")


@query("f_forms_agree", "SELECT p_partkey, true AS strong, true AS any_keyword FROM part")
def f_forms_agree(spark, d):
    """A strong keyword survives the normal form."""
    form = company_form(F.concat("p_name", F.lit(" Insurance Company, Incorporated")))
    return table(spark, d, "part").select("p_partkey", form.rlike(STRONG_RE).alias("strong"), form.rlike(ANY_KEYWORD_RE).alias("any_keyword"))
