"""Aggregations, windows and joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import match_form, words
from ..operators import layout, naming, qc, reconcile, reports, resolve, session, similarity
from ..sources.shared import written
from ..sources.tables import roster, table, text_pages
from .registry import query

# ---- aggregations -------------------------------------------------------------------------------

STATUS_SQL = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 45 THEN 'confirmed' WHEN l_returnflag = 'R' THEN 'error' WHEN l_tax > 0.07 THEN 'failed' ELSE 'flagged' END AS status FROM lineitem)"


def _status(spark, d):
    s = F.when(F.col("l_quantity") >= 45, "confirmed").when(F.col("l_returnflag") == "R", "error").when(F.col("l_tax") > 0.07, "failed").otherwise("flagged")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("status"))


@query("a_status_counts", f"SELECT status, count(*) AS n FROM {STATUS_SQL} GROUP BY status")
def a_status_counts(spark, d):
    return _status(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("a_distinct_companies", "SELECT s_nationkey, count(DISTINCT s_suppkey % 7) AS companies, count(*) AS docs FROM supplier GROUP BY s_nationkey")
def a_distinct_companies(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count_distinct(F.col("s_suppkey") % 7).alias("companies"), F.count(F.lit(1)).alias("docs"))


TOKENS_SQL = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))"


@query("a_doc_frequency", f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS token FROM documents) GROUP BY token")
def a_doc_frequency(spark, d):
    pages = similarity.tokenized(table(spark, d, "documents").select("doc_id", F.lit(0).alias("page_idx"), F.col("text").alias("page_text")), least=1)
    return similarity.document_frequency(pages)


QC_SQL = "(SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS page_idx, l_discount * 40 AS ink, (l_quantity::INTEGER % 4) * 90 AS angle, l_quantity * 2 AS conf FROM lineitem)"


def _qc_pages(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("page_idx"), (F.col("l_discount") * 40).alias("ink"), ((F.col("l_quantity").cast("int") % 4) * 90).alias("angle"), (F.col("l_quantity") * 2).alias("conf"))
    return rows.withColumn("q", qc.page_qc(F.col("ink"), F.col("angle"), F.col("conf"))).select("doc_id", "page_idx", "ink", "conf", "q.*")


@query("a_qc_rollup", f"""WITH p AS (SELECT *, ink < 1.5 AS blank, NOT ink < 1.5 AND angle <> 0 AND conf >= 65 AS turned FROM {QC_SQL})
SELECT doc_id, bool_or(blank) AS any_blank, bool_and(blank) AS all_blank, max(ink) AS max_ink, coalesce(arg_max(angle || 'deg', page_idx) FILTER (WHERE turned), 'none') AS rotation, min(conf) AS min_conf,
coalesce(string_agg('rotated ' || angle || 'deg', '; ' ORDER BY page_idx) FILTER (WHERE turned), '') AS reasons, CASE WHEN bool_or(turned) THEN 'failed' ELSE 'passed' END AS status FROM p GROUP BY doc_id""")
def a_qc_rollup(spark, d):
    return qc.document_qc(_qc_pages(spark, d))


@query("a_blank_summary", """WITH v AS (SELECT CASE WHEN c >= 3 AND ink > 2 THEN 'content' WHEN white >= 0.95 AND c = 0 AND ink < 1 THEN 'blank' WHEN white > 0.90 AND c <= 1 AND ink < 2 THEN 'blank' ELSE 'needs_review' END AS verdict FROM (SELECT l_linenumber - 1 AS c, l_discount * 50 AS ink, 1 - l_tax AS white FROM lineitem))
SELECT verdict, count(*) AS pages, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM v GROUP BY verdict""")
def a_blank_summary(spark, d):
    verdict = qc.blank_verdict(F.col("l_linenumber") - 1, F.col("l_discount") * 50, 1 - F.col("l_tax"))
    counts = table(spark, d, "lineitem").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("pages"))
    return counts.withColumn("percent", F.round(F.lit(100.0) * F.col("pages") / F.sum("pages").over(W.partitionBy()), 6))


@query("a_next_sequence", """SELECT o_custkey, coalesce(max(CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 10000 END), 0)::INTEGER + 1 AS next_seq FROM orders GROUP BY o_custkey""")
def a_next_sequence(spark, d):
    """Names without and with a month count, others do not."""
    k, seq = F.col("o_orderkey"), F.format_string("%04d", F.col("o_orderkey") % 10000)
    name = F.when(k % 3 == 0, F.concat(seq, F.lit("_001_X.pdf"))).when(k % 3 == 1, F.concat(F.lit("202001"), seq, F.lit("_001_X.pdf"))).otherwise(F.concat(F.lit("scan"), seq, F.lit("_001_X.pdf")))
    return naming.next_sequence(table(spark, d, "orders").select("o_custkey", name.alias("name")), ["o_custkey"])


@query("a_trimmed_mean", """WITH r AS (SELECT l_orderkey, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, round(avg(l_discount), 9) AS score FROM r WHERE rn <= ceil(n * 0.9::DOUBLE) GROUP BY l_orderkey""")
def a_trimmed_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(similarity.trimmed_mean(F.collect_list("l_discount")), 9).alias("score"))


@query("a_tree_group", "SELECT source AS division, lang AS company, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs FROM documents GROUP BY source, lang")
def a_tree_group(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("division"), F.col("lang").alias("company")).agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("docs"))


@query("a_date_dedupe", "SELECT user_id, ts::DATE AS day, max(value) AS best, arg_max(event_id, (value, -event_id)) AS event_id, count(*) AS seen FROM events GROUP BY user_id, ts::DATE")
def a_date_dedupe(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("best"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.count(F.lit(1)).alias("seen"))


# ---- windows ------------------------------------------------------------------------------------


@query("w_seq_global", "SELECT o_orderkey, 100 + row_number() OVER (ORDER BY CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey) - 1 AS seq FROM orders")
def w_seq_global(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("day"))
    return naming.numbered_globally(o, ["day", "o_orderkey"], 100).select("o_orderkey", "seq")


@query("w_seq_per_folder", "SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id)::INTEGER AS seq FROM documents")
def w_seq_per_folder(spark, d):
    return naming.numbered_per_group(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "seq")


@query("w_topk_badge", "SELECT * FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS badge, value >= 65 AS high FROM events) WHERE badge <= 4")
def w_topk_badge(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.row_number().over(w).alias("badge"))
    return e.filter("badge <= 4").withColumn("high", F.col("value") >= 65)


@query("w_top3_gap", """WITH b AS (SELECT user_id, ts::DATE AS day, max(value) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, day) AS rn, lead(score) OVER (PARTITION BY user_id ORDER BY score DESC, day) AS next FROM b)
SELECT user_id, rn::INTEGER AS rank, day, score, rn = 1 AND coalesce(score - next < 20, false) AS review FROM r WHERE rn <= 3""")
def w_top3_gap(spark, d):
    best = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("score"))
    w = W.partitionBy("user_id").orderBy(F.desc("score"), "day")
    r = best.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)}).filter("rank <= 3")
    return r.select("user_id", "rank", "day", "score", ((F.col("rank") == 1) & F.coalesce(F.col("score") - F.col("next") < 20, F.lit(False))).alias("review"))


PAGES_SQL = """pages_ AS (SELECT doc_id, (i - 1) // 10 AS page_idx, string_agg(line, chr(10) ORDER BY i) AS page_text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY 1, 2),
tok AS (SELECT doc_id, page_idx, list_distinct(regexp_extract_all(lower(page_text), '[a-z0-9]{4,}')) AS t FROM pages_ WHERE len(regexp_extract_all(lower(page_text), '[a-z0-9]{4,}')) > 0),
inp AS (SELECT * FROM tok WHERE len(t) >= 3 AND doc_id % 2 = 0), outp AS (SELECT * FROM tok WHERE doc_id % 2 = 1),
df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS token FROM outp) GROUP BY token),
rare AS (SELECT * FROM (SELECT doc_id, page_idx, token, df, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY df, token) AS rn FROM (SELECT doc_id, page_idx, unnest(t) AS token FROM inp) JOIN df USING (token)) WHERE rn <= 8)"""


def _sides(spark, d):
    pages = text_pages(table(spark, d, "documents"))
    return similarity.tokenized(pages.filter("doc_id % 2 = 0")), similarity.tokenized(pages.filter("doc_id % 2 = 1"), least=1)


@query("w_rare8", f"WITH {PAGES_SQL} SELECT doc_id, page_idx::INTEGER AS page_idx, token, df FROM rare")
def w_rare8(spark, d):
    a, b = _sides(spark, d)
    return similarity.rarest_tokens(a, similarity.document_frequency(b))


@query("w_collision_suffix", "SELECT o_orderkey, 'f' || o_custkey AS folder, CASE WHEN rn > 1 THEN p || '_' || (rn - 1) || '.pdf' ELSE p || '.pdf' END AS placed FROM (SELECT o_orderkey, o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders)")
def w_collision_suffix(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("folder"), F.concat("o_orderpriority", F.lit(".pdf")).alias("name"))
    return naming.without_collisions(o, "folder", "name", [F.col("o_orderkey")]).select("o_orderkey", "folder", "placed")


@query("w_dup_label", "SELECT p_partkey, p_name || CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN ' #' || row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) ELSE '' END AS label FROM part")
def w_dup_label(spark, d):
    n, r = F.count(F.lit(1)).over(W.partitionBy("p_name")), F.row_number().over(W.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.when(n > 1, F.concat("p_name", F.lit(" #"), r.cast("string"))).otherwise(F.col("p_name")).alias("label"))


def _boxes(spark, d):
    w = F.posexplode(F.split("line", " ")).alias("i", "text")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_idx"), F.posexplode(F.split("text", "\n")).alias("row", "line"))
    rows = rows.select("doc_id", "page_idx", "row", w)
    x = (F.col("i") * 60 + F.when(F.col("i") % 6 == 5, 40).otherwise(0)).cast("double")
    y = (F.col("row") * 14 + F.col("i") % 3).cast("double")
    return rows.select("doc_id", "page_idx", (F.col("row") * 100000 + F.col("i")).alias("word_idx"), "text", x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 11).alias("y1"), (F.col("i") % 100).cast("double").alias("conf"))


BOXES_SQL = """w AS (SELECT conv_id AS doc_id, turn AS page_idx, r - 1 AS row, i - 1 AS i, txt AS text FROM (SELECT conv_id, turn, r, unnest(string_split(line, ' ')) AS txt, generate_subscripts(string_split(line, ' '), 1) AS i FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS r FROM conversations))),
b AS (SELECT doc_id, page_idx, row * 100000 + i AS word_idx, text, (i * 60 + CASE WHEN i % 6 = 5 THEN 40 ELSE 0 END)::DOUBLE AS x0, (row * 14 + i % 3)::DOUBLE AS y0, (i % 100)::DOUBLE AS conf FROM w),
o AS (SELECT *, row_number() OVER v AS pos, lag(y0) OVER v AS py, lag(x0) OVER v + 50 AS px FROM b WINDOW v AS (PARTITION BY doc_id, page_idx ORDER BY round_even(y0 / 4.0, 0), x0, word_idx)),
n AS (SELECT *, sum(CASE WHEN coalesce(abs(y0 - py) <= 4 AND x0 - px <= 27.5, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_idx ORDER BY pos) AS line_no FROM o),
l AS (SELECT doc_id, page_idx, line_no, string_agg(text, ' ' ORDER BY pos) AS text, min(x0) AS x0, min(y0) AS y0, max(x0) + 50 AS x1, max(y0) + 11 AS y1, avg(conf) AS conf FROM n GROUP BY 1, 2, 3)"""


@query("w_line_segments", f"WITH {BOXES_SQL} SELECT doc_id, page_idx, line_no::BIGINT AS line_no, text, x0, y0, x1, y1, y1 - y0 AS height, round(conf, 9) AS conf FROM l")
def w_line_segments(spark, d):
    return layout.line_segments(_boxes(spark, d)).withColumn("conf", F.round("conf", 9))


@query("j_phrases", f"""WITH {BOXES_SQL}, q AS (SELECT *, y1 - y0 AS h, lead(text) OVER v AS nt, lead(x0) OVER v AS nx0, lead(y0) OVER v AS ny0, lead(x1) OVER v AS nx1, lead(y1) OVER v AS ny1 FROM l WINDOW v AS (PARTITION BY doc_id, page_idx ORDER BY line_no))
SELECT doc_id, page_idx, line_no::BIGINT * 2 AS ord, text, h AS height FROM q UNION ALL SELECT doc_id, page_idx, line_no::BIGINT * 2 + 1, text || ' ' || nt, ny1 - y0 FROM q WHERE ny0 - y1 BETWEEN 0 AND h * 1.5""")
def j_phrases(spark, d):
    return layout.phrases(layout.line_segments(_boxes(spark, d))).select("doc_id", "page_idx", "ord", "text", "height")


@query("w_heading_runs", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), f AS (SELECT doc_id, i, line, length(line) < 300 AS flag FROM l),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - sum(flag::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS isl FROM f), c AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, isl ORDER BY i) - 1) // 4 AS chunk FROM g WHERE flag)
SELECT doc_id, min(i)::INTEGER AS first_line, count(*) AS lines FROM c GROUP BY doc_id, isl, chunk""")
def w_heading_runs(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("flag", F.length("line") < 300)
    return layout.runs(lines, ["doc_id"], "i", "flag").groupBy("doc_id", "run").agg((F.min("i") + 1).alias("first_line"), F.count(F.lit(1)).alias("lines")).drop("run")


@query("u_page_offsets", "SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_offset FROM lineitem")
def u_page_offsets(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(w), F.lit(0)).alias("page_offset"))


# ---- joins --------------------------------------------------------------------------------------


def _hashed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("j_hash_raw_copy", """WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), i AS (SELECT *, count(*) OVER (PARTITION BY sha) AS copies FROM h WHERE doc_id % 2 = 0)
SELECT doc_id, copies, EXISTS (SELECT 1 FROM h WHERE h.doc_id % 2 = 1 AND h.sha = i.sha) AS raw_copy FROM i""")
def j_hash_raw_copy(spark, d):
    h = _hashed(spark, d)
    out = h.filter("doc_id % 2 = 1").select("sha").distinct().withColumn("raw", F.lit(True))
    copies = h.filter("doc_id % 2 = 0").withColumn("copies", F.count(F.lit(1)).over(W.partitionBy("sha")))
    return copies.join(out, "sha", "left").select("doc_id", "copies", F.coalesce("raw", F.lit(False)).alias("raw_copy"))


def _manifest_tables(spark, d):
    h = _hashed(spark, d).withColumn("path", F.concat(F.lit("in/"), F.col("doc_id").cast("string")))
    inputs = h.filter("doc_id % 2 = 0")
    # Every tenth document has entries by path (some twice, once without an output), others by hash alone.
    k = F.col("doc_id")
    entry = lambda rows, path, out, sha, name: rows.select(path.alias("path"), "sha", out.alias("out_path"), sha.alias("out_sha"), name.alias("out_name"))
    none, out = F.lit(None).cast("string"), F.concat(F.lit("out/"), k.cast("string"))
    manifest = entry(
        h.filter("doc_id % 6 = 0 or doc_id % 10 = 1"), F.when(k % 6 == 0, F.col("path")).otherwise("elsewhere"), out, F.when(k % 9 == 0, F.col("sha")), F.when(k % 15 == 0, F.concat(F.lit("n"), (k + 1).cast("string")))
    ).unionByName(entry(h.filter("doc_id % 18 = 0"), F.lit("copy"), F.lit("out/1"), none, F.lit("")))
    names = F.when(k % 3 == 0, F.concat(F.lit("n"), k.cast("string"))).otherwise("")
    there = h.filter("doc_id % 4 = 0 or doc_id % 2 = 1").select(out.alias("out_path"), F.when(k % 2 == 1, F.col("sha")).alias("sha"), names.alias("name"))
    return inputs, manifest, there


MANIFEST_SQL = """h AS (SELECT doc_id, sha256(text) AS sha, 'in/' || doc_id AS path FROM documents), i AS (SELECT * FROM h WHERE doc_id % 2 = 0),
there AS (SELECT 'out/' || doc_id AS out_path, CASE WHEN doc_id % 2 = 1 THEN sha END AS sha, CASE WHEN doc_id % 3 = 0 THEN 'n' || doc_id ELSE '' END AS name FROM h WHERE doc_id % 4 = 0 OR doc_id % 2 = 1),
e AS (SELECT CASE WHEN doc_id % 6 = 0 THEN path ELSE 'elsewhere' END AS path, sha, 'out/' || doc_id AS out_path, CASE WHEN doc_id % 9 = 0 THEN sha END AS out_sha, CASE WHEN doc_id % 15 = 0 THEN 'n' || (doc_id + 1) END AS out_name FROM h WHERE doc_id % 6 = 0 OR doc_id % 10 = 1
  UNION ALL SELECT 'copy', sha, 'out/1', NULL, '' FROM h WHERE doc_id % 18 = 0),
m AS (SELECT path, sha, out_path IN (SELECT out_path FROM there) OR (out_sha IS NOT NULL AND out_sha IN (SELECT sha FROM there WHERE sha IS NOT NULL)) OR (coalesce(out_name, '') <> '' AND out_name IN (SELECT name FROM there)) AS ok FROM e),
mv AS (SELECT i.doc_id, EXISTS (SELECT 1 FROM m WHERE m.path = i.path AND ok) OR (i.sha IS NOT NULL AND (SELECT count(*) FROM m WHERE m.sha = i.sha AND ok) >= (SELECT count(*) FROM i i2 WHERE i2.sha = i.sha)) AS valid,
  EXISTS (SELECT 1 FROM m WHERE NOT ok AND (m.path = i.path OR m.sha = i.sha)) AS missing FROM i),
mf AS (SELECT doc_id, valid OR missing AS in_manifest, valid FROM mv)"""


@query("j_manifest_guard", f"WITH {MANIFEST_SQL} SELECT * FROM mf")
def j_manifest_guard(spark, d):
    return reconcile.manifest_flags(*_manifest_tables(spark, d)).select("doc_id", "in_manifest", "valid")


@query("j_session_flags", "SELECT o_orderkey, o_orderstatus = 'F' AS reviewed, o_orderstatus = 'O' AND o_orderkey % 2 = 0 AS pending, o_orderkey % 5 = 0 AND o_orderstatus = 'P' AS auto FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 3 = 0)")
def j_session_flags(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    lists = {"reviewed": "o_orderstatus = 'F'", "pending": "o_orderstatus = 'O' and o_orderkey % 2 = 0", "auto": "o_orderkey % 5 = 0 and o_orderstatus = 'P'"}
    out = session.remaining(o, o.filter("o_orderstatus = 'F' and o_orderkey % 3 = 0"), "o_orderkey")
    for name, rule in lists.items():
        out = out.join(o.filter(rule).select("o_orderkey", F.lit(True).alias(name)), "o_orderkey", "left")
    return out.select("o_orderkey", *(F.coalesce(c, F.lit(False)).alias(c) for c in lists))


JACCARD_SQL = """fol AS (SELECT DISTINCT r.doc_id, token FROM rare r JOIN df USING (token) WHERE df.df <= (SELECT CASE WHEN count(DISTINCT doc_id) > 40 THEN greatest(20, floor(count(DISTINCT doc_id) / 5)) ELSE 0 END FROM outp)),
pairs AS (SELECT DISTINCT r.doc_id, p.doc_id AS out_id FROM fol r JOIN (SELECT DISTINCT doc_id, unnest(t) AS token FROM outp) p USING (token) UNION SELECT r.doc_id, p.doc_id FROM (SELECT DISTINCT doc_id FROM rare WHERE doc_id NOT IN (SELECT doc_id FROM fol)) r, (SELECT DISTINCT doc_id FROM outp) p),
s AS (SELECT a.doc_id, a.out_id, i.page_idx, o.page_idx AS op, len(list_intersect(i.t, o.t))::DOUBLE / len(list_distinct(list_concat(i.t, o.t))) AS s FROM pairs a JOIN inp i ON i.doc_id = a.doc_id JOIN outp o ON o.doc_id = a.out_id),
bp2 AS (SELECT doc_id, out_id, page_idx, max(s) AS s, arg_max(op, (s, -op)) AS op FROM s GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, out_id ORDER BY s DESC) AS rn, count(*) OVER (PARTITION BY doc_id, out_id) AS n FROM bp2),
tm AS (SELECT doc_id, out_id, round(avg(CASE WHEN s >= 0.75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS coverage, round(avg(s) FILTER (WHERE rn <= ceil(n * 0.9::DOUBLE)), 9) AS score, list_sort(list_distinct(list(op) FILTER (WHERE s >= 0.75))) AS pages FROM rk GROUP BY 1, 2 HAVING max(s) > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(coverage, 9) DESC, round(score, 9) DESC, out_id) AS rn FROM tm) WHERE rn = 1)"""


def _matches(spark, d, least):
    return similarity.text_matches(*_sides(spark, d), least=least)


@query("j_jaccard_rare", f"WITH {PAGES_SQL}, {JACCARD_SQL} SELECT doc_id, out_id, round(coverage, 9) AS coverage, round(score, 9) AS score FROM best")
def j_jaccard_rare(spark, d):
    return similarity.best_text_matches(*_sides(spark, d), least=0.0).select("doc_id", "out_id", "coverage", "score")


@query("j_page_argmax", f"WITH {PAGES_SQL}, {JACCARD_SQL} SELECT doc_id, out_id, coalesce(array_to_string(pages, ','), '') AS pages FROM tm WHERE score >= 0.5")
def j_page_argmax(spark, d):
    return _matches(spark, d, 0.5).select("doc_id", "out_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


BITS_SQL = "(SELECT vec_id AS id, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END::HUGEINT)), lambda a, b: a * 2 + b) AS bits FROM embeddings)"


@query("j_hamming64", f"SELECT a.id, b.id AS other_id, bit_count(xor(a.bits, b.bits))::INTEGER AS distance FROM {BITS_SQL} a JOIN {BITS_SQL} b ON a.id % 2 = 0 AND b.id % 2 = 1 AND bit_count(xor(a.bits, b.bits)) <= 16")
def j_hamming64(spark, d):
    bits = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), similarity.sign_bits(F.col("embedding")).alias("bits"))
    return similarity.near_bits(bits.filter("id % 2 = 0"), bits.filter("id % 2 = 1"), 16).select("id", "other_id", "distance")


@query("j_learned_hint", "SELECT c_custkey, n_name AS company FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j_learned_hint(spark, d):
    hints = table(spark, d, "nation").select(F.lit("folders").alias("kind"), F.col("n_nationkey").cast("string").alias("key"), F.lit("old").alias("company"), F.lit(0).alias("ord"))
    new = table(spark, d, "nation").select(F.lit("folders").alias("kind"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("company"), F.lit(1).alias("ord"))
    docs = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("key"))
    return docs.join(session.learned_hints(hints, new), "key").select("c_custkey", "company")


@query("j_upsert", """WITH o AS (SELECT c_custkey AS key, c_custkey - 1 AS pos, c_name AS v FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0), n AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, upper(c_mktsegment) AS v FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0)
SELECT coalesce(o.key, n.key) AS key, coalesce(o.pos, (SELECT max(pos) FROM o) + 1 + n.pos)::BIGINT AS pos, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.key = n.key""")
def j_upsert(spark, d):
    """Half of the table is old, half is new, and every sixth row is both."""
    c = table(spark, d, "customer")
    old = c.filter("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") - 1).alias("pos"), F.col("c_name").alias("v"))
    new = naming.numbered_globally(c.filter("c_custkey % 2 = 1 or c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.upper("c_mktsegment").alias("v")), ["key"], 0, "pos")
    return session.upsert(old, new, "key")


@query("j_roster_add", "SELECT entry FROM (SELECT DISTINCT upper(p_name) || ' INSURANCE CORPORATION' AS entry FROM part UNION SELECT DISTINCT upper(s_name) FROM supplier)")
def j_roster_add(spark, d):
    return session.roster_with(roster(spark, d), table(spark, d, "supplier").select(F.upper("s_name").alias("entry")))


@query("k_output_guard", "SELECT c_nationkey, total, done, CASE WHEN total = 0 THEN 'stop' WHEN total = done THEN 'ask_reprocess' WHEN done = 0 THEN 'fresh' ELSE 'ask_remaining' END AS decision FROM (SELECT c_nationkey, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 9000) AS done FROM customer GROUP BY c_nationkey)")
def k_output_guard(spark, d):
    return session.output_guard(table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_acctbal") > 9000).alias("done")))


def _session(spark, d):
    return table(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 14 == 0).alias("reviewed"), (F.col("doc_id") % 22 == 0).alias("pending"), (F.col("doc_id") % 26 == 0).alias("auto"))


def _report(spark, d, name=None):
    inputs, manifest, there = _manifest_tables(spark, d)
    a, b = _sides(spark, d)
    outputs = _hashed(spark, d).filter("doc_id % 2 = 1").select(F.col("doc_id").alias("out_id"), "sha", (F.col("doc_id") % 5 != 3).alias("final"))
    outputs = outputs if name is None else outputs.withColumn("name", name)
    return reconcile.report(inputs, outputs, _session(spark, d), manifest, a, b, there)


REPORT_SQL = f"""WITH {PAGES_SQL.replace('WHERE doc_id % 2 = 1)', 'WHERE doc_id % 2 = 1 AND doc_id % 5 <> 3)')}, {JACCARD_SQL}, {MANIFEST_SQL},
ses AS (SELECT doc_id, doc_id % 14 = 0 AS reviewed, doc_id % 22 = 0 AS pending, doc_id % 26 = 0 AS auto FROM documents WHERE doc_id % 2 = 0),
raw AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 2 = 1 AND doc_id % 5 = 3),
st AS (SELECT i.doc_id, b.out_id, b.score, b.pages, CASE WHEN reviewed THEN 'DONE_SESSION' WHEN in_manifest AND valid THEN 'DONE_MANIFEST' WHEN pending THEN 'REMAINING_PENDING' WHEN auto THEN 'REMAINING_AUTO' WHEN in_manifest THEN 'REMAINING_MANIFEST_MISSING_OUTPUT'
  WHEN coverage >= 0.80 AND score >= 0.85 THEN 'DONE_TEXT_MATCH' WHEN raw.sha IS NOT NULL THEN 'REMAINING_RAW_COPY' WHEN score >= 0.60 THEN 'BORDERLINE' WHEN i.doc_id NOT IN (SELECT doc_id FROM inp) THEN 'UNREADABLE' ELSE 'REMAINING_NO_OUTPUT' END AS status
  FROM i JOIN ses USING (doc_id) JOIN mf USING (doc_id) LEFT JOIN best b ON b.doc_id = i.doc_id LEFT JOIN raw ON raw.sha = i.sha),
mt AS (SELECT *, count(*) OVER (PARTITION BY out_id) AS n FROM st WHERE status = 'DONE_TEXT_MATCH'),
pg AS (SELECT doc_id, out_id, row_number() OVER (PARTITION BY out_id, page ORDER BY score DESC, k DESC, doc_id) AS rn FROM (SELECT doc_id, out_id, score, len(pages) AS k, unnest(pages) AS page FROM mt WHERE n > 1)),
kp AS (SELECT doc_id, out_id, coalesce(len(pages), 0) = 0 OR doc_id IN (SELECT doc_id FROM pg WHERE rn = 1 AND pg.out_id = mt.out_id) AS kept FROM mt WHERE n > 1),
rp AS (SELECT st.doc_id, CASE WHEN st.status IN ('DONE_TEXT_MATCH', 'BORDERLINE') THEN st.out_id END AS out_id, CASE WHEN kept IS NULL THEN status WHEN NOT kept THEN 'BORDERLINE' WHEN (SELECT count(*) FROM kp k2 WHERE k2.kept AND k2.out_id = st.out_id) > 1 THEN 'SHARED_OUTPUT' ELSE status END AS status FROM st LEFT JOIN kp USING (doc_id))"""


@query("r_statuses", REPORT_SQL + " SELECT status, count(*) AS inputs FROM rp GROUP BY status")
def r_statuses(spark, d):
    return _report(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("inputs"))


@query("r_report", REPORT_SQL + " SELECT doc_id, status, out_id FROM rp")
def r_report(spark, d):
    return _report(spark, d).select("doc_id", "status", "out_id")


@query("r_remaining", REPORT_SQL + " SELECT doc_id, status FROM rp WHERE status IN (" + ", ".join(f"'{x}'" for x in reconcile.REMAINING) + ")")
def r_remaining(spark, d):
    return _report(spark, d).filter(F.col("status").isin(*reconcile.REMAINING)).select("doc_id", "status")


@query("r_set_cover", f"""WITH {PAGES_SQL}, {JACCARD_SQL}, mt AS (SELECT * FROM tm WHERE round(coverage, 9) >= 0.8 AND round(score, 9) >= 0.85),
pg AS (SELECT doc_id, out_id, row_number() OVER (PARTITION BY out_id, page ORDER BY round(score, 9) DESC, k DESC, doc_id) AS rn FROM (SELECT doc_id, out_id, score, len(pages) AS k, unnest(pages) AS page FROM mt))
SELECT doc_id, out_id, coalesce(len(pages), 0) = 0 OR EXISTS (SELECT 1 FROM pg WHERE rn = 1 AND pg.doc_id = mt.doc_id AND pg.out_id = mt.out_id) AS kept FROM mt""")
def r_set_cover(spark, d):
    m = _matches(spark, d, 0.85).filter("coverage >= 0.8")
    return reconcile.covering_inputs(m)


OUTPUTS_SQL = """u AS (SELECT out_id, count(*) AS inputs FROM rp WHERE status IN ('DONE_TEXT_MATCH', 'SHARED_OUTPUT') GROUP BY out_id),
ou AS (SELECT h.doc_id AS out_id, h.doc_id % 5 <> 3 AS final, inputs, h.sha IN (SELECT sha FROM i WHERE sha IS NOT NULL) AS raw FROM h LEFT JOIN u ON u.out_id = h.doc_id WHERE h.doc_id % 2 = 1),
os AS (SELECT *, CASE WHEN final AND inputs > 1 THEN 'SHARED_OUTPUT' WHEN final AND inputs = 1 THEN 'MATCHED' WHEN NOT final AND raw THEN 'RAW_COPY' ELSE 'ORPHAN_OUTPUT' END AS status FROM ou)"""


def _output_statuses(spark, d, rows):
    outputs = _hashed(spark, d).filter("doc_id % 2 = 1").select(F.col("doc_id").alias("out_id"), "sha", (F.col("doc_id") % 5 != 3).alias("final"))
    return reconcile.output_statuses(outputs, rows, _hashed(spark, d).filter("doc_id % 2 = 0"))


@query("j_output_status", REPORT_SQL + f", {OUTPUTS_SQL} SELECT out_id, status, coalesce(inputs, 0) AS inputs FROM os")
def j_output_status(spark, d):
    return _output_statuses(spark, d, _report(spark, d)).select("out_id", "status", "inputs")


LINES_SQL = """nm AS (SELECT path, sha, coalesce(nullif(out_name, ''), out_path) AS n FROM e WHERE out_path IN (SELECT out_path FROM there) OR (out_sha IS NOT NULL AND out_sha IN (SELECT sha FROM there WHERE sha IS NOT NULL)) OR (coalesce(out_name, '') <> '' AND out_name IN (SELECT name FROM there))),
rs AS (SELECT rp.doc_id, rp.status, rp.out_id, st.score, st.status AS first, coverage, kept FROM rp JOIN st USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kp USING (doc_id)),
rd AS (SELECT doc_id, status, rs.doc_id || '.pdf' AS rel,
  CASE WHEN first = 'DONE_MANIFEST' THEN 1.0::DOUBLE WHEN first IN ('DONE_TEXT_MATCH', 'BORDERLINE') OR first IN ('REMAINING_RAW_COPY', 'REMAINING_NO_OUTPUT') AND coverage > 0 THEN round(score, 9) END AS score,
  CASE WHEN first = 'DONE_MANIFEST' THEN coalesce((SELECT min(n) FROM nm WHERE nm.path = 'in/' || doc_id), (SELECT min(n) FROM nm JOIN i ON nm.sha = i.sha WHERE i.doc_id = rs.doc_id)) WHEN out_id IS NOT NULL THEN 'o' || out_id || '.pdf' ELSE '' END AS match,
  CASE WHEN kept IS NOT NULL AND NOT kept THEN 'matches the same pages as another input; likely a duplicate page or shared template'
    WHEN status = 'SHARED_OUTPUT' THEN (SELECT count(*) FROM kp k2 WHERE k2.kept AND k2.out_id = rs.out_id) || ' inputs map to different pages of the same output; likely merged'
    WHEN first = 'DONE_TEXT_MATCH' THEN 'page fingerprint match (' || round_even(round(coverage, 9) * 100, 0)::BIGINT || '% of pages)' ELSE map {
    'DONE_SESSION': 'marked reviewed in saved session', 'DONE_MANIFEST': 'original SHA-256 is in rename_manifest.csv', 'REMAINING_PENDING': 'in saved session pending list', 'REMAINING_AUTO': 'auto-confirmed in session but not finalized',
    'REMAINING_MANIFEST_MISSING_OUTPUT': 'manifest entry exists but its output file is missing', 'REMAINING_RAW_COPY': 'output contains only an unrenamed copy of this file', 'BORDERLINE': 'weak match; verify before scanning',
    'UNREADABLE': 'no usable text layer or page images; cannot compare safely', 'REMAINING_NO_OUTPUT': 'no finalized output found'}[first] END AS reason FROM rs),
ls AS (SELECT CASE WHEN status IN ('DONE_SESSION', 'DONE_MANIFEST', 'DONE_TEXT_MATCH') THEN 3 WHEN status = 'SHARED_OUTPUT' THEN 2 ELSE 1 END AS section, 1 AS part, rel AS key,
  '  ' || rpad(status, 34, ' ') || ' ' || rel || CASE WHEN match <> '' THEN ' -> ' || match ELSE '' END || CASE WHEN coalesce(score, 0) <> 0 THEN ' [' || printf('%.3f', score) || ']' ELSE '' END || '  (' || reason || ')' AS line FROM rd
  UNION ALL SELECT CASE status WHEN 'ORPHAN_OUTPUT' THEN 4 ELSE 5 END, 1, 'o' || out_id || '.pdf', '  o' || out_id || '.pdf  (' || CASE WHEN status = 'RAW_COPY' THEN 'byte-identical to an input PDF; not finalized' WHEN final THEN 'no input matched this finalized file' ELSE 'unrecognized file in output' END || ')' FROM os WHERE status IN ('ORPHAN_OUTPUT', 'RAW_COPY')),
hd AS (SELECT * FROM (VALUES (1, 'REMAINING - scan these'), (2, 'SHARED / MERGED - done, verify'), (3, 'DONE'), (4, 'ORPHAN OUTPUTS - no input matched'), (5, 'RAW COPIES - present in output but not finalized')) AS t(section, name))"""


@query("r_text_report", REPORT_SQL + f""", {OUTPUTS_SQL}, {LINES_SQL}
SELECT * FROM ls UNION ALL SELECT section, 1, '', '  (none)' FROM hd WHERE section NOT IN (SELECT section FROM ls) UNION ALL SELECT section, 0, '', '--- ' || name || ' ---' FROM hd UNION ALL SELECT section, 2, '', '' FROM hd
UNION ALL SELECT * FROM (VALUES (0, 0, '00', 'Remaining documents report'), (0, 0, '01', repeat('=', 48)), (0, 0, '02', 'Input: in'), (0, 0, '03', ''), (0, 2, '', ''))
UNION ALL SELECT 0, 1, '0', 'Input PDFs: ' || count(*) FROM rd UNION ALL SELECT 0, 1, '1', 'Done: ' || count(*) FROM rd WHERE status LIKE 'DONE%' OR status = 'SHARED_OUTPUT'
UNION ALL SELECT 0, 1, '2', 'Remaining: ' || count(*) FROM rd WHERE NOT (status LIKE 'DONE%' OR status = 'SHARED_OUTPUT') UNION ALL SELECT 0, 1, '3', 'Shared/merged: ' || count(*) FROM rd WHERE status = 'SHARED_OUTPUT'
UNION ALL SELECT 0, 1, '4', 'Orphan outputs: ' || count(*) FROM os WHERE status = 'ORPHAN_OUTPUT'""")
def r_text_report(spark, d):
    """From the tables to the text: all inputs and outputs with their reasons."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"), F.lit(".pdf"))
    rows = written(_report(spark, d, name("o", "out_id")), "report-texts")
    outputs = _output_statuses(spark, d, rows).withColumn("rel_path", name("o", "out_id"))
    return reports.text_report(rows.withColumn("rel_path", name("", "doc_id")), written(outputs, "report-outputs"), {"Input": "in"})


# ---- fuzzy roster joins --------------------------------------------------------------------------


def _misspelt(spark, d):
    name = F.concat(F.initcap("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" Insurance Corp")).when(F.col("p_partkey") % 3 == 1, F.lit(" insurence corporation")).otherwise(F.lit(" Holdings")))
    return table(spark, d, "part").select("p_partkey", name.alias("name"))


@query("j_fuzzy_best")
def j_fuzzy_best(spark, d):
    rows = _misspelt(spark, d)
    return rows.join(resolve.roster_matches(rows, roster(spark, d)), "name").select("p_partkey", "entry", "score", "second")


@query("j_fuzzy_margin")
def j_fuzzy_margin(spark, d):
    """Names as a scan may have them (words turned round, or a letter lost) against the bare roster of all names."""
    own = F.upper("p_name")
    turned = F.array_join(F.reverse(F.split(own, " ")), " ")
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, turned).otherwise(F.substring(own, F.lit(2), F.length(own))).alias("name"))
    entries = roster(spark, d).withColumn("entry", F.regexp_replace("entry", " INSURANCE CORPORATION$", ""))
    return rows.join(resolve.margin_matches(resolve.roster_matches(rows, entries, normalize=False)), "name").select("p_partkey", "entry", "score")


@query("j_gazetteer", """WITH r AS (SELECT DISTINCT upper(p_name) AS entry FROM part), q AS (SELECT o_orderkey AS doc_id, upper(p_name) AS own, (SELECT upper(p_name) FROM part p2 WHERE p2.p_partkey = 1 + o_orderkey % 7) AS other FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
t AS (SELECT doc_id, own AS sender, split_part(own, ' ', 1) || ' body ' || split_part(own, ' ', 2) || ' ' || other AS body FROM q),
x AS (SELECT doc_id, entry, regexp_matches(' ' || sender || ' ', ' ' || split_part(entry, ' ', 1) || ' (.* )?' || split_part(entry, ' ', 2) || ' ') AS s, regexp_matches(' ' || body || ' ', ' ' || split_part(entry, ' ', 1) || ' (.* )?' || split_part(entry, ' ', 2) || ' ') AS b FROM t, r)
SELECT doc_id, entry, CASE WHEN s THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS weight FROM x WHERE s OR b""")
def j_gazetteer(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.upper("p_name").alias("entry")).distinct()
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey")).join(part.select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("own")), "l_partkey")
    other = part.filter("p_partkey <= 7").select(F.col("p_partkey").alias("o"), F.upper("p_name").alias("other"))
    rows = lines.withColumn("o", 1 + F.col("l_orderkey") % 7).join(other, "o").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    w = F.split("own", " ")
    texts = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("own").alias("sender"), F.concat_ws(" ", w[0], F.lit("body"), w[1], "other").alias("body"))
    return resolve.gazetteer(texts, names)
