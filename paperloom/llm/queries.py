"""Thin queries over the operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn
from .chat_rotation import rotate_perspectives
from .common import table
from .filter_audit import audit_filters
from .mixing import mix_to_weights
from .ngram_join import jaccard_components
from .packing import pack_power_of_two
from .pii import surrogate_pii
from .quality_rules import quality_rules
from .secret_scan import scan_secrets
from .sharding import shard_documents
from .simhash_join import simhash_components
from .source_divergence import source_divergence
from .topk_nra import top_k


#: The setting that holds the key of the surrogates.
PII_KEY = "spark.paperloom.pii.key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates agree between runs with the same key; without one, a session draws its own."""
    if not spark.conf.get(PII_KEY, None):
        spark.conf.set(PII_KEY, secrets.token_hex(32))
    return surrogate_pii(table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY))


def op2_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = rotate_perspectives(table(spark, sf_dir, "conversations"))
    learned = F.transform(F.filter("segments", lambda s: s["mask"]), lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return rendered.select("conv_id", "participant", "part", "n_turns", "text", F.array_join(learned, ",").alias("loss_spans"))


def op4_shard_bfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score_quality(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))


def op6_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_power_of_two(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch")


def op7_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("novel").alias("n_novel"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op11_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_nra_top_k": op2_nra_top_k,
        "op3_perspectives": op3_perspectives,
        "op4_shard_bfd": op4_shard_bfd,
        "op5_byte_cnn": op5_byte_cnn,
        "op6_pack_binary": op6_pack_binary,
        "op7_mix_weights": op7_mix_weights,
        "op8_token_group_join": op8_token_group_join,
        "op9_robust_outliers": op9_robust_outliers,
        "op10_secret_scan": op10_secret_scan,
        "op11_simhash_grid": op11_simhash_grid,
        "op12_filter_audit": op12_filter_audit,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_nra_top_k": OP2_SQL,
        "op3_perspectives": OP3_SQL,
        "op7_mix_weights": OP7_SQL,
        "op12_filter_audit": OP12_SQL,
        "op13_source_divergence": OP13_SQL,
    }


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row AS asked, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row),
r AS (SELECT query_id, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3_SQL = """
WITH b AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) + coalesce(strlen(role), 0) + 64 AS cost FROM conversations),
t AS (
  SELECT conv_id, turn, role, text, digest,
    floor((sum(cost) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) - cost) / 16777216)::BIGINT AS part FROM b),
p AS (SELECT DISTINCT conv_id, role AS participant FROM conversations WHERE role <> 'system'),
g AS (
  SELECT p.participant, t.*, coalesce(t.role = p.participant, false) AS mask,
    CASE WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10) WHEN t.role = p.participant THEN '<|im_start|>assistant' || chr(10)
         ELSE '<|im_start|>user name=' || translate(replace(coalesce(t.role, 'unknown'), '<|', '< |'), chr(10) || chr(13), '  ') || chr(10) END AS head,
    replace(t.text, '<|', '< |') || '<|im_end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, part ORDER BY turn NULLS FIRST, role NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) AS upto FROM g)
SELECT conv_id, participant, part, count(*)::INTEGER AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, digest) AS text,
  coalesce(string_agg(CASE WHEN mask THEN (upto - 1 - length(body))::VARCHAR || ':' || (upto - 1)::VARCHAR END, ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, digest), '') AS loss_spans
FROM o GROUP BY conv_id, participant, part
"""

OP7_SQL = r"""
WITH i AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(source), 'null') || '|' || coalesce(md5(text), 'null')), 1, 15) AS x
  FROM documents),
j AS (SELECT *, row_number() OVER (PARTITION BY x) - 1 AS n FROM i),
b AS (SELECT doc_id, source, size, ('0x' || CASE WHEN n = 0 THEN x ELSE substr(md5(x || ':' || n), 1, 15) END)::BIGINT AS h FROM j),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2.0::DOUBLE AS lim FROM t),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
g AS (SELECT source, source_size, least(lim, coalesce((max(CASE WHEN lev <= lim / w THEN lev END) OVER ()) * w, lim)) AS target FROM l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
c AS (SELECT b.doc_id, b.size, b.h, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS budget,
             sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h) AS after,
             sum(b.size) OVER (PARTITION BY b.source, b.h) AS tie
      FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       (size * least(2, whole + CASE WHEN after <= budget OR (after - tie <= budget AND after - budget < budget - (after - tie)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
    'A': len(w) < 50,
    'B': 100 * len(list_distinct(w)) < 65 * len(w),
    'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(d.doc_id > least, false)} AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE length(regexp_replace('ABCDE', '[' || a.x || b.x || c.x || d.x || e.x || ']', '', 'g')) = 0),
s AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS letter, string_split(substr(filter_order, 1, step - 1), '') AS earlier
      FROM o, range(1, 6) r(step)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
e AS (
  SELECT g.*, filter_order, step, letter, fails[letter] AS own, len(list_filter(earlier, lambda x: x <> '' AND coalesce(fails[x], false))) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) AS failed
  FROM g, s),
r AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE own AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE own AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
z AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT z.lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (z.total + v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (lang_n + 1) // (v.total + v))::BIGINT AS q
  FROM z JOIN v ON z.lang = v.lang),
r AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= 200
"""
