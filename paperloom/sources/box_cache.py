"""Word boxes of pages, cached by the content of the file: a table in the shared file system that plans read through.

A cached page is one row, so a reader sees all of its boxes or none.  The key holds the file's hash, the page and the
zone that was read; rows are appended in buckets by hash, so a plan opens the buckets of its own files.  Pages that
two writers added at once count once, with the boxes of the writer whose id is less.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.desk import page_boxes
from .shared import written

KEY = ["sha", "page_idx"]
BOX = ["ord", "text", "x0", "y0", "x1", "y1", "conf"]
SCHEMA = "sha string, page_idx int, zone string, writer string, boxes array<struct<ord: int, text: string, x0: double, y0: double, x1: double, y1: double, conf: double>>, bucket int"
BOXES = "sha string, page_idx int, ord int, text string, x0 double, y0 double, x1 double, y1 double, conf double"
BUCKETS = 64


def bucket_of(sha: Column) -> Column:
    return F.pmod(F.hash(sha), F.lit(BUCKETS))


def zone_key(top: float | None) -> str:
    """What was read of a page: all of it, or the part that begins in its uppermost ``top``."""
    return "all" if top is None else repr(float(top))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All cached rows; none where there is no cache yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    return spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)


def cached(path: str, wanted: DataFrame, top: float | None = None) -> DataFrame:
    """wanted (sha, page_idx) -> sha, page_idx, boxes of those that are cached for this zone, each once."""
    asked = wanted.select(*KEY).distinct().withColumn("bucket", bucket_of(F.col("sha")))
    rows = stored(wanted.sparkSession, path).filter(F.col("zone") == zone_key(top)).join(asked, ["bucket", *KEY], "left_semi")
    return rows.groupBy(*KEY).agg(F.min_by("boxes", "writer").alias("boxes"))


def store(path: str, boxes: DataFrame, top: float | None = None) -> None:
    """Adds the pages of ``boxes`` (sha, page_idx, ord, text, x0, y0, x1, y1, conf); adding a page again changes nothing a reader
    sees beyond which of its writers counts.  Boxes without a hash or a page are left out, as nothing can ask for them."""
    kept = boxes.filter("sha is not null and page_idx is not null").select(*KEY, F.struct(*(F.col(c) for c in BOX)).alias("box"))
    pages = kept.groupBy(*KEY).agg(F.sort_array(F.collect_list("box")).alias("boxes"))
    rows = pages.select("sha", F.col("page_idx").cast("int").alias("page_idx"), F.lit(zone_key(top)).alias("zone"), F.lit(uuid.uuid4().hex).alias("writer"), "boxes", bucket_of(F.col("sha")).alias("bucket"))
    # Rows of a bucket come together, not as a small file of every task; a large bucket is split again.
    rows.hint("rebalance", F.col("bucket")).write.mode("append").partitionBy("bucket").parquet(path)


def compact(path: str, target: str, spark: SparkSession) -> None:
    """A copy of the cache with every page once."""
    once = stored(spark, path).groupBy(*KEY, "zone", "bucket").agg(F.min_by(F.struct("writer", "boxes"), "writer").alias("x"))
    once.select(*KEY, "zone", "x.writer", "x.boxes", "bucket").hint("rebalance", F.col("bucket")).write.mode("error").partitionBy("bucket").parquet(target)


def boxes_through_cache(path: str, wanted: DataFrame, digital: DataFrame, recognise: Callable[[DataFrame], DataFrame], top: float | None = None) -> DataFrame:
    """wanted (sha, page_idx, height) -> the pages' boxes with ``source``: cache, digital or scanned.

    Only pages that the cache lacks are looked for among the ``digital`` words, and ``recognise`` gets only those that
    have none there either (it returns boxes as ``page_boxes`` takes them).  What was found is added to the cache; pages
    without any box are not, so they are tried again.  Repeated rows of ``wanted`` count once.
    """
    spark = wanted.sparkSession
    none = spark.createDataFrame([], BOXES)
    wanted = written(wanted.select(*KEY, "height").dropDuplicates(KEY), "wanted-pages")
    hits = written(cached(path, wanted, top), "cached-pages")
    misses = written(wanted.join(hits, KEY, "left_anti"), "missing-pages")
    found = written(page_boxes(misses, none, digital, none, top), "digital-boxes")
    open_ = written(misses.join(found, KEY, "left_anti"), "open-pages")
    seen = written(page_boxes(open_, none, none, recognise(open_), top), "scanned-boxes")
    fresh = found.unionByName(seen)
    if not fresh.isEmpty():
        store(path, fresh, top)
    old = hits.select(*KEY, F.explode("boxes").alias("b")).select(*KEY, "b.*", F.lit("cache").alias("source"))
    return old.unionByName(fresh)
