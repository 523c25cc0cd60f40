"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, and the words themselves (Java and Python syntax alike).
SPACE_CHARS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Only a plain local master may fall back to a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="paperloom-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, a lost executor costs
    no recomputation, and the planner knows the table's true size when it picks a join."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._written_at = path
    return read


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that ``materialize`` returned.  Call it once everything derived from them is written."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """Marks a written table for broadcast if it has at most ``most`` rows; else the planner shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; keeps the left side's key columns."""
    renamed = right.select(*(F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__r_{k}"])
        on = one if on is None else on & one
    return left.join(renamed, on, how).drop(*(f"__r_{k}" for k in keys))


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def numbered(df: DataFrame, by: str, out: str, spread: Column, buckets: int, order: list[Column]) -> DataFrame:
    """Gapless numbers from 0 within ``by`` without one task holding a whole group.

    Rows of a group are dealt to ``buckets`` parts by ``spread``; the parts' counts (at most groups x
    buckets rows) give each part its offset, and rows are ranked inside their part only.
    """
    from pyspark.sql import Window as W

    parts = df.withColumn("__part", F.pmod(spread, F.lit(buckets)))
    counts = parts.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(by, "__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__from"))
    rank = F.row_number().over(W.partitionBy(by, "__part").orderBy(*order)) - 1
    ranked = parts.withColumn("__rank", rank.cast("long"))
    return null_safe(ranked, offsets, [by, "__part"]).withColumn(out, (F.col("__from") + F.col("__rank")).cast("long")).drop("__part", "__from", "__rank")


def trim() -> None:
    """Gives memory that earlier batches freed back to the system (where the C library can)."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def word_lists(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text between ASCII white space, a stretch of about ``size`` bytes at a time."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size) if at + size < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end
