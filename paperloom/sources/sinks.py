"""Sinks: the manifest, indexes, reports and exports.  Spark's commit protocol makes each write atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_manifest(rows: DataFrame, path: str) -> None:
    """Appends to the manifest table; readers see whole appends only."""
    rows.write.mode("append").parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_index(rows: DataFrame, path: str) -> None:
    """A JSON index without its binary columns."""
    rows.drop(*(c for c, t in rows.dtypes if t == "binary")).write.mode("overwrite").json(path)


def discard_snapshot(spark: SparkSession, path: str) -> bool:
    """Deletes a saved session, and with it the state of its scan; False if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def with_base64(rows: DataFrame) -> DataFrame:
    """Binary columns as base64 text, for snapshots."""
    return rows.withColumns({c: F.base64(c) for c, t in rows.dtypes if t == "binary"})


def report_lines(rows: DataFrame) -> DataFrame:
    """One line per status with its count, as (ord, line); the remaining ones first."""
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    done = F.col("status").startswith("DONE_") | (F.col("status") == "SHARED_OUTPUT")
    return counts.select(done.cast("int").alias("ord"), F.format_string("%-36s %8d", "status", "n").alias("line"))


def write_text(lines: DataFrame, path: str) -> None:
    """(section, part, key, line) as text files that follow each other: sorted by ranges, not in one task."""
    lines.orderBy("section", "part", "key", "line").select("line").write.mode("overwrite").text(path)


def audit_rows(plan: DataFrame, docs: DataFrame) -> DataFrame:
    """An audit row for every document: its placement, or why it has none."""
    reason = F.when(F.col("status") != "confirmed", F.concat(F.lit("error: "), "status")).when(F.trim("company") == "", "error: no company").otherwise("ok")
    return docs.join(plan.select("doc_id", "folder", "placed"), "doc_id", "left").select("doc_id", "status", "folder", "placed", F.when(F.col("placed").isNotNull(), "ok").otherwise(reason).alias("result"))
