"""The plan of finalized documents: number, name, place and pages to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import division_code, final_filename, safe_filename
from ..operators.naming import file_sequence, numbered_per_group, without_collisions


def finalize_plan(docs: DataFrame, layout: str = "mirror", include_date: bool = False, start: int = 1, existing: DataFrame | None = None, drop_blank: bool = True, drop_docsep: bool = True) -> DataFrame:
    """docs (doc_id, status, date, division, company, rel_dir, n_pages, blank, docsep) -> the confirmed
    ones with seq, folder, placed, kept_pages.

    ``mirror`` keeps the input's folders and numbers each.  ``company`` has a folder per division and company (cleaned
    as in file names) and numbers each division through.  ``flat`` has one folder and one run of numbers, which goes
    on after the highest one among ``existing`` (folder, name).  Documents without a company are refused; with
    ``include_date``, those without a date too.  Numbers follow dates where these are on, then ids: without
    dates the order of the scan decides.
    """
    rows = docs.filter((F.col("status") == "confirmed") & (F.trim("company") != ""))
    if include_date:
        rows = rows.filter("date is not null")
    rows = rows.withColumn("division", division_code(F.col("division")))
    folder = {"mirror": F.col("rel_dir"), "company": F.concat_ws("/", "division", safe_filename(F.col("company"))), "flat": F.lit("")}[layout]
    group = {"mirror": ["folder"], "company": ["division"], "flat": []}[layout]
    order = [F.col("date").asc_nulls_last(), F.col("doc_id")] if include_date else [F.col("doc_id")]
    rows = numbered_per_group(rows.withColumn("folder", folder), group, order, start)
    if layout == "flat" and existing is not None:
        used = existing.filter("folder = ''").agg(F.coalesce(F.max(file_sequence(F.col("name"))), F.lit(0)).alias("__used"))  # one row
        rows = rows.crossJoin(F.broadcast(used)).withColumn("seq", F.col("seq") + F.greatest(F.col("__used") - (start - 1), F.lit(0))).drop("__used")
    name = final_filename(F.col("seq"), F.col("division"), F.col("company"), F.date_format("date", "yyyyMM"), include_date)
    rows = without_collisions(rows.withColumn("name", name), "folder", "name", [F.col("doc_id")], existing)
    none = F.array().cast("array<int>")
    gone = F.array_union(F.col("blank") if drop_blank else none, F.col("docsep") if drop_docsep else none)
    pages = F.when(F.col("n_pages") > 0, F.sequence(F.lit(0), F.greatest(F.col("n_pages"), F.lit(1)) - 1)).otherwise(none)
    return rows.select("doc_id", "seq", "folder", "placed", F.array_except(pages, gone).alias("kept_pages"))


def manifest_rows(plan: DataFrame, inputs: DataFrame, now) -> DataFrame:
    """The manifest's rows for a plan; ``inputs``: doc_id, path, sha256, size, division, company, date."""
    joined = plan.join(inputs, "doc_id")
    return joined.select(
        now.cast("string").alias("timestamp"), F.col("path").alias("original_path"), F.col("sha256").alias("original_sha256"), F.col("size").alias("original_size"),
        F.concat_ws("/", F.nullif("folder", F.lit("")), F.col("placed")).alias("output_path"), F.lit("").alias("output_sha256"), F.col("placed").alias("final_filename"),
        F.col("division").alias("division_code"), F.col("company").alias("company_name"), F.coalesce(F.col("date").cast("string"), F.lit("")).alias("document_date"),
    )
