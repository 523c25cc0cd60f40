"""Quality decisions over page metrics, and their roll-up to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_verdict(components: Column, ink_percent: Column, white_ratio: Column) -> Column:
    """content, blank or needs_review: a three-valued verdict, never a boolean."""
    return (
        F.when((components >= 3) & (ink_percent > 2), "content")
        .when((white_ratio >= 0.95) & (components == 0) & (ink_percent < 1), "blank")
        .when((white_ratio > 0.90) & (components <= 1) & (ink_percent < 2), "blank")
        .otherwise("needs_review")
    )


def is_docsep(width: Column, height: Column) -> Column:
    return (width > 1500) & height.between(1000, 1300)


def page_qc(ink_ratio: Column, angle: Column, rotation_conf: Column, least_ink: float = 1.5, least_conf: float = 65.0) -> Column:
    """struct(blank, rotation, status, reason): a blank page passes, a surely rotated one fails."""
    blank = ink_ratio < least_ink
    turned = ~blank & (angle != 0) & (rotation_conf >= least_conf)
    rotation = F.when(blank, "skipped").when(turned, F.concat(angle.cast("string"), F.lit("deg"))).otherwise("none")
    return F.struct(blank.alias("blank"), rotation.alias("rotation"), F.when(turned, "failed").otherwise("passed").alias("status"), F.when(turned, F.concat(F.lit("rotated "), rotation)).alias("reason"))


def document_qc(pages: DataFrame) -> DataFrame:
    """doc_id, page_idx, blank, ink, rotation, conf, reason -> one row per document.

    The last page with a rotation of its own names it; reasons are joined in page order.
    """
    real = ~F.col("rotation").isin("none", "skipped")
    reasons = F.transform(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("page_idx", "reason")))), lambda x: x["reason"])
    return pages.groupBy("doc_id").agg(
        F.bool_or("blank").alias("any_blank"),
        F.bool_and("blank").alias("all_blank"),
        F.max("ink").alias("max_ink"),
        F.coalesce(F.max_by("rotation", F.when(real, F.col("page_idx"))), F.lit("none")).alias("rotation"),
        F.min("conf").alias("min_conf"),
        F.array_join(reasons, "; ").alias("reasons"),
        F.when(F.count("reason") > 0, "failed").otherwise("passed").alias("status"),
    )
