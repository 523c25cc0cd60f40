"""Upserts, resume plans and small state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reconcile import REMAINING

# The lists of a session that a new scan fills again.
SCANNED_LISTS = ("all_flagged_docs", "auto_confirmed_docs")


def upsert(old: DataFrame, new: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Rows of ``new`` replace those of the same key in place; others follow in their order."""
    values = [c for c in old.columns if c not in (key, pos)]
    o = old.select(key, F.col(pos).alias("__op"), *(F.col(c).alias(f"__o_{c}") for c in values), F.lit(True).alias("__has_o"))
    n = new.select(key, F.col(pos).alias("__np"), *(F.col(c).alias(f"__n_{c}") for c in values), F.lit(True).alias("__has_n"))
    both = o.join(n, key, "full_outer")
    last = old.agg(F.coalesce(F.max(pos), F.lit(-1)).alias("__last"))
    both = both.crossJoin(F.broadcast(last))  # one row: the end of the old order
    pick = lambda c: F.when(F.col("__has_n"), F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c)
    place = F.coalesce(F.col("__op"), F.col("__last") + 1 + F.col("__np"))
    return both.select(key, place.alias(pos), *(pick(c) for c in values))


def remaining(plan: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    return plan.join(processed.select(key).distinct(), key, "left_anti")


def learned_hints(hints: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, key, company) with the last entry of each kind and key (by ord) kept."""
    rows = hints.unionByName(new)
    return rows.groupBy("kind", "key").agg(F.max_by("company", "ord").alias("company"))


def roster_with(roster: DataFrame, names: DataFrame) -> DataFrame:
    """The roster with the names that it lacks."""
    return roster.select("entry").unionByName(names.select("entry").distinct().join(roster.select("entry"), "entry", "left_anti")).distinct()


def output_guard(counts: DataFrame) -> DataFrame:
    """total, done -> what to offer before a scan."""
    left = F.col("total") - F.col("done")
    return counts.withColumn("decision", F.when(F.col("total") == 0, "stop").when(left == 0, "ask_reprocess").when(F.col("done") == 0, "fresh").otherwise("ask_remaining"))


def repaired(snapshot: DataFrame, left: DataFrame, mode: str) -> DataFrame:
    """A snapshot (scan: struct<plan, processed>, lists) patched for another run.

    ``reprocess`` clears the lists and plans what is left; ``review`` marks the rest of the plan done.
    """
    plan = left.agg(F.sort_array(F.collect_list("path")).alias("__left"))
    both = snapshot.crossJoin(F.broadcast(plan))
    if mode == "reprocess":
        empty = lambda c: F.slice(F.col(c), 1, 0)
        both = both.withColumns({c: empty(c) for c in ("all_flagged_docs", "auto_confirmed_docs")})
        scan = F.struct(F.col("__left").alias("plan"), F.slice(F.col("scan.processed"), 1, 0).alias("processed"))
    else:
        scan = F.struct(F.col("scan.plan").alias("plan"), F.array_except(F.col("scan.plan"), F.col("__left")).alias("processed"))
    return both.withColumn("scan", scan).drop("__left")


def repaired_plan(report: DataFrame, mode: str) -> DataFrame:
    """(path, status, ...) -> the rows that a repaired session plans, with ``processed``: one row per path, no arrays.

    ``reprocess`` plans what remains, nothing of it processed; ``review`` plans every input and marks those done
    as processed.  A row without a status remains; repeated rows and other columns are kept; another mode is an error.
    """
    left = F.coalesce(F.col("status").isin(*REMAINING), F.lit(True))
    if mode == "reprocess":
        return report.filter(left).withColumn("processed", F.lit(False))
    if mode == "review":
        return report.withColumn("processed", ~left)
    raise ValueError(f"mode is 'reprocess' or 'review', not {mode!r}")


def repaired_documents(docs: DataFrame, mode: str) -> DataFrame:
    """A session's documents (``list`` names the list of each) after a repair.

    ``reprocess`` empties the lists that a scan fills again, ``review`` keeps all; a null list is no such list.
    """
    if mode not in ("reprocess", "review"):
        raise ValueError(f"mode is 'reprocess' or 'review', not {mode!r}")
    return docs if mode == "review" else docs.filter(~F.coalesce(F.col("list").isin(*SCANNED_LISTS), F.lit(False)))
