"""Streaming queries, run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..sources.tables import table
from ..streaming import incremental
from .registry import query


@query("t_incremental_results", "SELECT event_id, upper(event_type) AS kind FROM events WHERE value > 50")
def t_incremental_results(spark, d):
    events = table(spark, d, "events")
    base = f"{shared_folder(spark)}/paperloom/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    picked = lambda df: df.filter("value > 50").select("event_id", F.upper("event_type").alias("kind"))
    incremental.append_results(stream, picked, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return incremental.latest(spark.read.parquet(f"{base}/out"), "event_id").select("event_id", "kind")


@query("t_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t_windowed_counts(spark, d):
    return incremental.windowed_counts(table(spark, d, "events"))
