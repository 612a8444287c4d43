"""Queries that have a streaming form, run over the whole table as one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwright.sources import adapters as A
from inkwright.streaming import completion

from ._named import Named

query = Named()


@query("""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS issues, CASE max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) WHEN 2 THEN 'incomplete' WHEN 1 THEN 'degraded' ELSE 'complete' END AS completion FROM events GROUP BY ALL""")
def completion_windows(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "incomplete").when(F.col("event_type") == "purchase", "degraded").otherwise("note")
    rows = A.read(spark, sf_dir, "events").select("user_id", "ts", severity.alias("severity"))
    return completion.completion_stream(rows, "1 day", "2 hours", "user_id")


QUERIES, ORACLES = query.queries, query.oracles
