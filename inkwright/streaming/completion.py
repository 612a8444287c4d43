"""How documents end, over a stream of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.operators.quality import COMPLETION, severity_rank


def completion_stream(issues: DataFrame, window: str = "1 hour", late: str = "2 hours", *keys: str) -> DataFrame:
    """keys, window start, issues, completion of a stream of issues (ts, severity, keys): the worst severity in each window.

    The watermark bounds the state: a window is final once `late` has passed, and issues that are later are dropped by it.
    """
    worst = F.max(severity_rank(F.col("severity")))
    rows = issues.withWatermark("ts", late).groupBy(*keys, F.window("ts", window)).agg(F.count("*").alias("issues"), F.element_at(F.array(*map(F.lit, COMPLETION)), (worst + 1).cast("int")).alias("completion"))
    return rows.select(*keys, F.col("window.start").alias("start"), "issues", "completion")
