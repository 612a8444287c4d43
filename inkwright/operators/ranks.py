"""Row numbers within a key that no single task has to hold all rows of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS = 65_536  # of a key to number together, where the numbers that order them are spread evenly


def numbered(df: DataFrame, key: str, by: str, name: str, rows: int = ROWS) -> DataFrame:
    """df with `name`: 1, 2, ... within each key in the order of the whole-number column `by`, nulls first.

    Ranges of `by` are numbered on their own and start where the ranges before them end, so a key
    that holds a third of the table is many small groups. Equal values of `by` are numbered in any order.
    """
    low, high, n = df.agg(F.min(by), F.max(by), F.count("*")).first()
    if low is None:
        low = high = 0
    parts = -(-n // rows) or 1
    width = max(1, -(-(high - low + 1) // parts))
    dealt = df.withColumn("_part", F.coalesce(F.floor((F.col(by) - low) / width), F.lit(-1)))
    at = F.row_number().over(W.partitionBy(key, "_part").orderBy(by))
    if parts == 1:
        return dealt.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy("_part", by)).cast("long")).drop("_part")
    ends = W.partitionBy("_key").orderBy("_in").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_in")).count().select("_key", "_in", F.coalesce(F.sum("count").over(ends), F.lit(0)).alias("_before"))
    joined = dealt.withColumn(name, at).join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in")))
    return joined.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_key", "_in", "_before")
