"""A plan module's own registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longs(df: DataFrame) -> DataFrame:
    """df with all whole numbers as longs, as SQL engines count."""
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, kind in df.dtypes])


class Named:
    """Collects queries and, where SQL can say the same, their twins."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(fn: Callable) -> Callable:
            @wraps(fn)
            def run(spark, sf_dir):
                return longs(fn(spark, sf_dir))

            self.queries[fn.__name__] = run
            if sql:
                self.oracles[fn.__name__] = sql
            return run

        return add
