"""Arrow functions that are made where they are called: a worker that imports their module needs no session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str) -> Callable:
    """A decorator: the function of pandas series as a function of columns, of the given result type."""

    def made(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def call(*columns) -> Column:
            return F.pandas_udf(fn, kind)(*columns)

        return call

    return made
