"""Python steps that need a page's rows together, many pages to a batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGES = 256  # turned into Python rows at a time


def pagewise(df: DataFrame, keys: list[str], fn: Callable[[list[dict]], list[dict]], extra: str, keep: bool = True) -> DataFrame:
    """fn of the rows of each key, as dicts without the keys; its rows with the keys in front.

    extra: the columns that fn adds, as DDL; with keep, df's own columns come before them. A page's rows
    travel as one array, so thousands of pages share an Arrow batch and none costs a group of its own; a
    page's size bounds the array. Values are turned into Python's and back by column. fn must not depend on the order of the rows.
    """
    others = [c for c in df.columns if c not in keys]
    nested = df.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in others])).alias("rows"))
    own = [f for f in df.schema.fields if f.name in keys] + ([f for f in df.schema.fields if f.name not in keys] if keep else [])
    own.sort(key=lambda f: keys.index(f.name) if f.name in keys else len(keys))
    schema = StructType([*own, *StructType.fromDDL(extra).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                some = batch.slice(start, PAGES)
                lists = some.column("rows")
                rows = [dict(zip(others, values)) for values in zip(*(c.to_pylist() for c in lists.flatten().flatten()))]
                at, made, sizes = 0, [], []
                for size in lists.value_lengths().to_pylist():
                    made.append(fn(rows[at : at + size]))
                    sizes.append(len(made[-1]))
                    at += size
                which = np.repeat(np.arange(len(sizes)), sizes)
                columns = [some.column(f.name).take(pa.array(which)).cast(f.type) if f.name in keys else pa.array([r.get(f.name) for out in made for r in out], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return nested.mapInArrow(run, schema)
