"""Shared plumbing of the corpus operators: narrow scans, Arrow maps and durable cut points."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns, whatever their names, are pruned from the scan; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def chunks(values: list, sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of neighbours that hold at most `limit` bytes, or one value that is larger by itself."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(values):
        yield start, len(values)


def map_texts(df: DataFrame, fn: Callable[[list, list[str]], dict[str, list]], schema: str, limit: int = 2 << 20) -> DataFrame:
    """Apply fn(ids, texts) -> columns to runs of rows of at most `limit` bytes of text.

    The runs bound a Python worker's memory by bytes, not by rows; nothing is shuffled and a lost
    task is recomputed from its own input split.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            for i, j in chunks(sizes, sizes, limit):
                ids, values = batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()
                columns = fn(ids, values)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the reliable checkpoint folder, so that a lost executor costs a reread and not a recomputation.

    The cluster names the folder in spark.checkpoint.dir. Where none is set, a local session gets a
    folder of its own and any other is refused, as its executors would not share one.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
