"""Durable cut points of long plans."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder, so that what is built on it is planned and computed once and survives lost executors.

    It is written as Parquet: a checkpoint of rows computes them twice, stores them raw and is read back with every
    column. Only what Parquet has no type for is checkpointed. The cluster names the folder in spark.checkpoint.dir.
    Where none is set, a local session gets a folder of its own and any other is refused, as its executors would not share one.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    if "void" in df.schema.simpleString() or len({c.lower() for c in df.columns}) < len(df.columns):
        return df.checkpoint(eager=True)
    own = context._jsc.sc().getCheckpointDir()
    path = f"{own.get() if own.isDefined() else df.sparkSession.conf.get('spark.checkpoint.dir')}/cut-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
