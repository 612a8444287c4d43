"""The neighbour rule over a stream of pages: what a page beside another also prints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "pages array<bigint>, sent array<bigint>, latest bigint"
OUT = "file string, band string, fold string, page long, repeated boolean"


def running_stream(edges: DataFrame, reach: int = 2, wait: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """file, band, fold, page, repeated of a stream of edge lines (file, band, fold, page, ts).

    The state of a file, band and fold is the pages that print it and those already told. A page is
    told as repeated once a neighbour prints the line too; what has had no neighbour when the watermark, `wait`
    behind the latest ts, is wait_ms past the group's last row is told as not repeated, and the group is
    forgotten, which bounds the state. A neighbour that comes later still tells its own page only.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, sent, latest = (set(state.get[0]), set(state.get[1]), state.get[2]) if state.exists else (set(), set(), 0)
        if state.hasTimedOut:
            told = [(p, False) for p in sorted(pages - sent)]
            state.remove()
        else:
            for pdf in frames:
                pages.update(int(p) for p in pdf["page"])
                latest = max(latest, int(pdf["ts"].max().timestamp() * 1000))
            new = [p for p in sorted(pages - sent) if any(p + d in pages for d in range(-reach, reach + 1) if d)]
            told = [(p, True) for p in new]
            state.update((sorted(pages), sorted(sent | set(new)), latest))
            state.setTimeoutTimestamp(max(latest + wait_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, p, r) for p, r in told], columns=["file", "band", "fold", "page", "repeated"])

    return edges.withWatermark("ts", wait).groupBy("file", "band", "fold").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
