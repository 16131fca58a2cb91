"""Appending a stream to a stored array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.frame import ArrayFrame
from ..operators.node import write_meta
from ..operators.sink import write_cells


def append_stream(cells: DataFrame, array: ArrayFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of cells (d0.., value), d0 being absolute, into a stored array that grows
    along axis 0 to hold them. A batch that is run again writes the same cells again."""
    state = {"array": array}

    def write(batch: DataFrame, _: int) -> None:
        top = batch.agg(F.max("d0")).first()[0]
        if top is None:
            return
        now: ArrayFrame = state["array"]
        meta = now.meta.resized((max(now.shape[0], int(top) + 1), *now.shape[1:]))
        write_cells(batch, now.store, now.path, meta)
        if meta.shape != now.shape:  # last, so that readers see whole batches
            write_meta(now.store, now.path, meta)
        state["array"] = now.reopened(meta)

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
