"""Queries that end by themselves."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

# Fixed value: the default interval between batches.
TRIGGER = "100 milliseconds"


def start_batches(
    writer: DataStreamWriter,
    each: Callable[[DataFrame, int], bool],
    checkpoint: str,
    **trigger: str | bool,
) -> StreamingQuery:
    """Starts a query that passes each batch to ``each`` and stops once that returns True.

    The batch is handled before the query stops, but Spark may not have noted its end.
    After a restart it is then offered again, so ``each`` has to know what it has done.
    ``trigger`` is passed on to the writer, as in ``availableNow=True``; by default a
    batch starts every 100 ms.
    """
    started: list[StreamingQuery] = []
    ready = threading.Event()

    def stop() -> None:
        ready.wait()
        started[0].stop()

    def handle(rows: DataFrame, batch: int) -> None:
        # Not from here: stop() waits for the batch that it ends.
        if each(rows, batch):
            threading.Thread(target=stop, daemon=True).start()

    query = (
        writer.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": TRIGGER}))
        .start()
    )
    started.append(query)
    ready.set()
    return query
