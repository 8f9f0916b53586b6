"""Item frequencies of a stream in Spark's state store, where they can be read while they grow.

Only items that a batch changes are touched; nothing is rewritten. The store is part
of the query's checkpoint, so a restart goes on from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from triflux.operators.histogram import histogram
from triflux.streaming.stops import TRIGGER


def keep_histogram(
    items: DataFrame, checkpoint: str, left: int, right: int, **trigger: str | bool
) -> StreamingQuery:
    """Starts a query that keeps ``(item, f)`` of the closed interval in its state.

    ``trigger`` is passed on to the writer, as in ``availableNow=True``; by default a
    batch starts every 100 ms.
    """
    return (
        histogram(items, left, right)
        .writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": TRIGGER}))
        .start()
    )


def read_histogram(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """``(item, f)`` after the last batch that has ended, or after ``batch`` if it is still kept."""
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(checkpoint).selectExpr("key.item as item", "value.count as f")
