"""Item counts of a stream, batch by batch, read only once they are committed.

The counts determine everything else: length, prefix, histogram and, because it is
linear, the sketch. They are kept in a merge tree of batch ranges, by batch and item
where single batches matter, else by item alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from triflux.functions.scratch import scratch_path
from triflux.operators.histogram import item_counts
from triflux.streaming.offered import Offered
from triflux.streaming.ranges import MergeTree
from triflux.streaming.stops import start_batches

SCHEMA = "item BIGINT, n BIGINT, batch BIGINT"
COUNTS = "item BIGINT, n BIGINT"


def partials_tree(spark: SparkSession, path: str) -> MergeTree:
    """The counts ``(item, n, batch)`` of single batches; NULL item is out of range."""
    return MergeTree(spark, path, ["item", "n", "batch"], [])


def counts_tree(spark: SparkSession, path: str, measured: bool = True) -> MergeTree:
    """The counts ``(item, n)`` of all batches together; NULL item is out of range.

    Versions know the sum of ``n`` if it is ``measured``, which takes a look at each batch.
    """
    return MergeTree(spark, path, ["item"], ["n"], "n" if measured else None)


def write_partials(
    items: DataFrame | Offered,
    path: str,
    checkpoint: str,
    left: int,
    right: int,
    **trigger: str | bool,
) -> StreamingQuery:
    """Starts a query that adds ``(item, n)`` of each batch to a tree of single batches.

    A table that is offered ends with its last partition, and the query stops then.
    """
    return _write(items, path, checkpoint, left, right, None, True, trigger)


def write_counts(
    items: DataFrame | Offered,
    path: str,
    checkpoint: str,
    left: int,
    right: int,
    threshold: int | None = None,
    **trigger: str | bool,
) -> StreamingQuery:
    """Starts a query that keeps the running counts of all batches.

    With a ``threshold`` it stops itself once so many items are committed. The batch
    that reaches it counts in full and none after it counts, also after a restart.
    """
    return _write(items, path, checkpoint, left, right, threshold, False, trigger)


def _write(
    items: DataFrame | Offered,
    path: str,
    checkpoint: str,
    left: int,
    right: int,
    threshold: int | None,
    single: bool,
    trigger: dict[str, str | bool],
) -> StreamingQuery:
    offered = items if isinstance(items, Offered) else None
    stream = offered.clock if offered else items

    def save(rows: DataFrame, batch: int) -> bool:
        spark = rows.sparkSession
        tree = (
            partials_tree(spark, path)
            if single
            else counts_tree(spark, path, threshold is not None)
        )
        done = tree.version()
        if threshold is None or done.total < threshold:
            own = item_counts(offered.rows(batch) if offered else rows, left, right)
            done = tree.add(own.withColumn("batch", F.lit(batch).cast("bigint")), batch)
        full = threshold is not None and done.total >= threshold
        return full or (offered is not None and batch >= offered.batches - 1)

    return start_batches(stream.writeStream, save, checkpoint, **trigger)


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """``(item, n, batch)`` of the batches committed so far; NULL item is out of range.

    No rows where nothing is committed, as for an empty stream.
    """
    return partials_tree(spark, path).read(SCHEMA)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(item, n)`` of all batches committed so far, an item at most once a range."""
    return counts_tree(spark, path).read(COUNTS)


def drain(items: DataFrame | Offered, left: int, right: int, name: str = "partials") -> DataFrame:
    """Process all that a stream holds now, and return its partial counts.

    The counts and the checkpoint are kept below ``spark.checkpoint.dir``.
    """
    spark = (items.clock if isinstance(items, Offered) else items).sparkSession
    root = scratch_path(spark, name)
    counts, offsets = f"{root}/counts", f"{root}/offsets"
    now = {} if isinstance(items, Offered) else {"availableNow": True}
    write_partials(items, counts, offsets, left, right, **now).awaitTermination()
    return read_partials(spark, counts)


def running(table: DataFrame, path: str, checkpoint: str, **trigger: str | bool) -> StreamingQuery:
    """Keep a streaming aggregation of bounded size, such as a sketch, in the state store.

    The whole result is written anew, and committed, after each batch; old versions go.
    """

    def save(rows: DataFrame, batch: int) -> bool:
        versions = _versions(rows.sparkSession, path, rows.columns)
        versions.replace(rows, batch)
        return False

    return start_batches(table.writeStream.outputMode("complete"), save, checkpoint, **trigger)


def _versions(spark: SparkSession, path: str, columns: list[str]) -> MergeTree:
    return MergeTree(spark, path, columns, [])


def read_running(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """The latest version that :func:`running` has committed.

    Where there is none, an empty table of ``schema``, or an error if that is not given.
    """
    found = _versions(spark, path, [])
    version = found.version()
    if not version.ranges:
        if schema is None:
            raise ValueError(f"{path} has no committed version; pass a schema for an empty one")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(found.folder(version.ranges[-1].folder))
