"""Where jobs put the tables they write on the way to a result."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from triflux.functions.files import Folder, qualified

# What this process has asked for and not removed: folders, and tables of the catalog.
_paths: list[str] = []
_tables: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, with its scheme.

    On a cluster the setting must name storage that every executor shares.
    Only a local session may go without it, and then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="triflux-")
    path = qualified(spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    _paths.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Removes all tables that this process has written on the way to results.

    For when the results have been read: DataFrames that come from them read those tables.
    """
    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")
    while _paths:
        parent, _, name = _paths.pop().rpartition("/")
        Folder(spark, parent).remove(name)


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes one path that ``scratch_path`` gave, before ``clear_scratch``."""
    _paths.remove(path)
    parent, _, name = path.rpartition("/")
    Folder(spark, parent).remove(name)


def remove_table(frame: DataFrame) -> None:
    """Removes the files of a table of ``keep_table`` that nothing will read any more."""
    spark = frame.sparkSession
    folders = {qualified(spark, x.rpartition("/")[0]) for x in frame.inputFiles()}
    for path in folders & set(_paths):
        remove_path(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files when they end, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: For rows of about a megabyte. A page otherwise has 100 rows at least and is compressed at
#: once outside the heap; readers hold all rows of a row group.
LONG_ROWS = {
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "1",
    "parquet.block.size": str(16 << 20),
}


def keep_table(frame: DataFrame, name: str, long_rows: bool = False) -> DataFrame:
    """Write a DataFrame once, below ``spark.checkpoint.dir``, and return the table.

    For data that several jobs use. The table outlives executors, and a join of
    it with itself shuffles it once, which it does not do for a cached DataFrame.
    """
    path = scratch_path(frame.sparkSession, name)
    frame.write.options(**(LONG_ROWS if long_rows else {})).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def keep_bucketed(frame: DataFrame, name: str, column: str) -> DataFrame:
    """:func:`keep_table`, with the rows in buckets by the hash of a column.

    A job that groups or joins by that column needs no shuffle. There is one file per
    bucket, and as many buckets as ``spark.sql.shuffle.partitions``.
    """
    spark = frame.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    _tables.append(table)
    (
        frame.repartition(buckets, column)
        .write.bucketBy(buckets, column)
        .sortBy(column)
        .option("path", scratch_path(spark, name))
        .saveAsTable(table)
    )
    return spark.table(table)
