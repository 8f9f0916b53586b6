"""Item streams: one integer per record, from text or from a table column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from triflux.functions.checks import checked


def items_from(table: DataFrame, item: str, *extra: str) -> DataFrame:
    """One column of a batch or streaming DataFrame as ``item BIGINT``.

    A text stream works too: its column is ``value``, and a record that is not
    an integer fails the job.
    """
    column, parsed = F.col(item), F.col(item).try_cast("bigint")
    if isinstance(table.select(item).schema[0].dataType, StringType):
        said = F.concat(F.lit("not an integer: "), column)
        parsed = F.when(column.isNotNull(), checked(parsed, said))
    return table.select(parsed.alias("item"), *extra)


def stream_files(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    format: str = "parquet",
    max_files_per_batch: int | None = None,
    **options: str,
) -> DataFrame:
    """A folder of files read as an unbounded stream, new files as they arrive."""
    reader = spark.readStream.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.load(path)


def time_batch(ts: str, seconds: int) -> Column:
    """Number of the ``seconds``-long slot since 1970 that a TIMESTAMP_NTZ falls in.

    Read from the fields of the value, so the session time zone has no part in it.
    """
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    clock = F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)
    return F.floor((days * 86_400 + clock) / F.lit(seconds)).cast("bigint")
