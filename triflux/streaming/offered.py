"""A partitioned table offered as a stream, one partition a batch, in order.

A clock is the stream: its k-th batch has the number k, also after a restart, and
stands for the k-th partition counted from the least number. Each batch reads its
own partition only. So the data say which rows are in which batch, not the time at
which files are found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Offered:
    """A clock, and the table whose partitions ``first`` to ``last`` it offers.

    Numbers between them that have no partition are empty batches. Rows without a
    number, if there are any, are the batch after the last.
    """

    clock: DataFrame
    table: DataFrame
    column: str
    first: int
    last: int
    unnumbered: bool

    @property
    def batches(self) -> int:
        return self.last - self.first + 1 + self.unnumbered

    def rows(self, batch: int) -> DataFrame:
        """The partition that a batch of the clock stands for: a batch is one tick, so its number is."""
        at, own = self.first + batch, F.col(self.column)
        return self.table.where(own.isNull() if at == self.last + 1 else own == at)


def offer(table: DataFrame, column: str) -> Offered:
    """Offers a table that was written with ``partitionBy(column)``, of integers."""
    ends = table.agg(
        F.min(column).alias("low"),
        F.max(column).alias("high"),
        F.count_if(F.col(column).isNull()).alias("nulls"),
    ).first()
    first, last = (0, -1) if ends["low"] is None else (ends["low"], ends["high"])
    clock = (
        table.sparkSession.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", 1)
        .option("numPartitions", 1)
        .load()
    )
    return Offered(clock, table, column, first, last, ends["nulls"] > 0)
