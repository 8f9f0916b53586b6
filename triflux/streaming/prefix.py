"""The leading batches of a stream: whole batches until a number of items is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the default number of items after which batches are ignored.
THRESHOLD = 10_000_000

# Batch numbers per block of the running sum, as a power of two. At ten batches
# a second a block lasts 29 hours, and a century fills about 30,000 blocks.
BLOCK_BITS = 20


def batch_totals(items: DataFrame, weight: str | None = None) -> DataFrame:
    """``(batch, n)``: the items of each batch, or the sum of ``weight``."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return items.groupBy("batch").agg(total.alias("n"))


def prior_totals(totals: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``(batch, n, prior)``: the items of all earlier batches.

    The running sum is taken inside blocks of batches and, separately, over the
    block totals, so that no task sees the batches of more than one block. Items of
    an unknown batch (NULL) come last, as one batch after all others.
    """
    last = F.lit(2**63 - 1).cast("bigint")
    block = F.coalesce(F.shiftright("batch", block_bits), last)
    zero = F.lit(0).cast("bigint")

    def earlier(column: str, order: str, *by: str):
        window = Window.partitionBy(*by).orderBy(F.asc_nulls_last(order))
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(before), zero)

    batches = totals.select("batch", "n", block.alias("block"))
    blocks = batches.groupBy("block").agg(F.sum("n").alias("block_n"))
    base = blocks.select("block", earlier("block_n", "block").alias("base"))
    return batches.join(base, "block").select(
        "batch", "n", (F.col("base") + earlier("n", "batch", "block")).alias("prior")
    )


def prefix_batches(totals: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The batches processed: those with fewer than ``threshold`` items before them.

    The batch that reaches the threshold counts in full.
    """
    return prior_totals(totals).where(F.col("prior") < threshold)


def keep_prefix(
    items: DataFrame, threshold: int = THRESHOLD, weight: str | None = None
) -> DataFrame:
    """The rows of the batches that :func:`prefix_batches` keeps.

    Those batches are all up to a last one, so the rows need a filter, no join.
    """
    kept = prefix_batches(batch_totals(items, weight), threshold)
    unknown = F.col("batch").isNull()
    last = kept.agg(F.struct(F.max("batch"), F.count_if(unknown) > 0).alias("last")).scalar()
    return items.where((F.col("batch") <= last["col1"]) | (unknown & last["col2"]))
