"""Exact item frequencies and the statistics that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triflux.functions.hashing import check_positive

# The most rows of a top K that one task gathers.
ONE_TASK = 1_000

# Bits below each of the three digits in which items are compared.
DIGITS = (42, 21, 0)


def in_range(left: int, right: int) -> Column:
    """Whether ``item`` lies in the closed interval."""
    return F.col("item").between(left, right)


def item_counts(items: DataFrame, left: int, right: int, *by: str) -> DataFrame:
    """``(*by, item, n)``, with all items outside the interval in one row of NULL item.

    One pass gives both the histogram and the length of the whole stream. The
    NULL group may be most of the stream; it is summed up before the shuffle.
    """
    kept = F.when(in_range(left, right), F.col("item")).alias("item")
    return items.groupBy(*by, kept).agg(F.count(F.lit(1)).alias("n"))


def histogram(items: DataFrame, left: int, right: int) -> DataFrame:
    """``(item, f)`` of the items in the closed interval; batch or streaming."""
    inside = items.where(in_range(left, right))
    return inside.groupBy("item").agg(F.count(F.lit(1)).alias("f"))


def histogram_of(counts: DataFrame) -> DataFrame:
    """``(item, f)`` summed up from the rows of :func:`item_counts`.

    The filter needs the counts, so it stays above them: where the length of the whole
    stream is asked for as well, both come from one pass.
    """
    inside = counts.where(F.col("n") * F.col("item").isNotNull().cast("bigint") > 0)
    return inside.groupBy("item").agg(F.sum("n").alias("f"))


def by_frequency(hist: DataFrame) -> DataFrame:
    """All items, most frequent first, ties by item."""
    return hist.orderBy(F.desc("f"), "item")


def _cut(hist: DataFrame, k: int) -> DataFrame:
    """One row ``kf, rest``: the k-th largest frequency, and how many of its items are in the top k.

    No row where there are fewer than k items. Items are counted per frequency first:
    frequencies that sum up to n have fewer than sqrt(2n) different values, which is
    all that one task puts in order.
    """
    counts = hist.groupBy("f").agg(F.count(F.lit(1)).alias("items"))
    before = F.sum("items").over(Window.orderBy(F.desc("f"))) - F.col("items")
    ranked = counts.select("f", "items", before.alias("before"))
    here = (F.col("before") < k) & (F.col("before") + F.col("items") >= k)
    return ranked.where(here).select(F.col("f").alias("kf"), (F.lit(k) - F.col("before")).alias("rest"))


def _last_item(hist: DataFrame, cut: DataFrame) -> DataFrame:
    """One row ``last``: of the items as frequent as the k-th, the ``rest``-th by item.

    Found digit by digit from the top, so that no task holds more than the counts of
    one digit: items are distinct, but as many as there may be of them are tied.
    """
    ties = hist.join(F.broadcast(cut), F.col("f") == F.col("kf")).select("item", "rest")
    left = ties
    for shift in DIGITS:
        digits = left.groupBy(F.shiftright("item", shift).alias("digit"), "rest").agg(
            F.count(F.lit(1)).alias("n")
        )
        up_to = F.sum("n").over(Window.orderBy("digit"))
        found = digits.withColumn("before", up_to - F.col("n")).where(
            (F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))
        )
        one = found.select("digit", (F.col("rest") - F.col("before")).alias("rest"))
        left = ties.drop("rest").join(
            F.broadcast(one), F.shiftright("item", shift) == F.col("digit")
        ).select("item", "rest")
    return one.select(F.col("digit").alias("last"))


def top_k(hist: DataFrame, k: int, one_task: int = ONE_TASK) -> DataFrame:
    """The k most frequent items, ties by item; all items where there are fewer.

    Up to ``one_task`` rows are gathered by one task. More are chosen where they are and
    then sorted by ranges, so that no task sees all k.
    """
    check_positive(k=k)
    if k <= one_task:
        return by_frequency(hist).limit(k)
    cut = _cut(hist, k)
    kf, last = cut.select("kf").scalar(), _last_item(hist, cut).scalar()
    chosen = (F.col("f") > kf) | ((F.col("f") == kf) & (F.col("item") <= last))
    return by_frequency(hist.where(kf.isNull() | chosen))


def kth_frequency(hist: DataFrame, k: int, one_task: int = ONE_TASK) -> DataFrame:
    """One row ``kf``: the k-th largest frequency, or the least where there are fewer items."""
    check_positive(k=k)
    if k <= one_task:
        return top_k(hist, k).agg(F.min("f").alias("kf"))
    kf = _cut(hist, k).select("kf").scalar()
    return hist.agg(F.coalesce(kf, F.min("f")).alias("kf"))


def at_least_kth(hist: DataFrame, k: int, one_task: int = ONE_TASK) -> DataFrame:
    """Every item as frequent as the k-th one, so more than k rows on ties."""
    return hist.where(F.col("f") >= kth_frequency(hist, k, one_task).scalar())


def exact_square_sum() -> Column:
    """``sum(f^2)`` as DECIMAL(38,0); a frequency of 10^12 squares beyond BIGINT."""
    f = F.col("f").cast("decimal(19,0)")
    return F.coalesce(F.sum(f * f).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def normalised(square_sum: Column, length: Column) -> Column:
    """``square_sum / length^2`` as DOUBLE, NULL for an empty stream."""
    n = length.cast("double")
    return F.when(length > 0, square_sum.cast("double") / (n * n))


def second_moment(hist: DataFrame) -> DataFrame:
    """One row: ``n_in_range``, ``n_distinct``, ``f2_raw`` and ``f2`` = f2_raw / n_in_range^2."""
    sums = hist.agg(
        F.coalesce(F.sum("f"), F.lit(0)).alias("n_in_range"),
        F.count(F.lit(1)).alias("n_distinct"),
        exact_square_sum().alias("f2_raw"),
    )
    return sums.withColumn("f2", normalised(F.col("f2_raw"), F.col("n_in_range")))
