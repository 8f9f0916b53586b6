"""The jobs a user starts: a triangle count by name of method, and a stream report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triflux.functions.hashing import PRIME, SketchParams, check_positive, draw_runs
from triflux.operators.graph import Layout
from triflux.operators.histogram import histogram_of, item_counts, second_moment
from triflux.operators.sketch import count_sketch, normalised_estimate, top_k_error
from triflux.operators.triangles import (
    count_by_triplets,
    count_exact,
    estimate_by_colours,
    estimate_by_partitions,
    median_estimate,
)

METHODS = ("exact", "exact_triplet", "colour", "partition")


def count_triangles(
    edges: DataFrame | Layout,
    method: str = "exact",
    colours: int = 1,
    runs: int = 1,
    seed: int = 0,
    p: int = PRIME,
) -> DataFrame:
    """One row ``triangles`` by one of METHODS.

    ``colours`` is the number of colours, or of edge parts for ``partition``.
    ``colour`` reports the median over ``runs``; the exact counts are equal in
    all runs and are computed once. Edges that several counts start from are best laid
    out first, by ``lay_out``.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    check_positive(colours=colours, runs=runs)
    if method == "exact":
        return count_exact(edges)
    if method == "exact_triplet":
        a, b = draw_runs(1, seed, p)[0]
        return count_by_triplets(edges, colours, a, b, p)
    if method == "colour":
        estimates = estimate_by_colours(edges, colours, draw_runs(runs, seed, p), p)
        return median_estimate(estimates).withColumnRenamed("estimate", "triangles")
    return estimate_by_partitions(edges, colours, seed).withColumnRenamed("estimate", "triangles")


def stream_report(
    hist: DataFrame, n_total: Column, params: SketchParams, k: int
) -> DataFrame:
    """One row: n_total, n_in_range, n_distinct, avg_err, f2, f2_est.

    ``hist`` is the histogram in range and ``n_total`` the length of the whole
    stream. The sketch is built from the histogram, so items are shuffled once.
    """
    sketch = count_sketch(hist, params, "f")
    return second_moment(hist).select(
        n_total.alias("n_total"),
        "n_in_range",
        "n_distinct",
        top_k_error(hist, sketch, params, k).scalar().alias("avg_err"),
        "f2",
        normalised_estimate(sketch, params, hist).scalar().alias("f2_est"),
    )


def report_on_items(
    items: DataFrame, left: int, right: int, params: SketchParams, k: int
) -> DataFrame:
    """:func:`stream_report` on a table of items and a closed interval."""
    return report_on_counts(item_counts(items, left, right), params, k)


def report_on_counts(counts: DataFrame, params: SketchParams, k: int) -> DataFrame:
    """:func:`stream_report` on the rows of ``item_counts``, as written per batch."""
    n_total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return stream_report(histogram_of(counts), n_total, params, k)
