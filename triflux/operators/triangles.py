"""Triangle counts: exact, by node colours, by edge partitions, by colour triplets.

Every function takes raw edges ``(u, v)`` in any direction, with or without
copies and self-loops. All runs of an estimator are one Spark job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triflux.functions.checks import checked
from triflux.functions.hashing import (
    PRIME,
    bucket_hash,
    check_coefficients,
    check_positive,
)
from triflux.functions.median import integer_median
from triflux.functions.scratch import keep_table, shuffles_removed
from triflux.operators.graph import (
    Layout,
    Share,
    canonical_edges,
    closed_wedges_by_class,
    closed_wedges_by_colour,
    orient,
    total_triangles,
    triangle_rows,
    triangles_closed,
)

TRIPLET = ("k0", "k1", "k2")


def _oriented(edges: DataFrame | Layout) -> tuple[DataFrame, bool]:
    """Oriented edges, and whether they lie by ``src`` already."""
    if isinstance(edges, Layout):
        return edges.oriented, True
    return orient(canonical_edges(edges)), False


def _by_share(
    edges: DataFrame | Layout, rows: Callable[[Share | None], DataFrame], keys: Sequence[str] = ()
) -> DataFrame:
    """Rows ``(*keys, triangles)``: of all at once, or summed up for one share after the other."""
    if not isinstance(edges, Layout) or edges.shares is None:
        return rows(None)
    sums = []
    with shuffles_removed(edges.oriented.sparkSession):
        for k in range(edges.shares):
            one = rows((k, edges.shares)).groupBy(*keys).agg(total_triangles().alias("triangles"))
            sums.append(keep_table(one, "counts"))
    return reduce(DataFrame.unionByName, sums)


def count_exact(edges: DataFrame | Layout) -> DataFrame:
    """One row ``triangles``."""
    oriented, laid_out = _oriented(edges)
    closed = _by_share(edges, lambda x: triangles_closed(oriented, laid_out=laid_out, share=x))
    return closed.agg(total_triangles().alias("triangles"))


def list_triangles(edges: DataFrame | Layout) -> DataFrame:
    """Every triangle as ``u < v < w``."""
    oriented, laid_out = _oriented(edges)
    return triangle_rows(oriented, laid_out=laid_out)


def _same_colour(colours: int, a: int, b: int, p: int, u: str, v: str) -> Column:
    return bucket_hash(F.col(u), a, b, colours, p) == bucket_hash(F.col(v), a, b, colours, p)


def monochromatic_edges(
    edges: DataFrame, colours: int, a: int, b: int, p: int = PRIME
) -> DataFrame:
    """Canonical edges whose ends share a colour, as ``(colour, u, v)``."""
    check_positive(colours=colours)
    check_coefficients(a, b, p)
    same = edges.where(_same_colour(colours, a, b, p, "u", "v"))
    return canonical_edges(same).select(
        bucket_hash(F.col("u"), a, b, colours, p).alias("colour"), "u", "v"
    )


def _coloured_triangles(
    edges: DataFrame | Layout, colours: int, runs: Sequence[tuple[int, int]], p: int
) -> DataFrame:
    """Rows ``(run, colour, triangles)`` from the monochromatic edges of every run."""
    check_positive(colours=colours, runs=len(runs))
    for a, b in runs:
        check_coefficients(a, b, p)
    if not isinstance(edges, Layout):
        # Edges that are monochromatic in no run go before the first shuffle.
        any_run = [_same_colour(colours, a, b, p, "u", "v") for a, b in runs]
        edges = edges.where(reduce(or_, any_run))
    oriented, laid_out = _oriented(edges)
    same = [_same_colour(colours, a, b, p, "src", "dst") for a, b in runs]
    shared = F.array(*[bucket_hash(F.col("src"), a, b, colours, p) for a, b in runs])
    triangles = F.size("last").cast("bigint").alias("triangles")

    def rows(share: Share | None) -> DataFrame:
        closed = closed_wedges_by_class(oriented, same, True, laid_out, share)
        return closed.select(F.col("c").alias("run"), shared[F.col("c")].alias("colour"), triangles)

    return _by_share(edges, rows, ("run", "colour"))


def _summed(rows: DataFrame, key: str, values: int) -> DataFrame:
    """``(key, triangles)`` for the keys 0 to values - 1, 0 where a key has no rows."""
    zeros = rows.sparkSession.range(0, values, numPartitions=1).select(
        F.col("id").cast(rows.schema[key].dataType).alias(key),
        F.lit(0).cast("bigint").alias("triangles"),
    )
    counts = rows.select(key, "triangles").unionByName(zeros).groupBy(key)
    return counts.agg(total_triangles().alias("triangles"))


def triangles_per_colour(
    edges: DataFrame | Layout, colours: int, a: int, b: int, p: int = PRIME
) -> DataFrame:
    """``(colour, triangles)`` for every colour, 0 where it has no triangle."""
    return _summed(_coloured_triangles(edges, colours, [(a, b)], p), "colour", colours)


def estimate_by_colours(
    edges: DataFrame | Layout,
    colours: int,
    runs: Sequence[tuple[int, int]],
    p: int = PRIME,
) -> DataFrame:
    """``(run, estimate)`` for each ``(a, b)`` in runs: C^2 times the one-coloured triangles.

    With one colour the estimate is the exact count.
    """
    counts = _summed(_coloured_triangles(edges, colours, runs, p), "run", len(runs))
    return counts.select("run", _scaled(colours, F.col("triangles")).alias("estimate"))


def _scaled(n: int, triangles: Column) -> Column:
    """``n^2 * triangles``; an error beyond BIGINT."""
    return checked(F.try_multiply(F.lit(n * n).cast("bigint"), triangles), "estimate beyond BIGINT")


def median_estimate(estimates: DataFrame) -> DataFrame:
    """One row: the integer median of the run estimates, one value per run."""
    return estimates.agg(F.collect_list("estimate").alias("e")).select(
        integer_median(F.col("e")).alias("estimate")
    )


def pair_hash(a: int, a2: int, b: int, parts: int, p: int = PRIME) -> Column:
    """Edge part ``((a*u + a2*v + b) mod p) mod parts``, writable in plain SQL."""
    check_coefficients(a, b, p)
    check_coefficients(a2, b, p)
    p_ = F.lit(p).cast("bigint")
    mixed = F.pmod(F.col("u"), p_) * a + F.pmod(F.col("v"), p_) * a2 + F.lit(b)
    return F.pmod(F.pmod(mixed, p_), F.lit(parts).cast("bigint"))


def estimate_by_partitions(
    edges: DataFrame | Layout, parts: int, seed: int = 0, part: Column | None = None
) -> DataFrame:
    """One row ``estimate``: N^2 times the triangles inside single edge parts.

    The part of an edge is a hash of its canonical ends and the seed, or the
    given expression over ``u`` and ``v``. It must depend on those alone, as it
    is read on both sides of the closing join.
    """
    check_positive(parts=parts)
    if part is None:
        part = F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(parts).cast("bigint"))
    ends = (F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    oriented, laid_out = _oriented(edges)
    keyed = oriented.select("*", *ends).withColumn("part", part).drop("u", "v")
    closed = _by_share(
        edges, lambda x: triangles_closed(keyed, ("part",), laid_out, x).select("triangles")
    )
    return closed.agg(_scaled(parts, total_triangles()).alias("estimate"))


def _triplet_keys(
    edges: DataFrame, colours: int, a: int, b: int, p: int, u: str, v: str
) -> DataFrame:
    """Each edge once per third colour, with the sorted colour triplet as key."""
    check_positive(colours=colours)
    check_coefficients(a, b, p)
    ends = [bucket_hash(F.col(x), a, b, colours, p) for x in (u, v)]
    third = F.sequence(F.lit(0).cast("bigint"), F.lit(colours - 1).cast("bigint"))
    key = F.array_sort(F.array("cu", "cv", "third"))
    return (
        edges.select("*", ends[0].alias("cu"), ends[1].alias("cv"))
        .select("*", F.explode(third).alias("third"))
        .select(*edges.columns, key.alias("k"))
        .select(*[F.element_at("k", i + 1).alias(k) for i, k in enumerate(TRIPLET)], *edges.columns)
    )


def triplet_edges(edges: DataFrame, colours: int, a: int, b: int, p: int = PRIME) -> DataFrame:
    """Canonical edges replicated to their C colour triplets: ``(k0, k1, k2, u, v)``."""
    return _triplet_keys(canonical_edges(edges), colours, a, b, p, "u", "v")


def _triangles_in_own_triplet(
    edges: DataFrame | Layout, colours: int, a: int, b: int, p: int
) -> DataFrame:
    """Rows ``(k0, k1, k2, triangles)`` that count every triangle once, under its sorted colours.

    A triangle with two vertices of one colour would close under several keys. An edge
    and the colour of the third vertex make one key, so neighbours are sent by colour.
    """
    check_positive(colours=colours)
    check_coefficients(a, b, p)

    def colour(x: Column) -> Column:
        return bucket_hash(x, a, b, colours, p)

    oriented, laid_out = _oriented(edges)
    key = F.array_sort(F.array(colour(F.col("src")), colour(F.col("mid")), F.col("c").cast("bigint")))
    triangles = F.size("last").cast("bigint").alias("triangles")

    def rows(share: Share | None) -> DataFrame:
        closed = closed_wedges_by_colour(oriented, colour, colours, laid_out, share)
        return closed.select(key.alias("k"), triangles).select(
            *[F.element_at("k", i + 1).alias(k) for i, k in enumerate(TRIPLET)], "triangles"
        )

    return _by_share(edges, rows, TRIPLET)


def triangles_per_triplet(
    edges: DataFrame | Layout, colours: int, a: int, b: int, p: int = PRIME
) -> DataFrame:
    """``(k0, k1, k2, triangles)`` for the colour triplets that have triangles."""
    found = _triangles_in_own_triplet(edges, colours, a, b, p).where("triangles > 0")
    return found.groupBy(*TRIPLET).agg(total_triangles().alias("triangles"))


def count_by_triplets(
    edges: DataFrame | Layout, colours: int, a: int, b: int, p: int = PRIME
) -> DataFrame:
    """One row ``triangles``: the exact count, the same for all colours, a and b."""
    found = _triangles_in_own_triplet(edges, colours, a, b, p)
    return found.agg(total_triangles().alias("triangles"))
