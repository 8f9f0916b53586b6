"""Connected components of an edge table, by alternating stars.

Each round moves edges to the smallest neighbour: first every node's larger
neighbours link to its smallest one, then its smaller neighbours do. Trees become
stars in a number of rounds that grows with the logarithm of their depth. Tasks
contract the edges they hold between rounds, which makes the rounds fewer. A round
ends in a written table, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triflux.functions.scratch import keep_table

#: Nodes of edges that a task contracts at once.
HELD = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    # Repeats do no harm here: the small star that follows drops them.
    return both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a < b")


def _small_star(edges: DataFrame) -> DataFrame:
    # Here a < b: b's smaller neighbours, and b itself, go to the smallest of them.
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    moved = edges.join(low, "b")
    own = moved.select(F.col("low").alias("a"), F.col("b").alias("b"))
    others = moved.where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return own.unionByName(others).distinct()


def _forest(edges: DataFrame) -> DataFrame:
    """The same components with each task's edges as stars, so with fewer and flatter edges.

    A task holds up to ``HELD`` nodes at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while roots.get(top, top) != top:
                top = roots[top]
            while roots.get(x, x) != top:
                roots[x], x = top, roots.get(x, x)
            return top

        def stars() -> pa.RecordBatch:
            pairs = [(top, x) for x in roots if (top := root(x)) != x]
            columns = zip(*pairs, strict=True) if pairs else [[], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns], names=["a", "b"]
            )

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, q = root(x), root(y)
                roots[max(p, q)] = roots.setdefault(min(p, q), min(p, q))
            if len(roots) > HELD:
                yield stars()
                roots.clear()
        yield stars()

    return edges.mapInArrow(run, "a long, b long")


def _is_stars(edges: DataFrame) -> bool:
    """Whether no node is on both sides, and none has two centres."""
    sides = edges.select(F.col("a").alias("x"), F.lit(None).alias("up")).unionByName(
        edges.select(F.col("b").alias("x"), F.col("a").alias("up"))
    )
    kinds = sides.groupBy("x").agg(
        F.count_if(F.col("up").isNull()).alias("below"),
        F.min("up").alias("low"),
        F.max("up").alias("high"),
    )
    return kinds.where("low < high or (below > 0 and low is not null)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``edges (a, b)``: the smallest node it is connected to.

    Loops and repeated edges do no harm; nodes without another have no row.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current = keep_table(_forest(ordered), "edges")
    while not _is_stars(current):
        current = keep_table(_forest(_small_star(_large_star(current))), "edges")
    current = current.distinct()
    own = current.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    return own.unionByName(current.select(F.col("b").alias("node"), F.col("a").alias("label")))
