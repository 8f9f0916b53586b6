"""Count sketch as a grouped sum.

A sketch is a sparse table ``(r, c, cell)`` of at most depth x width rows; a
missing cell is 0. It is linear, so sketches of parts of a stream add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triflux.functions.hashing import SketchParams, bucket_hash, check_positive, sign_hash
from triflux.functions.median import decimal_median, integer_median
from triflux.operators.histogram import at_least_kth, normalised, top_k

# A sketch with at most this many cells (24 bytes each) is broadcast.
BROADCAST_CELLS = 1_000_000

# Items of a cell per salt, and the most cells that may count as heavy.
SALT_ROWS, HEAVY_CELLS = 65_536, 1_000_000


def _hashed(items: DataFrame, params: SketchParams) -> DataFrame:
    """Each row once per sketch row, with its column ``c`` and sign ``g``."""
    item = F.col("item")
    per_row = F.array(
        *[
            F.struct(
                F.lit(r).alias("r"),
                bucket_hash(item, ah, bh, params.width, params.p).alias("c"),
                sign_hash(item, ag, bg, params.p).alias("g"),
            )
            for r, (ah, bh, ag, bg) in enumerate(params.rows)
        ]
    )
    return items.select("*", F.inline(per_row))


def count_sketch(items: DataFrame, params: SketchParams, weight: str | None = None) -> DataFrame:
    """Sketch of the ``item`` column; batch or streaming.

    ``weight`` names the column of frequencies where the input is a histogram.
    Cells are summed up in each task first, so a task shuffles no more than one
    sketch, however its items are distributed.
    """
    step = F.col("g") if weight is None else F.col("g") * F.col(weight)
    return _hashed(items, params).groupBy("r", "c").agg(F.sum(step).alias("cell"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketch of all streams together, all with the same parameters."""
    check_positive(sketches=len(sketches))
    rows = sketches[0].select("r", "c", "cell")
    for other in sketches[1:]:
        rows = rows.unionByName(other.select("r", "c", "cell"))
    return rows.groupBy("r", "c").agg(F.sum("cell").alias("cell"))


def _salted(hashed: DataFrame, sketch: DataFrame, salt_rows: int, heavy_cells: int) -> DataFrame:
    """``hashed`` with its cells by a shuffle join that spreads the rows of a heavy cell.

    The cells that most items fall into get a salt for each ``salt_rows`` of them. A
    cell is heavy above max(salt_rows, rows / heavy_cells), so fewer than
    ``heavy_cells`` are, and their list is broadcast.
    """
    loads = hashed.groupBy("r", "c").agg(F.count(F.lit(1)).alias("load"))
    rows = loads.agg(F.sum("load")).scalar()
    least = F.greatest(F.lit(salt_rows), F.ceil(rows / F.lit(heavy_cells)))
    heavy = loads.where(F.col("load") > least).select(
        "r", "c", F.floor(F.col("load") / salt_rows).cast("int").alias("salts")
    )
    last = F.coalesce("salts", F.lit(0))
    spread = hashed.join(F.broadcast(heavy), ["r", "c"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("item"), last + 1).cast("int")
    )
    copied = sketch.join(F.broadcast(heavy), ["r", "c"], "left").select(
        "r", "c", "cell", F.explode(F.sequence(F.lit(0), last)).alias("salt")
    )
    return spread.drop("salts").hint("merge").join(copied, ["r", "c", "salt"], "left").drop("salt")


def estimate_frequencies(
    items: DataFrame,
    sketch: DataFrame,
    params: SketchParams,
    broadcast_cells: int = BROADCAST_CELLS,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """The rows of ``items``, with distinct ``item``, and their estimate ``fhat``.

    A sketch of up to ``broadcast_cells`` is broadcast, and a histogram then keeps its
    partitioning by item and is not shuffled again. A wider one is joined by shuffle,
    with the cells that most items fall into spread over salts.
    """
    hashed = _hashed(items, params)
    # A column is a number below p, too, so no more than p cells of a row are filled.
    if params.depth * min(params.width, params.p) <= broadcast_cells:
        joined = hashed.join(F.broadcast(sketch), ["r", "c"], "left")
    else:
        joined = _salted(hashed, sketch, salt_rows, HEAVY_CELLS)
    seen = F.coalesce(F.col("cell") * F.col("g"), F.lit(0).cast("bigint"))
    per_row = [
        F.sum(F.when(F.col("r") == r, seen)).alias(f"row_{r}") for r in range(params.depth)
    ]
    return (
        joined.groupBy(*items.columns)
        .agg(*per_row)
        .select(
            *items.columns,
            integer_median(F.array(*[f"row_{r}" for r in range(params.depth)])).alias("fhat"),
        )
    )


def top_k_estimates(
    hist: DataFrame, sketch: DataFrame, params: SketchParams, k: int
) -> DataFrame:
    """``(item, f, fhat)`` of the k most frequent items."""
    return estimate_frequencies(top_k(hist, k), sketch, params)


def top_k_error(hist: DataFrame, sketch: DataFrame, params: SketchParams, k: int) -> DataFrame:
    """One row ``avg_err``: mean of ``|f - fhat| / f`` over items as frequent as the k-th."""
    estimates = estimate_frequencies(at_least_kth(hist, k), sketch, params)
    return estimates.agg(F.avg(F.abs(F.col("f") - F.col("fhat")) / F.col("f")).alias("avg_err"))


def second_moment_estimate(sketch: DataFrame, params: SketchParams) -> DataFrame:
    """One row ``f2_raw_est``: median over sketch rows of the sum of squared cells."""
    cell = F.col("cell").cast("decimal(19,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    rows = [
        F.coalesce(
            F.sum(F.when(F.col("r") == r, cell * cell)).cast("decimal(38,0)"), zero
        ).alias(f"row_{r}")
        for r in range(params.depth)
    ]
    median = decimal_median(F.array(*[f"row_{r}" for r in range(params.depth)]))
    return sketch.agg(*rows).select(median.alias("f2_raw_est"))


def normalised_estimate(sketch: DataFrame, params: SketchParams, hist: DataFrame) -> DataFrame:
    """One row ``f2_est``: the estimate over the squared length of the stream in range."""
    length = hist.agg(F.coalesce(F.sum("f"), F.lit(0))).scalar()
    return second_moment_estimate(sketch, params).select(
        normalised(F.col("f2_raw_est"), length).alias("f2_est")
    )
