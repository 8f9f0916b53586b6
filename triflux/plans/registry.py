"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Graph
    ``lineitem`` read as an edge list: the ids in ``l_partkey`` and ``l_suppkey``
    are vertices of one id space, as two integers on a line of an edge file are.
    Suppliers are few and parts many, so low ids are hubs.
Items
    ``lineitem.l_partkey`` and, where time or a stream is needed, ``events.user_id``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triflux.functions.hashing import SketchParams
from triflux.functions.scratch import remove_path, scratch_path
from triflux.operators import graph, histogram, sketch, triangles
from triflux.plans.jobs import METHODS, count_triangles, report_on_counts, report_on_items
from triflux.sources.edges import EdgeText, edges_from, read_edge_text, read_edge_text_lenient
from triflux.sources.items import items_from, stream_files, time_batch
from triflux.streaming import partials, prefix, state
from triflux.streaming.offered import Offered, offer

# Fixed values, shared with the SQL in oracles.py.
COLOURS = 4
PARTS = 4
COLOUR_A, COLOUR_B = 4567, 123
PART_A, PART_A2, PART_B = 4567, 31, 123
RUNS = ((4567, 123), (1234, 77), (89, 4000), (7001, 5))
SKETCH_ROWS = (
    (1234, 77, 3, 1),
    (4567, 123, 5011, 17),
    (89, 4000, 7919, 2048),
    (7001, 5, 641, 8000),
    (2718, 2818, 3141, 5926),
)
WIDTH = 64
K = 10
LEFT, RIGHT = 5, 1_000_000_000_000
# Users beyond are out of range.
USERS_RIGHT = 140
PREFIX_ITEMS = 5_000
BATCH_SECONDS = 3_600
# Streams of many batches have one of these spans in each.
SPAN_SECONDS = 64 * 3_600
# More than one task should gather.
LARGE_K = 1_500
TEXT_PARTITIONS = 7
# Too wide to be broadcast: five rows of as many columns are more than a million cells.
WIDE, WIDE_PRIME = 400_000, 2_147_483_647

PARAMS = SketchParams(WIDTH, SKETCH_ROWS)
WIDE_PARAMS = SketchParams(WIDE, SKETCH_ROWS, WIDE_PRIME)

Query = Callable[[SparkSession, str], DataFrame]


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges_from(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_partkey", "l_suppkey")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return items_from(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_partkey")


def _hist(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.histogram(_items(spark, sf), LEFT, RIGHT)


def _timed_items(spark: SparkSession, sf: str) -> DataFrame:
    batch = time_batch("ts", BATCH_SECONDS).alias("batch")
    return items_from(spark.read.parquet(f"{sf}/events.parquet"), "user_id", batch)


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # As a pattern the path may be one file or a folder of files.
    return items_from(stream_files(spark, f"{sf}/{{events.parquet}}", schema), "user_id")


def _spans(spark: SparkSession, sf: str) -> str:
    """``events (item)`` in folders by time span; those without a time in one of their own."""
    path = scratch_path(spark, "spans")
    span = time_batch("ts", SPAN_SECONDS).alias("span")
    items = items_from(spark.read.parquet(f"{sf}/events.parquet"), "user_id", span)
    items.hint("rebalance", "span").write.partitionBy("span").parquet(path)
    return path


def _span_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream of many batches, in whatever order files are found."""
    schema = "item bigint, span bigint"
    return stream_files(spark, _spans(spark, sf), schema, max_files_per_batch=1)


def _span_batches(spark: SparkSession, sf: str) -> Offered:
    """The same as a stream of one span a batch, in order."""
    return offer(spark.read.schema("item bigint, span bigint").parquet(_spans(spark, sf)), "span")


def _prefix_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of a stream that stops itself."""
    root = scratch_path(spark, "prefix")
    counts, offsets = f"{root}/counts", f"{root}/offsets"
    spans = _span_batches(spark, sf)
    partials.write_counts(
        spans, counts, offsets, LEFT, USERS_RIGHT, PREFIX_ITEMS
    ).awaitTermination()
    return partials.read_counts(spark, counts)


def _running_histogram(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "histogram")
    counts, offsets = f"{root}/counts", f"{root}/offsets"
    partials.write_counts(
        _span_stream(spark, sf), counts, offsets, LEFT, USERS_RIGHT, availableNow=True
    ).awaitTermination()
    return histogram.histogram_of(partials.read_counts(spark, counts))


def _histogram_in_state(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "state")
    query = state.keep_histogram(
        _span_stream(spark, sf), root, LEFT, USERS_RIGHT, availableNow=True
    )
    query.awaitTermination()
    return state.read_histogram(spark, root)


def _stream_top_k(spark: SparkSession, sf: str) -> DataFrame:
    hist = histogram.histogram_of(_prefix_counts(spark, sf))
    return sketch.top_k_estimates(hist, _sketch(hist), PARAMS, K)


def _edges_through_text(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "edges")
    lines = _edges(spark, sf).select(F.concat_ws(",", "u", "v").alias("value"))
    lines.write.text(path)
    return graph.canonical_edges(read_edge_text(spark, path))


def _edge_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Edges read back in a given number of partitions: how many there are, and all edges."""
    path = scratch_path(spark, "edges")
    lines = _edges(spark, sf).select(F.concat_ws(",", "u", "v").alias("value"))
    lines.write.text(path)
    edges = read_edge_text(spark, path, partitions=TEXT_PARTITIONS)
    each = edges.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(
        F.count(F.lit(1)).alias("partitions"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges")
    )


def _by_method(spark: SparkSession, sf: str) -> DataFrame:
    """The methods by name; with one colour or one part the estimators count exactly, too."""
    path = scratch_path(spark, "edges")
    lines = _edges(spark, sf).select(F.concat_ws(",", "u", "v").alias("value"))
    lines.write.text(path)
    edges = read_edge_text(spark, path, keep=True)
    remove_path(spark, path)
    # All methods start from one layout; each by itself would find the degrees again. They
    # count one after the other, so that their shuffle files are never there together.
    layout = graph.lay_out(edges, bounded=True, last_use=True)
    colours = {"exact": 1, "exact_triplet": COLOURS, "colour": 1, "partition": 1}
    counts = [
        count_triangles(layout, method, colours[method], runs=len(RUNS), seed=11).select(
            F.lit(method).alias("method"), F.col("triangles").cast("bigint").alias("triangles")
        )
        for method in METHODS
    ]
    return reduce(DataFrame.unionByName, counts)


def _edge_text(spark: SparkSession, sf: str) -> EdgeText:
    """Edges as lines of a file, with what a careless writer puts between them."""
    path = scratch_path(spark, "lines")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.when(F.col("l_linenumber") == 7, F.concat_ws(";", "l_partkey", "l_suppkey"))
        .when(F.col("l_linenumber") == 6, F.concat_ws(",", "l_partkey", "l_returnflag"))
        .when(F.col("l_linenumber") == 5, F.lit(""))
        .otherwise(F.concat_ws(",", "l_partkey", "l_suppkey", "l_returnflag"))
        .alias("value")
    )
    lines.write.text(path)
    return read_edge_text_lenient(spark, path)


def _edge_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    text = _edge_text(spark, sf)
    return spark.range(1).select(
        F.lit(text.n_edges).cast("bigint").alias("n_edges"),
        F.lit(text.n_rejects).cast("bigint").alias("n_rejects"),
    )


def _runs_laid_out(spark: SparkSession, sf: str) -> DataFrame:
    """Each run a count of its own, all from edges that were laid out once."""
    layout = graph.lay_out(_edges(spark, sf))
    runs = [
        triangles.estimate_by_colours(layout, COLOURS, [run]).select(
            F.lit(i).alias("run"), "estimate"
        )
        for i, run in enumerate(RUNS)
    ]
    return reduce(DataFrame.unionByName, runs)


def _stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    return partials.drain(_event_stream(spark, sf), LEFT, RIGHT)


def _running_sketch(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "sketch")
    items = _span_stream(spark, sf).where(histogram.in_range(LEFT, RIGHT))
    table = sketch.count_sketch(items, PARAMS)
    query = partials.running(table, f"{root}/cells", f"{root}/state", availableNow=True)
    query.awaitTermination()
    return partials.read_running(spark, f"{root}/cells")


def _merged_sketch(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    inside = items_from(lines, "l_partkey", "l_linestatus").where(histogram.in_range(LEFT, RIGHT))
    open_ = F.col("l_linestatus").eqNullSafe("O")
    return sketch.merge_sketches(
        *[sketch.count_sketch(inside.where(part), PARAMS) for part in (open_, ~open_)]
    )


def _sketch(hist: DataFrame) -> DataFrame:
    return sketch.count_sketch(hist, PARAMS, "f")


def _estimates(spark: SparkSession, sf: str) -> DataFrame:
    hist = _hist(spark, sf)
    return sketch.estimate_frequencies(hist, _sketch(hist), PARAMS)


def _wide_estimates(spark: SparkSession, sf: str) -> DataFrame:
    hist = _hist(spark, sf)
    cells = sketch.count_sketch(hist, WIDE_PARAMS, "f")
    return sketch.estimate_frequencies(hist, cells, WIDE_PARAMS)


def _top_k(spark: SparkSession, sf: str) -> DataFrame:
    hist = _hist(spark, sf)
    return sketch.top_k_estimates(hist, _sketch(hist), PARAMS, K)


def _top_k_error(spark: SparkSession, sf: str) -> DataFrame:
    hist = _hist(spark, sf)
    error = sketch.top_k_error(hist, _sketch(hist), PARAMS, K)
    return error.select(F.round("avg_err", 6).alias("avg_err"))


def _second_moment(spark: SparkSession, sf: str) -> DataFrame:
    moments = histogram.second_moment(_hist(spark, sf))
    return moments.select("n_in_range", "n_distinct", F.round("f2", 9).alias("f2"))


def _second_moment_estimate(spark: SparkSession, sf: str) -> DataFrame:
    hist = _hist(spark, sf)
    estimate = sketch.normalised_estimate(_sketch(hist), PARAMS, hist)
    return estimate.select(F.round("f2_est", 9).alias("f2_est"))


def _rounded(report: DataFrame) -> DataFrame:
    rounded = [F.round(x, d).alias(x) for x, d in (("avg_err", 6), ("f2", 9), ("f2_est", 9))]
    return report.select("n_total", "n_in_range", "n_distinct", *rounded)


def _prefix_histogram(spark: SparkSession, sf: str) -> DataFrame:
    kept = prefix.keep_prefix(_timed_items(spark, sf), PREFIX_ITEMS)
    return histogram.histogram(kept, LEFT, RIGHT)


QUERIES: dict[str, Query] = {
    "edge_counts": lambda s, d: graph.edge_counts(_edges(s, d)),
    "canonical_edges": lambda s, d: graph.canonical_edges(_edges(s, d)),
    "edges_through_text": _edges_through_text,
    "edges_lenient": lambda s, d: _edge_text(s, d).edges,
    "edge_rejects": lambda s, d: _edge_text(s, d).rejects,
    "edge_line_counts": _edge_line_counts,
    "edge_partitions": _edge_partitions,
    "monochromatic_edges": lambda s, d: triangles.monochromatic_edges(
        _edges(s, d), COLOURS, COLOUR_A, COLOUR_B
    ),
    "triangles_exact": lambda s, d: triangles.count_exact(_edges(s, d)),
    "triangles_by_method": _by_method,
    "triangles_list": lambda s, d: triangles.list_triangles(_edges(s, d)),
    "triangles_per_colour": lambda s, d: triangles.triangles_per_colour(
        _edges(s, d), COLOURS, COLOUR_A, COLOUR_B
    ),
    "triangles_colour_runs": lambda s, d: triangles.estimate_by_colours(
        _edges(s, d), COLOURS, RUNS
    ),
    "triangles_runs_laid_out": _runs_laid_out,
    "triangles_exact_laid_out": lambda s, d: triangles.count_exact(graph.lay_out(_edges(s, d))),
    "triangles_colour_median": lambda s, d: triangles.median_estimate(
        triangles.estimate_by_colours(_edges(s, d), COLOURS, RUNS)
    ),
    "triangles_partition": lambda s, d: triangles.estimate_by_partitions(
        _edges(s, d), PARTS, part=triangles.pair_hash(PART_A, PART_A2, PART_B, PARTS)
    ),
    "edge_triplet_keys": lambda s, d: triangles.triplet_edges(
        _edges(s, d), COLOURS, COLOUR_A, COLOUR_B
    ),
    "triangles_per_triplet": lambda s, d: triangles.triangles_per_triplet(
        _edges(s, d), COLOURS, COLOUR_A, COLOUR_B
    ),
    "triangles_triplet": lambda s, d: triangles.count_by_triplets(
        _edges(s, d), COLOURS, COLOUR_A, COLOUR_B
    ),
    "stream_prefix": lambda s, d: prefix.prefix_batches(
        prefix.batch_totals(_timed_items(s, d)), PREFIX_ITEMS
    ),
    "prefix_histogram": _prefix_histogram,
    "stream_prefix_batches": lambda s, d: prefix.prefix_batches(
        prefix.batch_totals(partials.drain(_span_batches(s, d), LEFT, USERS_RIGHT), "n"), PREFIX_ITEMS
    ),
    "stream_report_prefix": lambda s, d: _rounded(
        report_on_counts(_prefix_counts(s, d), PARAMS, K)
    ),
    "stream_top_k": _stream_top_k,
    "item_counts": lambda s, d: histogram.item_counts(_items(s, d), LEFT, RIGHT),
    "item_histogram": _hist,
    "items_by_frequency": lambda s, d: histogram.by_frequency(_hist(s, d)),
    "item_histogram_stream": lambda s, d: histogram.histogram_of(_stream_counts(s, d)),
    "item_histogram_running": _running_histogram,
    "item_histogram_state": _histogram_in_state,
    "count_sketch": lambda s, d: sketch.count_sketch(
        _items(s, d).where(histogram.in_range(LEFT, RIGHT)), PARAMS
    ),
    "count_sketch_of_histogram": lambda s, d: _sketch(_hist(s, d)),
    "count_sketch_merged": _merged_sketch,
    "count_sketch_stream": lambda s, d: _sketch(histogram.histogram_of(_stream_counts(s, d))),
    "count_sketch_running": _running_sketch,
    "frequency_estimates": _estimates,
    "frequency_estimates_wide": _wide_estimates,
    "top_k": _top_k,
    "top_k_large": lambda s, d: histogram.top_k(_hist(s, d), LARGE_K),
    "kth_frequency": lambda s, d: histogram.kth_frequency(_hist(s, d), K),
    "top_k_error": _top_k_error,
    "second_moment": _second_moment,
    "second_moment_estimate": _second_moment_estimate,
    "stream_summary": lambda s, d: _rounded(
        report_on_items(_items(s, d), LEFT, RIGHT, PARAMS, K)
    ),
    "stream_summary_stream": lambda s, d: _rounded(
        report_on_counts(_stream_counts(s, d), PARAMS, K)
    ),
}
