"""Simple graphs as edge tables, and the join that closes triangles.

How triangles are found
    Edges are oriented from the end of lower degree to the end of higher
    degree (ties by id), so every triangle has one first, one middle and one
    last vertex and is found once. A vertex has at most sqrt(2m) out-neighbours
    in a graph of m edges, whatever its degree, because each of them has at
    least its degree. That bound makes it safe to keep out-neighbours in one
    array. Each vertex sends to each of its out-neighbours the part of its
    array that comes later in the order; the receiver intersects it with its
    own array. What is shuffled is one array per edge: the vertex pairs after
    each neighbour in packed form, never as rows.

What keeps hot vertices apart
    A vertex with a third of all edges has a short out-array but may receive
    very many arrays. Its degree is known on both sides of the join, so the
    senders are spread over ``degree / SALT_ROWS`` salts and the receiver's own
    array is copied once per salt. A long out-array sends in blocks that are
    spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triflux.functions.checks import checked
from triflux.functions.scratch import keep_bucketed, keep_table, remove_table, shuffles_removed

# Arrays received per (vertex, salt).
SALT_ROWS = 65_536

# Out-neighbours of one vertex served by one task, where it has more than that.
SEND_BLOCK = 8_192

# Degrees are broadcast for at most max(HUB_ROWS, sqrt(2m)) vertices.
HUB_ROWS = 1_000_000

# Array elements that one share of a bounded layout sends: so many for each edge, or so many in all.
SHARE_PER_EDGE = 6
SHARE_LEAST = 16_000_000

# Share k of n, as (k, n).
Share = tuple[int, int]


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once as ``u < v``; self-loops and NULL ends are dropped."""
    return (
        edges.where(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    """One row: rows as read, and canonical edges."""
    raw = F.count(F.lit(1)).alias("raw_edges")
    # Copies collapse with their number kept, so one pass gives both counts.
    ends = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return (
        ends.groupBy("u", "v")
        .agg(raw)
        .agg(
            F.coalesce(F.sum("raw_edges"), F.lit(0)).alias("raw_edges"),
            F.count_if(F.col("u") != F.col("v")).alias("edges"),
        )
    )


def degrees(edges: DataFrame) -> DataFrame:
    """``(x, d)`` for every vertex that has an edge."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("x"))
    return ends.groupBy("x").agg(F.count(F.lit(1)).alias("d"))


def is_hub(known: DataFrame, rows: int = HUB_ROWS) -> Column:
    """Whether the vertex of a row of ``degrees`` is one of largest degree.

    With m edges the degrees sum to 2m, so fewer than 2m/T vertices have a
    degree above T. T = min(2m/rows, sqrt(2m)) thus holds for fewer than
    max(rows, sqrt(2m)) of them, and all others have degree at most sqrt(2m).
    """
    ends = known.agg(F.sum("d").cast("double")).scalar()
    return F.col("d") > F.least(ends / F.lit(float(rows)), F.sqrt(ends))


def orient(
    edges: DataFrame, hub_rows: int = HUB_ROWS, known: DataFrame | None = None, stepwise: bool = False
) -> DataFrame:
    """Canonical edges as ``(src, dst, src_d, dst_d)`` with src first in the degree order.

    Every vertex has its degree. Those of hubs come by broadcast, as their table
    has a proven bound. The others come by two shuffle joins, in which a vertex
    that is not a hub has at most sqrt(2m) rows; rows of hubs, which find nothing
    there, are spread by their other end. ``known`` has the ``degrees`` if they are
    known; ``stepwise`` writes what the first shuffle join gives, which the caller removes.
    """
    known = degrees(edges) if known is None else known
    hub = is_hub(known, hub_rows)
    # Set apart first, so that the broadcast does not wait for the aggregation.
    hubs = known.where(hub).hint("rebalance")
    rest = known.where(~hub)
    ends = edges.join(F.broadcast(hubs.selectExpr("x as u", "d as hu")), "u", "left").join(
        F.broadcast(hubs.selectExpr("x as v", "d as hv")), "v", "left"
    )
    for end, other in (("u", "v"), ("v", "u")):
        keyed = ends.selectExpr(
            "*", f"if(h{end} is null, {end}, {other}) as key", f"h{end} is not null as done"
        )
        own = rest.selectExpr("x as key", "false as done", f"d as r{end}")
        ends = keyed.join(own, ["key", "done"], "left").drop("key", "done")
        if stepwise and end == "u":
            ends = keep_table(ends, "ends")
    # u < v already holds, so on equal degrees u comes first.
    known = ends.selectExpr("u", "v", "coalesce(hu, ru) as du", "coalesce(hv, rv) as dv")
    return known.selectExpr(
        "if(du <= dv, u, v) as src",
        "if(du <= dv, v, u) as dst",
        "if(du <= dv, du, dv) as src_d",
        "if(du <= dv, dv, du) as dst_d",
    )


@dataclass(frozen=True)
class Layout:
    """Oriented edges in buckets by ``src``, for any number of runs.

    With ``shares`` each count runs at once, so many shares of the vertices one after
    the other, and a share's shuffle files go when it has been counted.
    """

    oriented: DataFrame
    shares: int | None = None


def lay_out(edges: DataFrame, bounded: bool = False, last_use: bool = False) -> Layout:
    """Makes edges canonical, orients them and writes them, once for several runs.

    A run that starts from them has no degrees to find and shuffles no edge: out-arrays
    are made where the edges lie, and only these are sent. ``bounded`` keeps the files of
    all this and of the counts in proportion to the edges: it goes step by step, each with
    the files of the step before at most, and counts in shares. A vertex sends at most m
    array elements in a graph of m edges, so no share has much more than its part. With
    ``last_use`` a scratch table of edges goes as soon as it has been read.
    """
    if not bounded:
        return Layout(keep_bucketed(orient(canonical_edges(edges)), "adjacency", "src"))
    with shuffles_removed(edges.sparkSession):
        canonical = keep_table(canonical_edges(edges), "canonical")
        if last_use:
            remove_table(edges)
        known = keep_table(degrees(canonical), "degrees")
        ends = orient(canonical, known=known, stepwise=True)
        oriented = keep_table(ends, "oriented")
        for frame in (canonical, known, ends):
            remove_table(frame)
        laid = keep_bucketed(oriented, "adjacency", "src")
        remove_table(oriented)
        sizes = laid.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("n"))
        row = sizes.agg(F.sum("n").alias("m"), F.sum(F.expr("n * (n - 1) / 2")).alias("sent")).first()
    share = max(SHARE_LEAST, SHARE_PER_EDGE * (row.m or 0))
    return Layout(laid, max(1, math.ceil((row.sent or 0) / share)))


def _senders(out: DataFrame, share: Share | None) -> DataFrame:
    """The out-arrays of a share of the vertices."""
    return out if share is None else out.where(f"pmod(xxhash64(src, 1), {share[1]}) = {share[0]}")


def closed_wedges(
    oriented: DataFrame,
    keys: Sequence[str] = (),
    laid_out: bool = False,
    share: Share | None = None,
) -> DataFrame:
    """Rows ``(*keys, src, mid, last)``: all third vertices of the triangles on src -> mid.

    Edges are matched within equal ``keys`` only. ``laid_out`` edges lie by ``src`` already.
    With a ``share`` only its part of the first vertices.
    """
    known = oriented.where("src is not null")
    # Shuffled once, as plain rows, and read by both sides of the join.
    dealt = known if laid_out else known.repartition(*keys, "src")
    out = (
        dealt.groupBy(*keys, "src", F.col("src_d").alias("d"))
        .agg(F.expr("sort_array(collect_list(struct(dst_d, dst)))").alias("out"))
        .selectExpr(*keys, "src", "d", "out.dst as ids", "out.dst_d as ds")
    )
    # A long array goes in blocks to several tasks: block k serves SEND_BLOCK
    # out-neighbours and has the part of the array from its first one on.
    blocks = f"sequence(0, cast((size(ids) - 2) div {SEND_BLOCK} as int))"
    begin = f"k * {SEND_BLOCK} + 1"
    first = _senders(out, share)
    short = first.where(f"size(ids) between 2 and {SEND_BLOCK}").selectExpr(*keys, "src", "ids", "ds")
    long = (
        first.where(f"size(ids) > {SEND_BLOCK}")
        .selectExpr(*keys, "src", "ids", "ds", f"explode({blocks}) as k")
        .selectExpr(
            *keys,
            "src",
            f"slice(ids, {begin}, size(ids)) as ids",
            f"slice(ds, {begin}, {SEND_BLOCK}) as ds",
            "k",
        )
        .repartition(*keys, "src", "k")
        .drop("k")
    )
    # The last neighbour has none after it.
    sent = (
        short.unionByName(long)
        .selectExpr("*", "posexplode(ds) as (i, mid_d)")
        .where("i + 1 < size(ids)")
        .selectExpr(
            *keys,
            "src",
            "element_at(ids, i + 1) as mid",
            f"pmod(xxhash64(src), mid_d div {SALT_ROWS} + 1) as salt",
            "slice(ids, i + 2, size(ids)) as later",
        )
    )
    if laid_out:  # nothing is shuffled that both sides could share, and the order of these is not needed
        out = dealt.groupBy(*keys, "src", F.col("src_d").alias("d")).agg(F.collect_list("dst").alias("ids"))
    kept = out.selectExpr(
        *keys, "src as mid", f"explode(sequence(0L, d div {SALT_ROWS})) as salt", "ids"
    )
    return _intersected(sent, kept, [*keys, "mid", "salt"]).select(*keys, "src", "mid", "last")


def _common(one: str, other: str) -> str:
    """What two arrays have in common. The second argument is hashed; the shorter one should be."""
    return (
        f"if(size({one}) < size({other}), "
        f"array_intersect({other}, {one}), array_intersect({one}, {other}))"
    )


def _intersected(sent: DataFrame, kept: DataFrame, on: list[str]) -> DataFrame:
    """The arrays sent to a vertex, cut down to what is in its own."""
    # Neither side is bounded, and size estimates do not see what posexplode adds.
    both = sent.hint("merge").join(kept, on)
    return both.withColumn("last", F.expr(_common("later", "ids"))).drop("later", "ids")


def closed_wedges_by_class(
    oriented: DataFrame,
    classes: Sequence[Column],
    within: bool = False,
    laid_out: bool = False,
    share: Share | None = None,
) -> DataFrame:
    """Rows ``(src, mid, c, last)``: the third vertices that both ends of src -> mid reach by class ``c``.

    Classes are conditions over the columns of ``oriented`` and may overlap. With
    ``within`` src -> mid is of that class as well. A vertex has one array of
    out-neighbours for each class, and sends to each of its out-neighbours the later
    part of every one of them. How many of a class come before an out-neighbour is
    counted once, in the order of its edges, so that part is a slice and no element is
    looked at. The parts go as one row an edge: what classes have in common lies side
    by side, where a shuffle file's compression finds it. ``share`` as in ``closed_wedges``.
    """
    numbers = range(len(classes))
    order = Window.partitionBy("src").orderBy("dst_d", "dst")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = (
        oriented.where("src is not null")
        .select("src", "src_d", "dst", "dst_d", F.array(*classes).alias("of"))
        .where(F.array_contains("of", True))
    )
    # Shuffled once, as plain rows, and read by both sides of the join.
    dealt = known if laid_out else known.repartition("src")
    edges = dealt.withColumn("seen", F.array(*[F.count_if(F.col("of")[k]).over(up_to) for k in numbers]))
    end = F.struct("dst_d", "dst")
    own = [F.sort_array(F.collect_list(F.when(F.col("of")[k], end))).alias(f"own{k}") for k in numbers]
    out = (
        edges.groupBy("src", F.col("src_d").alias("d"))
        .agg(F.sort_array(F.collect_list(F.struct("dst_d", "dst", "seen", "of"))).alias("mids"), *own)
        .select("src", "d", "mids", F.array(*[F.col(f"own{k}.dst") for k in numbers]).alias("own"))
    )
    blocks = f"explode(sequence(0, cast((size(mids) - 1) div {SEND_BLOCK} as int))) as k"
    first = _senders(out, share)
    short = first.where(f"size(mids) between 2 and {SEND_BLOCK}").select("src", "mids", "own")
    long = (
        first.where(f"size(mids) > {SEND_BLOCK}")
        .selectExpr("src", "mids", "own", blocks)
        .selectExpr("src", f"slice(mids, k * {SEND_BLOCK} + 1, {SEND_BLOCK}) as mids", "own", "k")
        .repartition("src", "k")
        .drop("k")
    )
    has = [f"m.seen[{k}] < size(own[{k}])" + f" and m.of[{k}]" * within for k in numbers]
    parts = [
        f"if({x}, slice(own[{k}], cast(m.seen[{k}] + 1 as int), size(own[{k}])), null)"
        for k, x in zip(numbers, has, strict=True)
    ]
    sent = (
        short.unionByName(long)
        .selectExpr("src", "own", "explode(mids) as m")
        .where(" or ".join(f"({x})" for x in has))
        .selectExpr(
            "src",
            "m.dst as mid",
            f"pmod(xxhash64(src), m.dst_d div {SALT_ROWS} + 1) as salt",
            f"array({', '.join(parts)}) as later",
        )
    )
    if laid_out:  # as in closed_wedges
        own = F.array(*[F.collect_list(F.when(F.col("of")[k], F.col("dst"))) for k in numbers])
        out = dealt.groupBy("src", F.col("src_d").alias("d")).agg(own.alias("own"))
    kept = out.selectExpr(
        "src as mid", f"explode(sequence(0L, d div {SALT_ROWS})) as salt", "own as ids"
    )
    common = ", ".join(_common(f"later[{k}]", f"ids[{k}]") for k in numbers)
    # Neither side is bounded, as in _intersected.
    both = sent.hint("merge").join(kept, ["mid", "salt"])
    closed = both.selectExpr("src", "mid", f"posexplode(array({common})) as (c, last)")
    return closed.where("size(last) > 0")


def closed_wedges_by_colour(
    oriented: DataFrame,
    colour: Callable[[Column], Column],
    colours: int,
    laid_out: bool = False,
    share: Share | None = None,
) -> DataFrame:
    """Rows ``(src, mid, c, last)``: the third vertices of colour ``c`` of the triangles on src -> mid."""
    classes = [colour(F.col("dst")) == c for c in range(colours)]
    return closed_wedges_by_class(oriented, classes, laid_out=laid_out, share=share)


def triangles_closed(
    oriented: DataFrame,
    keys: Sequence[str] = (),
    laid_out: bool = False,
    share: Share | None = None,
) -> DataFrame:
    """Rows ``(*keys, triangles)`` that sum up to the triangles of each key."""
    closed = closed_wedges(oriented, keys, laid_out, share)
    return closed.selectExpr(*keys, "cast(size(last) as bigint) as triangles")


def total_triangles() -> Column:
    """``sum(triangles)``, 0 where there are no rows; an error beyond BIGINT."""
    total = checked(F.try_sum("triangles"), "more triangles than BIGINT holds")
    return F.when(F.count("triangles") == 0, F.lit(0).cast("bigint")).otherwise(total)


def triangle_rows(
    oriented: DataFrame, keys: Sequence[str] = (), laid_out: bool = False
) -> DataFrame:
    """``(*keys, u, v, w)``: every triangle once as ``u < v < w``."""
    ids = F.array_sort(F.array("src", "mid", "x"))
    return (
        closed_wedges(oriented, keys, laid_out)
        .select(*keys, "src", "mid", F.explode("last").alias("x"))
        .select(*keys, ids.alias("t"))
        .select(*keys, *[F.element_at("t", i + 1).alias(x) for i, x in enumerate("uvw")])
    )
