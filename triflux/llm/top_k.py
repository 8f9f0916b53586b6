"""Exact top-k inner products: ball trees over shards, searched by blocks of queries.

Vectors are dealt evenly to shards of about ``SHARD`` rows, each with a ball tree
of its own, and queries to blocks. Blocks are sent to stripes of shards, and a task
searches the shards of a stripe for one block after the other. Rounds share the k-th
scores: one shard, then a few, then all others, each with the best scores of the
rounds before as a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triflux.functions.batches import in_small_batches
from triflux.functions.scratch import keep_table
from triflux.llm.ball_tree import UNKNOWN, BallTree

K = 10
EVERY = 100
SCALE = 1024
SHARD = 4096
QUERIES = 2048
#: The last round has about so many stripes before one gets several shards, and a stripe so many bytes of vectors.
STRIPES = 64
STRIPE_BYTES = 64 << 20
#: The first shard of each round but the first round.
ROUNDS = (1, 8)
#: Components beyond this could give scores beyond 64 bits (with up to 2048 of them).
LARGEST = 2.0**26

_PARTS = ("t_vectors", "t_ids", "t_centres", "t_radii", "t_spans")
FOUND = "dim int, block int, at int, query_id long, vec_id long, score long"


def integer_vectors(frame: DataFrame) -> DataFrame:
    """``vec_id, v, dim`` of ``frame (vec_id, embedding)``: components times 1024, rounded down.

    Null vectors, and those with null or non-finite components, take no part; a
    finite component beyond ``LARGEST`` / 1024 is an error.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = frame.where(
        F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", finite), F.lit(False))
    )
    scaled = lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))
    small = lambda x: F.abs(x.cast("double")) < F.lit(LARGEST / SCALE)
    checked = F.when(F.forall("embedding", small), F.transform("embedding", scaled)).otherwise(
        F.raise_error(F.lit("a component is too large for exact scores")).cast("array<long>")
    )
    return whole.select("vec_id", checked.alias("v"), F.size("embedding").alias("dim"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)


def build_shards(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """A table of ball trees: ``dim, shard`` and the tree's arrays, one row per shard."""
    shards = F.greatest(F.lit(1), F.ceil(F.count("*") / shard_rows)).cast("int").alias("shards")
    sizes = vectors.groupBy("dim").agg(shards)
    dealt = vectors.withColumn("row", F.monotonically_increasing_id()).join(
        F.broadcast(sizes), "dim"
    )  # a row per dimension
    # Rows of one partition have numbers one after the other: equal shares, however alike they are.
    dealt = keep_table(
        dealt.select("dim", "vec_id", "v", F.pmod("row", "shards").cast("int").alias("shard")),
        "vectors",
    )

    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        tree = BallTree.build(_matrix(table["v"], dim), table["vec_id"].to_numpy())
        columns = [pa.array([x], pa.binary()) for x in tree.parts()]
        head = [pa.array([table[x][0].as_py()], pa.int32()) for x in ("dim", "shard")]
        return pa.table([*head, *columns], names=["dim", "shard", *_PARTS])

    schema = "dim int, shard int, " + ", ".join(f"{x} binary" for x in _PARTS)
    return keep_table(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "shards", long_rows=True)


def query_blocks(queries: DataFrame, block_rows: int = QUERIES) -> DataFrame:
    """A table of blocks of distinct queries: ``dim, block, ids, vs``, about equal in size."""
    distinct = keep_table(queries.distinct(), "queries")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows)).cast("int").alias("blocks")
    sizes = distinct.groupBy("dim").agg(blocks)
    dealt = distinct.join(F.broadcast(sizes), "dim").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int")
    )
    rows = dealt.groupBy("dim", "block").agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("q")
    )
    return keep_table(
        rows.select("dim", "block", F.col("q.vec_id").alias("ids"), F.col("q.v").alias("vs")),
        "blocks",
        long_rows=True,
    )


def _stripes(shards: DataFrame, low: int, high: int | None, shard_rows: int) -> DataFrame:
    """``dim, width, first, last``: the numbers of the stripes of a round, a row per dimension.

    A stripe has ``width`` shards: one, or in the last round as many as make a task's
    share, so that blocks are sent to far fewer places than there are shards.
    """
    numbers = shards.groupBy("dim").agg(F.max("shard").alias("top")).where(F.col("top") >= low)
    held = F.greatest(F.lit(1), F.floor(F.lit(STRIPE_BYTES) / (8 * shard_rows * F.greatest("dim", F.lit(1)))))
    shared = F.greatest(F.lit(1), F.floor((F.col("top") + 1) / STRIPES))
    width = F.lit(1) if high is not None else F.least(held, shared)
    last = F.col("top") if high is None else F.least("top", F.lit(high - 1))
    number = lambda x: F.floor(x / F.col("width")).cast("int")
    return numbers.withColumn("width", width.cast("int")).select(
        "dim", "width", number(F.lit(low)).alias("first"), number(last).alias("last")
    )


def _search(
    blocks: DataFrame, shards: DataFrame, k: int, low: int, high: int | None, shard_rows: int = SHARD
) -> DataFrame:
    """The best of each shard from ``low`` to below ``high`` for each query.

    Blocks carry the scores to reach in ``least``. What is broadcast has a row per
    dimension; neither side of the join is, however small it seems.
    """
    stripes = F.broadcast(_stripes(shards, low, high, shard_rows))
    own = shards.where(F.col("shard") >= low)
    own = (own if high is None else own.where(F.col("shard") < high)).join(stripes, "dim")
    own = own.select("dim", F.floor(F.col("shard") / F.col("width")).cast("int").alias("stripe"), *_PARTS)
    numbers = F.explode(F.sequence("first", "last"))
    sent = blocks.join(stripes, "dim").withColumn("stripe", numbers).drop("width", "first", "last")
    both = sent.hint("merge").join(own, ["dim", "stripe"]).select(
        "dim", "block", "ids", "vs", "least", *_PARTS
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                dim, block = one["dim"].as_py(), one["block"].as_py()
                tree = BallTree.from_parts([one[x].as_buffer() for x in _PARTS], dim)
                points = _matrix(one["vs"].values, dim)
                ids, least = one["ids"].values, np.full(len(points), UNKNOWN)
                own_ids = np.array(ids.to_pylist(), object) if ids.null_count else ids.to_numpy()
                if one["least"].is_valid:
                    known = one["least"].values
                    least[known.field("at").to_numpy()] = known.field("score").to_numpy()
                at, score, vec_ids = tree.search_all(points, own_ids, tree.bounds(points), k, least)
                same = [np.full(len(at), x, np.int32) for x in (dim, block)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in (*same, at.astype(np.int32))), ids.take(pa.array(at)), pa.array(vec_ids), pa.array(score)],
                    names=[x.split()[0] for x in FOUND.split(", ")],
                )

    return both.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("dim", "block", "at").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k greatest inner products of each query.

    Both tables are ``(vec_id, embedding)`` and are made integers first. Candidates
    of a query are the rows with other ids and as many components; ties go to the
    smaller id, and repeated rows count each. Equal query rows are asked once, and
    different vectors under one id each. With fewer than k candidates all are
    returned; empty tables give an empty result. Other columns are ignored.
    """
    in_small_batches(candidates.sparkSession)  # a row has a block and a shard
    shards = build_shards(integer_vectors(candidates))
    blocks = query_blocks(integer_vectors(queries))
    found: DataFrame | None = None
    starts = [0, *ROUNDS]
    for low, high in zip(starts, [*ROUNDS, None], strict=True):
        if low and shards.where(F.col("shard") >= low).select("shard").isEmpty():
            break
        asked = blocks.withColumn("least", F.lit(None).cast("array<struct<at:int,score:long>>"))
        if found is not None:
            kth = found.where(F.col("rank") == k).groupBy("dim", "block").agg(
                F.collect_list(F.struct("at", "score")).alias("least")
            )
            asked = blocks.join(kth.hint("merge"), ["dim", "block"], "left")
        more = _search(asked, shards, k, low, high)
        if found is not None:
            more = more.unionByName(found.drop("rank"))
        found = keep_table(_best(more, k), "found")
    assert found is not None
    return found.select("query_id", "rank", "vec_id", "score")


def is_query(every: int = EVERY) -> Column:
    return F.col("vec_id") % every == 0


SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) q
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) score
  from v a join v b on a.vec_id % {EVERY} = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank,
       vec_id, score
from s qualify rank <= {K}
"""
