"""Top k by blocks and stripes: what is sent and broadcast, and that results stay exact."""

import re

import numpy as np
import pyarrow.parquet as pq
import pyspark.sql.functions as F

from triflux.functions.scratch import keep_table
from triflux.llm import top_k
from triflux.llm.ball_tree import UNKNOWN, BallTree


def vectors(n, dim=3):
    rng = np.random.default_rng(n)
    return [(i, [float(x) for x in rng.integers(-6, 7, dim) / 4]) for i in range(n)]


def test_a_block_is_searched_as_its_queries_one_by_one():
    rng = np.random.default_rng(3)
    rows, ids = rng.integers(-9, 9, (500, 4)), rng.permutation(500)
    ids[:5] = ids[5]
    tree = BallTree.build(rows, ids, leaf=16)
    queries, own = rows[:90], ids[:90]
    bounds, least = tree.bounds(queries), np.full(90, UNKNOWN)
    least[::3] = 40
    at, score, found = tree.search_all(queries, own, bounds, 7, least)
    got = list(zip(at.tolist(), (-score).tolist(), found.tolist()))
    want = []
    for i, (q, k) in enumerate(zip(queries, own)):
        ranked = sorted((-int(s), int(x)) for s, x in zip(rows @ q, ids) if x != k and s >= least[i])
        want += [(i, *x) for x in ranked[:7]]
    assert got == want


def test_scores_beyond_doubles_are_exact():
    rows = np.array([[2**26, 2**26, 1], [2**26, 2**26, 0], [2**26, 2**26, 2]]) * 2
    tree = BallTree.build(rows, np.array([5, 6, 7]))
    query = np.array([[2**26, 2**26, 1]])
    at, score, ids = tree.search_all(query, np.array([9]), tree.bounds(query), 2)
    assert at.tolist() == [0, 0] and ids.tolist() == [7, 5]
    assert score.tolist() == [2**54 + 4, 2**54 + 2]


def test_blocks_go_to_stripes_and_no_side_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(top_k, "STRIPES", 4)
    rows = vectors(900)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    shards = top_k.build_shards(top_k.integer_vectors(df), 10)
    assert shards.count() == 90
    blocks = top_k.query_blocks(top_k.integer_vectors(df.where("vec_id % 10 = 0")), 20)
    blocks = blocks.withColumn("least", F.lit(None).cast("array<struct<at:int,score:long>>"))
    found = top_k._search(blocks, shards, 2, 8, None, 10)
    assert len(found.collect()) > 90
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [dim" in plan and "collect_set" not in plan
    # Four stripes of 22 shards, or five: a block goes to each, not to each of 82 shards.
    stripe = top_k._stripes(shards, 8, None, 10).first()
    assert (stripe.width, stripe.first, stripe.last) == (22, 0, 4)


def test_top_k_over_many_stripes(spark, monkeypatch):
    monkeypatch.setattr(top_k, "STRIPES", 4)
    monkeypatch.setattr(top_k.build_shards, "__defaults__", (10,))
    monkeypatch.setattr(top_k.query_blocks, "__defaults__", (2,))
    rows = vectors(900) + vectors(30, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_k.top_k(df, df.where(top_k.is_query()), 4).collect())
    whole = [(k, np.floor(1024 * np.array(v))) for k, v in rows]
    want = set()
    for k, v in whole:
        if k % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in whole if i != k and len(w) == len(v))[:4]
            want |= {(k, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert sorted(want) == sorted(set(got))


def test_long_rows_make_small_row_groups(spark):
    parts = "transform(sequence(1, 32768), k -> md5(cast(id * 65536 + k as string)))"
    long = spark.range(0, 60).select(F.expr(f"unhex(array_join({parts}, '')) as x"))
    files = keep_table(long.repartition(1), "long", long_rows=True).inputFiles()
    path = re.sub("^file:/+", "/", files[0])
    groups = pq.ParquetFile(path).metadata
    assert groups.num_rows == 60 and groups.num_row_groups > 1
