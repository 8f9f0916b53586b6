"""Triangle operators on hand-made and random graphs against brute force."""

from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triflux.operators import graph
from triflux.sources.edges import edges_from
from triflux.operators.graph import (
    canonical_edges,
    closed_wedges,
    closed_wedges_by_colour,
    degrees,
    edge_counts,
    is_hub,
    orient,
)
from triflux.operators.triangles import (
    count_by_triplets,
    count_exact,
    estimate_by_colours,
    estimate_by_partitions,
    list_triangles,
    median_estimate,
    monochromatic_edges,
    triangles_per_colour,
    triangles_per_triplet,
    triplet_edges,
)
from triflux.plans.jobs import count_triangles


def clique(ids):
    return list(combinations(ids, 2))


K4 = clique([1, 2, 3, 4])
GRAPHS = {
    "k3": (clique([1, 2, 3]), 1),
    "k5": (clique(range(5)), 10),
    "path4": ([(1, 2), (2, 3), (3, 4)], 0),
    "cycle4": ([(1, 2), (2, 3), (3, 4), (4, 1)], 0),
    "two_k3": (clique([1, 2, 3]) + clique([4, 5, 6]), 2),
    "bowtie": (clique([1, 2, 3]) + clique([3, 4, 5]), 2),
    "dirty": (K4 + [(v, u) for u, v in K4] + K4 + [(1, 1), (3, 3), (None, 2)], 4),
    "empty": ([], 0),
    "big_ids": (clique([262_208, 262_209, 2**31 + 5, 2**62]), 4),
    "neg_ids": (clique([-1, -9000, 7, -(2**40)]), 4),
    "mod_ids": (clique([5, 5 + 8191, 5 + 2 * 8191]), 1),
}


def frame(spark, edges):
    return spark.createDataFrame(edges, "u bigint, v bigint")


def value(df):
    row = df.collect()
    assert len(row) == 1
    return row[0][0]


def brute_force(edges):
    have = {(min(e), max(e)) for e in edges if None not in e and e[0] != e[1]}
    near = {}
    for u, v in have:
        near.setdefault(u, set()).add(v)
    return {
        (u, v, w)
        for u in near
        for v in near[u]
        for w in near.get(v, ())
        if w in near[u]
    }


def colour(x, a, b, colours):
    return ((a * x + b) % 8191) % colours


@pytest.mark.parametrize("name", GRAPHS)
def test_exact_and_triplet(spark, name):
    edges, want = GRAPHS[name]
    df = frame(spark, edges)
    assert value(count_exact(df)) == want
    assert value(count_by_triplets(df, 3, 4567, 123)) == want


def test_ids_8191_apart_share_a_colour(spark):
    df = frame(spark, GRAPHS["mod_ids"][0])
    rows = estimate_by_colours(df, 5, [(4567, 123), (89, 4000)]).collect()
    assert {(r.run, r.estimate) for r in rows} == {(0, 25), (1, 25)}


def test_runs_without_triangles_are_zero_rows(spark):
    df = frame(spark, [(1, 2)])
    runs = [(4567, 123), (89, 4000), (7, 7)]
    rows = estimate_by_colours(df, 4, runs).collect()
    assert {(r.run, r.estimate) for r in rows} == {(0, 0), (1, 0), (2, 0)}
    per_colour = triangles_per_colour(df, 4, 4567, 123).collect()
    assert {(r.colour, r.triangles) for r in per_colour} == {(c, 0) for c in range(4)}
    assert value(estimate_by_partitions(frame(spark, []), 4)) == 0


def test_one_colour_or_part_is_exact(spark):
    df = frame(spark, GRAPHS["k5"][0])
    assert value(median_estimate(estimate_by_colours(df, 1, [(4567, 123), (89, 4)]))) == 10
    assert value(estimate_by_partitions(df, 1)) == 10


def test_edge_counts(spark):
    row = edge_counts(frame(spark, GRAPHS["dirty"][0])).first()
    assert (row.raw_edges, row.edges) == (21, 6)
    assert tuple(edge_counts(frame(spark, [])).first()) == (0, 0)


def test_triplet_keys_are_distinct_per_edge(spark):
    df = triplet_edges(frame(spark, GRAPHS["k5"][0]), 4, 4567, 123)
    assert df.count() == df.distinct().count() == 10 * 4
    assert df.where("k0 > k1 or k1 > k2").count() == 0


def test_hub_table_is_bounded(spark):
    edges = frame(spark, [(0, x) for x in range(1, 200)] + clique(range(200, 212)))
    ends = 2 * (199 + 66)
    known = degrees(canonical_edges(edges))
    hubs = {r.x: r.d for r in known.where(is_hub(known, rows=2)).collect()}
    assert hubs == {0: 199}
    assert len(hubs) < max(2, ends**0.5)


@pytest.mark.parametrize("hub_rows", [1, 1_000, 1_000_000])
def test_degree_order_is_the_same_at_every_size(spark, hub_rows):
    """Fewer hubs, as a larger graph has, change neither wedges nor arrays nor salts."""
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    edges = canonical_edges(edges_from(lines, "l_partkey", "l_suppkey"))
    oriented = orient(edges, hub_rows)
    out = oriented.groupBy("src").agg(F.count("*").alias("n"))
    row = out.agg(F.sum(F.expr("n * (n - 1) div 2")), F.max("n")).first()
    assert tuple(row) == (8_832_782, 68)
    assert oriented.where("dst_d < src_d or src_d < 1").isEmpty()


def _random_edges(seed, n=60, m=500):
    import random

    rng = random.Random(seed)
    hubs = [(0, x) for x in range(1, n)] + [(1, x) for x in range(2, n)]
    return hubs + [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("hub_rows", [1, 1_000_000])
@pytest.mark.parametrize("salt_rows, send_block", [(1, 2), (7, 3), (65_536, 8_192)])
def test_salts_and_blocks_do_not_change_triangles(
    spark, monkeypatch, hub_rows, salt_rows, send_block
):
    monkeypatch.setattr(graph, "SALT_ROWS", salt_rows)
    monkeypatch.setattr(graph, "SEND_BLOCK", send_block)
    edges = _random_edges(3)
    want = brute_force(edges)
    oriented = orient(canonical_edges(frame(spark, edges)), hub_rows)
    rows = closed_wedges(oriented).select("src", "mid", F.explode("last").alias("x")).collect()
    assert len(rows) == len(want)
    assert {tuple(sorted(r)) for r in rows} == want


@pytest.mark.parametrize("salt_rows, send_block, colours", [(65_536, 8_192, 3), (2, 3, 5), (1, 1, 1)])
def test_wedges_by_colour_are_all_wedges(spark, monkeypatch, salt_rows, send_block, colours):
    monkeypatch.setattr(graph, "SALT_ROWS", salt_rows)
    monkeypatch.setattr(graph, "SEND_BLOCK", send_block)
    oriented = orient(canonical_edges(frame(spark, _random_edges(send_block))))
    found = closed_wedges_by_colour(oriented, lambda x: F.pmod(x, F.lit(colours)), colours)
    rows = found.select("src", "mid", "c", F.explode("last").alias("x")).collect()
    assert all(r.c == r.x % colours for r in rows)
    every = closed_wedges(oriented).select("src", "mid", F.explode("last").alias("x")).collect()
    assert sorted((r.src, r.mid, r.x) for r in rows) == sorted(map(tuple, every))


def test_hub_receives_through_several_salts(spark, monkeypatch):
    monkeypatch.setattr(graph, "SALT_ROWS", 10)
    # Every leaf closes a triangle with the two linked hubs 0 and 1.
    edges = [(0, 1)] + [(h, x) for h in (0, 1) for x in range(2, 402)]
    df = frame(spark, edges)
    plan = closed_wedges(orient(canonical_edges(df)))
    assert plan.select(F.size("last").alias("n")).agg(F.sum("n")).first()[0] == 400
    assert value(count_exact(df)) == 400


def test_out_arrays_stay_short_on_a_star(spark):
    edges = frame(spark, [(0, x) for x in range(1, 500)])
    longest = orient(canonical_edges(edges)).groupBy("src").count().agg(F.max("count")).first()[0]
    assert longest == 1


edge_lists = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=120)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(edge_lists, st.integers(1, 5), st.integers(1, 8190), st.integers(0, 8190))
def test_all_methods_against_brute_force(spark, edges, colours, a, b):
    df = frame(spark, edges)
    want = brute_force(edges)
    assert {tuple(r) for r in list_triangles(df).collect()} == want
    assert value(count_by_triplets(df, colours, a, b)) == len(want)
    one_coloured = [t for t in want if len({colour(x, a, b, colours) for x in t}) == 1]
    assert {r.run: r.estimate for r in estimate_by_colours(df, colours, [(a, b)]).collect()} == {
        0: colours**2 * len(one_coloured)
    }
    keys = [tuple(sorted(colour(x, a, b, colours) for x in t)) for t in want]
    per_key = triangles_per_triplet(df, colours, a, b).collect()
    assert {tuple(r)[:3]: r.triangles for r in per_key} == {k: keys.count(k) for k in keys}


def test_colour_counts_per_run_and_colour(spark):
    edges = _random_edges(5)
    want = brute_force(edges)
    runs = [(4567, 123), (89, 4000), (1234, 77)]
    df = frame(spark, edges)
    got = {r.run: r.estimate for r in estimate_by_colours(df, 2, runs).collect()}
    for i, (a, b) in enumerate(runs):
        same = [t for t in want if len({colour(x, a, b, 2) for x in t}) == 1]
        assert got[i] == 4 * len(same)
    mono = monochromatic_edges(df, 2, 4567, 123).collect()
    assert all(colour(r.u, 4567, 123, 2) == colour(r.v, 4567, 123, 2) == r.colour for r in mono)


def test_partition_estimate_is_repeatable(spark):
    df = frame(spark, _random_edges(8))
    flipped = df.select(F.col("v").alias("u"), F.col("u").alias("v")).union(df)
    first = value(estimate_by_partitions(df, 2, seed=1))
    assert first == value(estimate_by_partitions(flipped.repartition(5), 2, seed=1))
    assert first % 4 == 0


def test_method_selection(spark):
    df = frame(spark, GRAPHS["k5"][0])
    for method in ("exact", "exact_triplet", "colour", "partition"):
        assert count_triangles(df, method, colours=1, runs=3, seed=5).columns == ["triangles"]
        assert value(count_triangles(df, method, colours=1, runs=3, seed=5)) == 10
    for bad in ({"method": "x"}, {"colours": 0}, {"runs": 0}):
        with pytest.raises(ValueError):
            count_triangles(df, **bad)


def test_parts_bought_together(spark):
    import duckdb

    edges = duckdb.sql(
        """
        with p as (select distinct l_orderkey o, l_partkey p
                   from '/root/testdata/sf0.001/lineitem.parquet')
        select distinct a.p u, b.p v from p a join p b on a.o = b.o and a.p < b.p
        """
    ).fetchall()
    df = frame(spark, edges)
    assert len(edges) == 8_899
    assert value(count_exact(df)) == 125_968
