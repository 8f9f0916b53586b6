"""Bounded layouts: the same counts in shares, and no files left of what has been counted."""

import itertools
import random
import time

from triflux.functions import scratch
from triflux.operators import graph
from triflux.operators.graph import lay_out
from triflux.operators.triangles import estimate_by_colours, list_triangles, triangles_per_triplet
from triflux.plans import registry
from triflux.plans.jobs import METHODS, count_triangles

SF = "/root/testdata/sf0.001"
CONF = scratch._CLEANUP


def blocks(spark):
    """Files that shuffles have on disk now; they are removed in the background."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return disk.getAllBlocks().mkString(" ").count("shuffle_")


def random_edges(spark, n=60, m=700):
    rng = random.Random(m)
    rows = [(rng.randrange(n) - 9, rng.randrange(n) - 9) for _ in range(m)] + [(None, 3), (4, None), (5, 5)]
    known = {frozenset(x) for x in rows if None not in x and x[0] != x[1]}
    ends = sorted({x for e in known for x in e})
    count = sum(
        frozenset(e) <= known
        for t in itertools.combinations(ends, 3)
        for e in [{frozenset(x) for x in itertools.combinations(t, 2)}]
    )
    return spark.createDataFrame(rows, "u long, v long"), count


def test_shares_count_every_triangle_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARE_LEAST", 1_500)
    monkeypatch.setattr(graph, "SHARE_PER_EDGE", 1)
    monkeypatch.setattr(graph, "SEND_BLOCK", 3)
    edges, count = random_edges(spark)
    layout = lay_out(edges, bounded=True)
    assert layout.shares >= 2
    for method in METHODS:
        colours = 3 if method == "exact_triplet" else 1
        assert count_triangles(layout, method, colours, runs=3).first().triangles == count, method
    plain = lay_out(edges)
    assert plain.shares is None
    runs = [(5, 7), (11, 3)]
    both = [estimate_by_colours(x, 2, runs).orderBy("run").collect() for x in (plain, layout)]
    assert both[0] == both[1]
    both = [sorted(map(tuple, triangles_per_triplet(x, 3, 5, 7).collect())) for x in (plain, layout)]
    assert both[0] == both[1]
    assert list_triangles(layout).count() == count


def test_an_empty_graph_has_one_share(spark):
    layout = lay_out(spark.createDataFrame([], "u long, v long"), bounded=True)
    assert layout.shares == 1
    assert [count_triangles(layout, m, 2).first().triangles for m in METHODS] == [0] * 4


def test_files_go_with_the_count_that_needed_them(spark):
    before, kept = blocks(spark), list(scratch._paths)
    setting = spark.conf.get(CONF, None)
    counts = registry.QUERIES["triangles_by_method"](spark, SF)
    assert spark.conf.get(CONF, None) == setting
    for _ in range(20):
        if blocks(spark) <= before:
            break
        time.sleep(0.5)
    assert blocks(spark) <= before
    left = [x.rpartition("/")[2].partition("-")[0] for x in scratch._paths if x not in kept]
    assert sorted(left) == ["adjacency"] + ["counts"] * 4
    assert len(counts.collect()) == 4
