"""Histograms, count sketches and their statistics against plain Python."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from triflux.functions.hashing import PRIME, SketchParams
from triflux.operators import sketch as sketch_module
from triflux.operators.histogram import (
    at_least_kth,
    by_frequency,
    histogram,
    histogram_of,
    item_counts,
    kth_frequency,
    second_moment,
    top_k,
)
from triflux.operators.sketch import (
    count_sketch,
    estimate_frequencies,
    merge_sketches,
    normalised_estimate,
    second_moment_estimate,
    top_k_error,
    top_k_estimates,
)
from triflux.plans.jobs import report_on_counts, report_on_items

PARAMS = SketchParams.draw(5, 8, seed=11)
EVEN = SketchParams.draw(4, 8, seed=12)


def frame(spark, items):
    return spark.createDataFrame([(x,) for x in items], "item bigint")


def median(values):
    a = sorted(values)
    low, high = a[(len(a) - 1) // 2], a[len(a) // 2]
    return int((low + high) / 2)


def hashes(x, row, params):
    ah, bh, ag, bg = row
    g = 1 if ((ag * x + bg) % params.p) % 2 else -1
    return ((ah * x + bh) % params.p) % params.width, g


def cells_of(items, params):
    cells = Counter()
    for x in items:
        for r, row in enumerate(params.rows):
            c, g = hashes(x, row, params)
            cells[r, c] += g
    return cells


def estimate_of(x, cells, params):
    signed = []
    for r, row in enumerate(params.rows):
        c, g = hashes(x, row, params)
        signed.append(cells[r, c] * g)
    return median(signed)


def collect_cells(df):
    return {(r.r, r.c): r.cell for r in df.collect()}


def some_items(seed, n=400):
    rng = random.Random(seed)
    return [int(rng.expovariate(0.05)) - 5 for _ in range(n)] + [7] * n


@pytest.mark.parametrize("params", [PARAMS, EVEN], ids=["odd", "even"])
def test_sketch_and_estimates(spark, params):
    items = some_items(1)
    df = frame(spark, items)
    cells = cells_of(items, params)
    built = count_sketch(df, params)
    got = collect_cells(built)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in cells.items() if v}
    hist = histogram(df, -100, 10_000)
    assert collect_cells(count_sketch(hist, params, "f")) == got
    for x, f, fhat in estimate_frequencies(hist, built, params).collect():
        assert f == items.count(x)
        assert fhat == estimate_of(x, cells, params)
    squares = [sum(v * v for (r, _), v in cells.items() if r == i) for i in range(params.depth)]
    assert second_moment_estimate(built, params).first()[0] == median(squares)


@pytest.mark.parametrize("p, salt_rows", [(PRIME, 3), (11, 3), (11, 65_536)])
def test_estimates_without_broadcast(spark, p, salt_rows):
    # With a small prime all items fall into few cells.
    params = SketchParams.draw(3, 8, seed=5, p=p)
    items = [x % 97 for x in range(400)]
    hist = histogram(frame(spark, items), 0, 96)
    cells = count_sketch(hist, params, "f")
    small = estimate_frequencies(hist, cells, params).collect()
    wide = estimate_frequencies(hist, cells, params, broadcast_cells=0, salt_rows=salt_rows)
    assert sorted(wide.collect()) == sorted(small) and len(small) == 97


def test_a_sketch_is_wide_by_the_cells_that_can_be_filled(spark):
    hist = histogram(frame(spark, [1, 2, 2]), 0, 9)

    def joined(params):
        found = estimate_frequencies(hist, count_sketch(hist, params, "f"), params)
        return found._jdf.queryExecution().optimizedPlan().toString().count("merge")

    assert joined(SketchParams.draw(3, 10**6, seed=1)) == 0
    assert joined(SketchParams.draw(3, 10**6, seed=1, p=2**31 - 1)) > 0


def test_items_not_in_the_sketch(spark):
    built = count_sketch(frame(spark, []), PARAMS)
    rows = estimate_frequencies(frame(spark, [1, 2]), built, PARAMS).collect()
    assert {(r.item, r.fhat) for r in rows} == {(1, 0), (2, 0)}


def test_sketches_add_up(spark):
    a, b = some_items(3), some_items(4)
    parts = merge_sketches(*[count_sketch(frame(spark, x), PARAMS) for x in (a, b)])
    assert collect_cells(parts) == collect_cells(count_sketch(frame(spark, a + b), PARAMS))


def test_wide_sketch_without_collisions_is_exact(spark):
    params = SketchParams(PRIME, [(1, 0, 5, 3)])
    hist = histogram(frame(spark, some_items(5)), -100, 8000)
    built = count_sketch(hist, params, "f")
    assert estimate_frequencies(hist, built, params).where("f <> fhat").count() == 0


def test_small_stream(spark):
    items = frame(spark, [1, 1, 1, 2, 2, 3, 9])
    hist = histogram(items, 1, 3)
    moments = second_moment(hist).first()
    assert (moments.n_in_range, moments.n_distinct) == (6, 3)
    assert moments.f2 == 14 / 36
    assert kth_frequency(hist, 1).first().kf == 3
    counts = item_counts(items, 1, 3)
    assert {(r.item, r.n) for r in counts.collect()} == {(1, 3), (2, 2), (3, 1), (None, 1)}
    assert sorted(map(tuple, histogram_of(counts).collect())) == [(1, 3), (2, 2), (3, 1)]
    report = report_on_counts(counts, PARAMS, 1).first()
    assert report == report_on_items(items, 1, 3, PARAMS, 1).first()
    assert (report.n_total, report.n_in_range, report.n_distinct) == (7, 6, 3)
    assert report.f2 == 14 / 36
    built = count_sketch(hist, PARAMS, "f")
    assert report.f2_est == normalised_estimate(built, PARAMS, hist).first().f2_est
    assert report.avg_err == top_k_error(hist, built, PARAMS, 1).first().avg_err


def test_ties_at_rank_k(spark):
    items = [4] * 9 + [5] * 6 + [2] * 6 + [8]
    hist = histogram(frame(spark, items), 0, 10)
    assert [r.item for r in top_k(hist, 2).collect()] == [4, 2]
    assert [tuple(r) for r in by_frequency(hist).collect()] == [(4, 9), (2, 6), (5, 6), (8, 1)]
    assert {r.item for r in at_least_kth(hist, 2).collect()} == {4, 5, 2}
    cells = cells_of(items, PARAMS)
    true = {x: items.count(x) for x in (4, 5, 2)}
    errors = [abs(f - estimate_of(x, cells, PARAMS)) / f for x, f in true.items()]
    built = count_sketch(hist, PARAMS, "f")
    assert top_k_error(hist, built, PARAMS, 2).first()[0] == pytest.approx(sum(errors) / 3)
    listed = top_k_estimates(hist, built, PARAMS, 2).collect()
    assert {(r.item, r.f) for r in listed} == {(4, 9), (2, 6)}


def test_fewer_items_than_k_and_empty_streams(spark):
    hist = histogram(frame(spark, [1, 1, 2]), 0, 10)
    assert kth_frequency(hist, 50).first().kf == 1
    assert at_least_kth(hist, 50).count() == 2
    report = report_on_items(frame(spark, []), 0, 10, PARAMS, 3).first()
    assert tuple(report) == (0, 0, 0, None, None, None)
    with pytest.raises(ValueError):
        top_k(hist, 0)


def test_second_moment_beyond_bigint(spark):
    f = 10**12
    hist = spark.createDataFrame([(1, f), (2, f)], "item bigint, f bigint")
    moments = second_moment(hist).first()
    assert int(moments.f2_raw) == 2 * f * f
    assert moments.f2 == 0.5
    one_row = SketchParams(PRIME, [(1, 0, 5, 3)])
    built = count_sketch(hist, one_row, "f")
    assert int(second_moment_estimate(built, one_row).first()[0]) == 2 * f * f


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-(2**40), 2**40), max_size=80), st.integers(0, 1000))
def test_row_sums_and_linearity(spark, items, seed):
    params = SketchParams.draw(3, 5, seed)
    got = collect_cells(count_sketch(frame(spark, items), params))
    want = cells_of(items, params)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("k", [1, 2, 5, 6, 7, 30, 31, 1_000])
def test_top_k_cuts_ties_by_item(spark, k):
    rng = random.Random(k)
    wanted = [rng.randrange(-(2**62), 2**62) for _ in range(20)] + [-1, 0, 1, 2**41, 2**42, 2**62]
    counts = {x: rng.choice((1, 1, 1, 2, 3, 900)) for x in wanted}
    hist = spark.createDataFrame(list(counts.items()), "item bigint, f bigint").repartition(5)
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in top_k(hist, k, 0).collect()] == ranked[:k]
    assert [tuple(r) for r in top_k(hist, k).collect()] == ranked[:k]
    assert kth_frequency(hist, k, 0).first().kf == ranked[:k][-1][1]
    assert sorted(map(tuple, at_least_kth(hist, k, 0).collect())) == sorted(
        x for x in ranked if x[1] >= ranked[:k][-1][1]
    )
    assert top_k(hist.limit(0), k, 0).count() == 0 and kth_frequency(hist.limit(0), k, 0).first().kf is None
