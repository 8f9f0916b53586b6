import pytest
from pyspark.sql import functions as F

from triflux.functions.hashing import (
    PRIME,
    SketchParams,
    bucket_hash,
    draw_runs,
    linear_hash,
    sign_hash,
)
from triflux.functions.median import decimal_median, integer_median

IDS = [0, 1, 8190, 8191, 8192, 262_208, 2**31, 2**62, -1, -7, -8191, -(2**40)]


def test_hashes_match_integer_arithmetic(spark):
    a, b, buckets = 8190, 8000, 7
    rows = spark.createDataFrame([(x,) for x in IDS], "x bigint").select(
        "x",
        linear_hash(F.col("x"), a, b).alias("h"),
        bucket_hash(F.col("x"), a, b, buckets).alias("c"),
        sign_hash(F.col("x"), a, b).alias("g"),
    )
    for x, h, c, g in rows.collect():
        want = (a * x + b) % PRIME
        assert (h, c, g) == (want, want % buckets, 1 if want % 2 else -1)


def test_larger_prime(spark):
    p = 2**31 - 1
    rows = spark.createDataFrame([(x,) for x in IDS], "x bigint")
    got = rows.select("x", linear_hash(F.col("x"), p - 1, p - 2, p)).collect()
    assert all(h == ((p - 1) * x + p - 2) % p for x, h in got)


@pytest.mark.parametrize(
    "values, want",
    [([5], 5), ([1, 2], 1), ([-3, 0], -1), ([-1, 4], 1), ([9, 1, 5], 5), ([4, 1, 3, 2], 2)],
)
def test_median(spark, values, want):
    frame = spark.createDataFrame([(values,)], "v array<bigint>")
    assert frame.select(integer_median(F.col("v"))).first()[0] == want


def test_decimal_median(spark):
    big = 10**30
    frame = spark.sql(f"select array({big + 1}, {big + 4}, cast(3 as decimal(38,0)), {big * 9}) v")
    v = F.col("v").cast("array<decimal(38,0)>")
    assert frame.select(decimal_median(v)).first()[0] == big + 2


def test_draws_are_reproducible_and_in_range():
    assert draw_runs(5, 42) == draw_runs(5, 42) != draw_runs(5, 43)
    assert all(1 <= a < PRIME and 0 <= b < PRIME for a, b in draw_runs(200, 1))
    params = SketchParams.draw(3, 16, 42)
    assert params == SketchParams.draw(3, 16, 42)
    assert params.depth == 3


@pytest.mark.parametrize(
    "make",
    [
        lambda: draw_runs(0, 1),
        lambda: SketchParams(0, [(1, 0, 1, 0)]),
        lambda: SketchParams(4, []),
        lambda: SketchParams(4, [(0, 0, 1, 0)]),
        lambda: SketchParams(4, [(1, PRIME, 1, 0)]),
        lambda: SketchParams(4, [(1, 0, 1, 0)], p=2**40),
    ],
)
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()
