"""Hard negatives against all scores by plain arithmetic."""

import random
from collections import Counter

import numpy as np
import pytest

from triflux.llm.hard_negatives import best, bit_planes, hard_negatives, inner_products, subset_sums

SCHEMA = "vec_id long, embedding array<double>, label int, score string, dim string"


@pytest.mark.parametrize("dim, top", [(1, 1), (8, 5), (11, 300), (64, 2**26 - 1), (0, 1)])
def test_scores_are_exact(dim, top):
    rng = np.random.default_rng(dim)
    rows, anchors = rng.integers(-top - 1, top + 1, (700, dim)), rng.integers(-top, top + 1, (9, dim))
    if dim:
        rows[0], rows[1], anchors[0] = -top - 1, top, top
    got = inner_products(bit_planes(rows), subset_sums(anchors))
    want = [[sum(int(x) * int(y) for x, y in zip(r, a)) for a in anchors] for r in rows]
    assert got.tolist() == want


def test_best_of_each_column_with_ties():
    rng = np.random.default_rng(2)
    scores, allowed = rng.integers(-2, 3, (40, 6)), rng.random((40, 6)) < 0.3
    allowed[:, 0] = False
    for k in (1, 3, 50):
        columns, rows = best(scores, allowed, k)
        want = []
        for c in range(6):
            ranked = sorted((-scores[r, c], r) for r in range(40) if allowed[r, c])
            want += [(c, r) for _, r in ranked[:k]]
        assert list(zip(columns.tolist(), rows.tolist())) == want


def slow(rows):
    good = []
    for k, v, label, *_ in rows:
        if k is not None and label is not None and v is not None:
            if all(x is not None and np.isfinite(x) for x in v):
                label = int(np.fmod(label + 1, 10)) if k % 7 == 0 else label
                good.append((k, label, tuple(int(np.floor(256 * x)) for x in v)))
    out = []
    for k, label, v in sorted({x for x in good if x[0] % 50 == 0}):
        scored = [(-sum(a * b for a, b in zip(v, w)), i, m) for i, m, w in good if i != k and len(w) == len(v)]
        scored.sort()
        for s, i, _ in [x for x in scored if x[2] == label][:5]:
            hard = [(j, t) for t, j, m in scored if m != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(k, i, r + 1, j, -s, -t) for r, (j, t) in enumerate(hard[:3])]
    return Counter(out)


@pytest.mark.parametrize("block, shard", [(512, 4096), (2, 7)])
def test_equals_brute_force(spark, block, shard):
    rng = random.Random(shard)
    draw = lambda n: [rng.choice((-1.5, -0.3, 0.25, 0.5, 1.0, 2.0)) for _ in range(n)]
    rows = [(k * 5, draw(9), rng.randrange(4), "x", "y") for k in range(150)]
    rows += [(50, rows[10][1], rows[10][2], "x", "y"), (50, draw(9), 1, "x", "y"), rows[3], rows[3]]
    rows += [(100, draw(3), 1, "x", None), (101, draw(3), 1, "x", None), (102, [0.0] * 3, 2, "x", None)]
    rows += [(150, [0.0] * 9, 1, "x", "y"), (200, [], 1, "", ""), (201, [], 1, "", ""), (202, [], 2, "", "")]
    rows += [(250, None, 1, "", ""), (300, draw(9), None, "", ""), (None, draw(9), 1, "", "")]
    rows += [(350, [None] + draw(8), 1, "", ""), (400, [float("nan")] * 9, 1, "", ""), (450, [float("inf")] * 9, 1, "", "")]
    rows += [(k, [float(k % 3)] * 9, -3, "", "") for k in (-50, -7, -1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = hard_negatives(df, block_rows=block, shard_rows=shard).collect()
    assert Counter(map(tuple, got)) == slow(rows)


def test_empty_table_and_large_components(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty).count() == 0
    none = spark.createDataFrame([(1, [1.0], 1, "", ""), (2, [1.0], 2, "", "")], SCHEMA)
    assert hard_negatives(none).count() == 0
    with pytest.raises(Exception, match="too large"):
        hard_negatives(spark.createDataFrame([(0, [1e30], 1, "", "")], SCHEMA))
