import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score double, row string"


def brute(rows, is_anchor, scale=256, positives=5, k=10, low=30, high=90):
    usable = []
    for i, vec, label in rows:
        if i is None or label is None or not vec or any(x is None or not math.isfinite(x) for x in vec):
            continue
        usable.append((i, [math.floor(scale * x) for x in vec], label))
    out = []
    for a, (i, vec, label) in enumerate(usable):
        if not is_anchor(i):
            continue
        scored = [
            (-sum(p * q for p, q in zip(vec, v)), j, other == label) for b, (j, v, other) in enumerate(usable) if b != a and len(v) == len(vec)
        ]
        scored.sort(key=lambda s: s[:2])
        for s, j, _ in [s for s in scored if s[2]][:positives]:
            window = [(n, m) for n, m, same in scored if not same and -low * s <= -100 * n <= -high * s][:k]
            out += [(i, j, rank + 1, m, -s, -n) for rank, (n, m) in enumerate(window)]
    return sorted(out)


def mined(spark, rows, step=3, **options):
    frame = spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(frame, F.col("vec_id") % step == 0, **options).collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(150):
        centre = rng.choice(centres)
        rows.append((i, [c + rng.gauss(0, 0.3) for c in centre], rng.randint(0, 2)))
    same = [0.5, 0.25, 0.0, -0.5, 1.0, 0.125]
    rows += [(200 + i, same, i % 3) for i in range(40)]  # ties
    rows += [rows[3], rows[3], rows[6]]  # repeated rows
    rows += [(300, [1.0, 2.0], 0), (301, [1.0, 2.5], 0), (303, [1.0, 1.0], 1), (306, [0.5, 0.5], 2)]  # another length
    rows += [(400, None, 1), (402, [], 1), (405, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (408, [math.nan] * 6, 0), (411, [math.inf] * 6, 0)]
    rows += [(None, same, 1), (414, same, None), (417, [0.0] * 6, 1), (420, [0.0] * 6, 1), (423, [-x for x in same], 2)]
    return rows


@pytest.mark.parametrize("options", [{}, {"anchors_at_once": 7, "rows_per_block": 5}, {"references": 1}, {"references": 60, "rows_per_block": 1}])
def test_brute_force(spark, vectors, options):
    assert mined(spark, vectors, **options) == brute(vectors, lambda i: i % 3 == 0)


def test_other_numbers(spark, vectors):
    got = mined(spark, vectors, positives=2, negatives=3, low=0, high=120, scale=16)
    assert got == brute(vectors, lambda i: i % 3 == 0, 16, 2, 3, 0, 120)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    ints = rng.integers(-300, 300, (400, 8))
    ints[0] = 0
    lengths = negatives.norms(ints)
    units = ints[1:] / lengths[1:, None]
    marks = negatives.angles(ints, lengths, negatives.spread_out(units, 12))
    exact = negatives.scores(ints, ints, 1.0)
    for low in range(0, 400, 20):
        block = slice(low, low + 20)
        lower, upper = negatives.score_bounds(marks, lengths, marks[block].min(axis=0), marks[block].max(axis=0), lengths[block].min(), lengths[block].max())
        assert (exact[:, block] <= upper[:, None]).all() and (exact[:, block] >= lower[:, None]).all()


def test_far_blocks_are_not_scored(monkeypatch):
    """Two tight bundles at a right angle: only the near one reaches a window."""
    rng = np.random.default_rng(2)
    bundles = [np.eye(4)[k] * 1000 + rng.integers(-5, 5, (30, 4)) for k in (0, 1)]
    ints = np.concatenate(bundles).astype(np.int64)
    lengths = negatives.norms(ints)
    marks = negatives.angles(ints, lengths, negatives.spread_out(ints / lengths[:, None], 2))
    lower, upper = negatives.score_bounds(marks[:1], lengths[:1], marks[30:].min(axis=0), marks[30:].max(axis=0), lengths[30:].min(), lengths[30:].max())
    assert upper[0] < 0.05 * 1e6 and lower[0] > -0.05 * 1e6


def test_large_components(spark):
    big = [(0, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [2e6, 5.0], 0), (3, [-4e6, 1.0], 0)]
    assert mined(spark, big, scale=256) == brute(big, lambda i: i % 3 == 0)
    with pytest.raises(OverflowError):
        negatives.whole(np.array([1e17]), 256)
    with pytest.raises(OverflowError):
        negatives.scores(np.ones((1, 1)), np.ones((1, 1)), 1e19)


def test_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == []
