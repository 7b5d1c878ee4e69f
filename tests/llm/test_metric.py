import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import metric
from tagloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, node string, vec int, home string"


def by_hand(rows, threshold=0.9):
    """(id, n_links, component) of (id, vector) rows, all pairs."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    label, links = list(range(len(rows))), [0] * len(rows)
    for i in good:
        for j in good:
            if j < i and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
    least = {g: min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=None) for g in label}
    return sorted(((i, n, least[g]) for (i, _), n, g in zip(rows, links, label)), key=repr)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x", 1, None) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in metric.near_duplicates(frame, **options).collect()), key=repr)


def clusters(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(int(i), (centres[rng.integers(6)] + spread * rng.normal(size=dim)).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("seed,dim,spread,options", [
    (1, 8, 0.4, dict(cell_rows=10)), (2, 3, 0.5, dict(cell_rows=7, max_pivots=5)), (3, 16, 0.2, dict()), (4, 2, 0.3, dict(cell_rows=4, max_pivots=40)),
])
def test_like_all_pairs(spark, seed, dim, spread, options):
    rows = clusters(seed, 120, dim, spread)
    assert run(spark, rows, **options) == by_hand(rows)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (5, [1.0, 0.0]), (4, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 0.0]), (10, None), (11, [nan, 1.0]), (12, [inf, 1.0]),
        (13, [1.0, None]), (14, []), (None, [1.0, 0.1]), (None, None), (15, [1.0, 0.0, 0.0]), (16, [5.0, 0.0, 0.1]), (17, [-0.0, 1e-300]), (18, [0.0, 1e300]), (1, [-1.0, 0.0]),
    ]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, []) == []
    assert run(spark, rows, max_pivots=1) == by_hand(rows)


def test_hot_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(100 + i, [1.0, 2.0, 3.0 + i / 100]) for i in range(50)]
    assert run(spark, rows, cell_rows=8) == by_hand(rows)


def test_lending_follows_the_bound():
    rng = np.random.default_rng(0)
    units = metric._units(rng.normal(size=(400, 6)))
    pivots = metric.Pivots({6: metric._units(rng.normal(size=(9, 6)))}, float(np.sqrt(0.2)))
    home, lend = pivots.assign(units)
    near = units @ units.T >= 0.9
    for i, j in zip(*np.nonzero(near)):
        assert home[i] == home[j] or lend[i, home[j]] or lend[j, home[i]]
    assert lend.mean() < 0.45


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = QUERIES["op7_embedding_near_dedup"](spark, sf_dir)
    assert got.where(F.col("kept") != (F.col("vec_id") == F.col("component_id"))).count() == 0
    assert sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id").collect()), key=repr) == by_hand(rows)
