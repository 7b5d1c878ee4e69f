import itertools
import random

import pytest

from tagloom.operators import metrics as M

NAMES = ("a", "b", "c")


def frame(spark, rows, labels=NAMES):
    columns = [f"{p}_{l}" for p in ("true", "pred") for l in labels]
    return spark.createDataFrame([(*t, *p) for t, p in rows], ", ".join(f"{c} int" for c in columns))


def ratio(a, b):
    return a / b if b else 0.0


def spec(rows, empty=1.0):
    n, k = len(rows), len(rows[0][0])
    out = {
        "exact_match_ratio": sum(t == p for t, p in rows) / n,
        "accuracy": sum(x == y for t, p in rows for x, y in zip(t, p)) / n / k,
    }
    per_row, jaccard = [], 0.0
    for t, p in rows:
        both, union = sum(x & y for x, y in zip(t, p)), sum(x | y for x, y in zip(t, p))
        jaccard += both / union if union else empty
        per_row.append((ratio(both, sum(p)), ratio(both, sum(t)), ratio(2 * both, sum(t) + sum(p))))
    out["hamming_score"] = jaccard / n
    counts = [
        (sum(t[i] & p[i] for t, p in rows), sum(p[i] for _, p in rows), sum(t[i] for t, _ in rows)) for i in range(k)
    ]
    prf = [(ratio(a, b), ratio(a, c), ratio(2 * a, b + c)) for a, b, c in counts]
    tp, pp, tt = (sum(c[i] for c in counts) for i in range(3))
    micro = (ratio(tp, pp), ratio(tp, tt), ratio(2 * tp, pp + tt))
    for i, name in enumerate(("precision", "recall", "f1")):
        out[f"micro_{name}"] = micro[i]
        out[f"macro_{name}"] = sum(x[i] for x in prf) / k
        out[f"weighted_{name}"] = ratio(sum(x[i] * c[2] for x, c in zip(prf, counts)), tt)
        out[f"samples_{name}"] = sum(x[i] for x in per_row) / n
    for label, x in zip(NAMES, prf):
        out[f"f1_{label}"] = x[2]
    return out


@pytest.mark.parametrize("seed, empty", [(1, 1.0), (2, 0.0), (3, 1.0)])
def test_all_metrics(spark, seed, empty):
    rng = random.Random(seed)
    rows = [
        (tuple(rng.random() < 0.4 for _ in NAMES[:2]) + (0,), tuple(rng.random() < 0.4 for _ in NAMES)) for _ in range(60)
    ]
    rows = [(tuple(map(int, t)), tuple(map(int, p))) for t, p in rows] + [((0, 0, 0), (0, 0, 0))]
    got = {r.metric: r.value for r in M.compute_metrics(frame(spark, rows), NAMES, empty_value=empty).collect()}
    assert got == pytest.approx(spec(rows, empty))
    assert got["micro_recall"] == pytest.approx(got["weighted_recall"])
    assert got["accuracy"] >= got["exact_match_ratio"]


def test_small_known_values(spark):
    rows = [((0, 1), (0, 1)), ((1, 1), (0, 1)), ((0, 0), (1, 1)), ((1, 0), (1, 0))]
    got = M.metrics_wide(frame(spark, rows, ("a", "b")), ("a", "b")).first()
    assert (got.exact_match_ratio, got.accuracy, got.hamming_score) == (0.5, 0.625, 0.625)


def test_report_and_confusion(spark):
    rows = [((1, 0, 0), (1, 1, 0)), ((0, 1, 0), (0, 1, 0)), ((1, 1, 0), (0, 0, 0))]
    table = frame(spark, rows)
    confusion = {r.label: (r.tp, r.fp, r.fn, r.tn) for r in M.confusion_by_label(table, NAMES).collect()}
    assert confusion == {"a": (1, 0, 1, 1), "b": (1, 1, 1, 0), "c": (0, 0, 0, 3)}
    report = {r["name"]: r for r in M.classification_report(table, NAMES).collect()}
    assert report["c"].f1 == 0 and report["micro avg"].support == 4
    assert report["macro avg"].precision == pytest.approx((1 + 0.5 + 0) / 3)


def test_auroc(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), 1, round(rng.random(), 2), rng.random()) for _ in range(2000)]
    table = spark.createDataFrame(rows, "true_a int, true_b int, score_a double, score_b double")
    got = {r.label: r.auroc for r in M.auroc_by_label(table, ("a", "b")).collect()}
    pos = [s for y, _, s, _ in rows if y]
    neg = [s for y, _, s, _ in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    assert got["a"] == pytest.approx(wins / len(pos) / len(neg)) and got["b"] is None


def test_threshold_search_prefers_the_earlier_grid_entry(spark):
    table = spark.createDataFrame([(0.9, 1), (0.1, 0)], "score_a double, true_a int")
    assert M.score_threshold_search(table, (0.3, 0.4, 0.5), ("a",)).first().threshold == 0.3
    strict = M.threshold_scores(table, 0.9, strict=True, labels=("a",)).first()
    assert strict.pred_a == 0
