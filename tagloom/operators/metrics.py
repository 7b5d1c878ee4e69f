"""Multi-label evaluation over wide prediction tables.

A row holds ``true_<label>`` and ``pred_<label>`` columns.  By-row measures are
row expressions and by-label counts are plain sums, so every report needs one
pass with map-side aggregation and shuffles one row per task.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import LABELS, PUBLISHED_METRICS, SCORE_GRID
from ..staging import stage

AVERAGES = ("micro", "macro", "weighted", "samples")
PRF = ("precision", "recall", "f1")


def _total(terms):
    return "(" + " + ".join(terms) + ")"


def _ratio(top, bottom):
    return f"if({bottom} > 0, {top} / {bottom}, 0D)"


def stack(names, *rows):
    """SQL that turns one row into several: ``rows`` hold one expression per name."""
    cells = ", ".join(", ".join(row) for row in rows)
    return f"stack({len(rows)}, {cells}) AS ({', '.join(names)})"


def threshold_scores(scored, threshold=0.5, strict=False, labels=LABELS, score="score_", pred="pred_"):
    """Scores to 0/1 predictions: ``>=`` or, if ``strict``, ``>``."""
    reached = ">" if strict else ">="
    return scored.withColumns(
        {f"{pred}{l}": F.expr(f"cast({score}{l} {reached} {float(threshold)}D AS int)") for l in labels}
    )


def metric_sums(table, labels=LABELS, by=(), true="true_", pred="pred_", empty_value=1.0):
    """All sums any metric needs, one row per group of ``by``."""
    cells = table.selectExpr(
        *by,
        *[f"cast({true}{l} AS int) AS t_{l}" for l in labels],
        *[f"cast({pred}{l} AS int) AS p_{l}" for l in labels],
    )
    rows = cells.selectExpr(
        "*",
        _total([f"t_{l} * p_{l}" for l in labels]) + " AS _both",
        _total([f"p_{l}" for l in labels]) + " AS _pred",
        _total([f"t_{l}" for l in labels]) + " AS _true",
        _total([f"cast(t_{l} = p_{l} AS int)" for l in labels]) + " AS _equal",
    )
    sums = {
        "n": "count(1)",
        "exact": f"count_if(_equal = {len(labels)})",
        "cells": "sum(_equal)",
        "jaccard": f"sum(if(_pred + _true = 0, {float(empty_value)}D, _both / (_pred + _true - _both)))",
        "row_precision": f"sum({_ratio('_both', '_pred')})",
        "row_recall": f"sum({_ratio('_both', '_true')})",
        "row_f1": f"sum({_ratio('(2 * _both)', '(_pred + _true)')})",
    }
    for l in labels:
        sums |= {f"tp_{l}": f"sum(t_{l} * p_{l})", f"pp_{l}": f"sum(p_{l})", f"tt_{l}": f"sum(t_{l})"}
    return rows.groupBy(*by).agg(*[F.expr(f"{sql} AS {name}") for name, sql in sums.items()])


def _prf(tp, predicted, positive):
    return _ratio(tp, predicted), _ratio(tp, positive), _ratio(f"(2 * {tp})", f"({predicted} + {positive})")


def _label_prf(label):
    return _prf(f"tp_{label}", f"pp_{label}", f"tt_{label}")


def metric_columns(labels=LABELS):
    """Name → SQL of every metric over a row of ``metric_sums``."""
    support = _total([f"tt_{l}" for l in labels])
    micro = _prf(_total([f"tp_{l}" for l in labels]), _total([f"pp_{l}" for l in labels]), support)
    out = {
        "exact_match_ratio": _ratio("exact", "n"),
        "hamming_score": _ratio("jaccard", "n"),
        "accuracy": _ratio("cells", f"(n * {len(labels)})"),
    }
    for i, name in enumerate(PRF):
        own = {l: _label_prf(l)[i] for l in labels}
        out[f"micro_{name}"] = micro[i]
        out[f"macro_{name}"] = f"{_total(own.values())} / {len(labels)}"
        out[f"weighted_{name}"] = _ratio(_total([f"{own[l]} * tt_{l}" for l in labels]), support)
        out[f"samples_{name}"] = _ratio(f"row_{name}", "n")
    for l in labels:
        out[f"f1_{l}"] = _label_prf(l)[2]
    return out


def metrics_wide(table, labels=LABELS, by=(), **options):
    sums = metric_sums(table, labels, by, **options)
    return sums.selectExpr(*by, *[f"{sql} AS {name}" for name, sql in metric_columns(labels).items()])


def to_long(wide, names, keys=(), key="metric", value="value"):
    rows = [(f"'{n}'", f"cast({n} AS double)") for n in names]
    return wide.selectExpr(*keys, stack((key, value), *rows))


def compute_metrics(table, labels=LABELS, by=(), **options):
    """All metrics as (metric, value) rows."""
    return to_long(metrics_wide(table, labels, by, **options), metric_columns(labels), by)


def confusion_by_label(table, labels=LABELS, **options):
    """tp, fp, fn and tn of each label."""
    rows = [
        (f"'{l}'", f"tp_{l}", f"pp_{l} - tp_{l}", f"tt_{l} - tp_{l}", f"n - pp_{l} - tt_{l} + tp_{l}") for l in labels
    ]
    return metric_sums(table, labels, **options).selectExpr(stack(("label", "tp", "fp", "fn", "tn"), *rows))


def classification_report(table, labels=LABELS, **options):
    """Precision, recall, F1 and support by label and by average."""
    named = metric_columns(labels)
    support = _total([f"tt_{l}" for l in labels])
    rows = [(f"'{l}'", *_label_prf(l), f"tt_{l}") for l in labels]
    rows += [(f"'{a} avg'", *[named[f"{a}_{k}"] for k in PRF], support) for a in AVERAGES]
    typed = [(r[0], *[f"cast({x} AS double)" for x in r[1:4]], f"cast({r[4]} AS bigint)") for r in rows]
    return metric_sums(table, labels, **options).selectExpr(stack(("name", *PRF, "support"), *typed))


def score_accuracy(scored, threshold=0.5, strict=True, labels=LABELS, empty_value=0.0):
    """Cell accuracy and mean row Jaccard of thresholded scores."""
    table = threshold_scores(scored, threshold, strict, labels)
    wide = metrics_wide(table, labels, empty_value=empty_value)
    return wide.select(
        F.lit(float(threshold)).alias("threshold"), "accuracy", F.col("hamming_score").alias("accuracy_strict")
    )


def threshold_grid(scored, grid=SCORE_GRID, labels=LABELS):
    """All metrics at every threshold of the grid; partial sums keep the shuffle tiny."""
    points = [(str(i), f"{float(t)}D") for i, t in enumerate(grid)]
    kept = [f"{prefix}_{l}" for l in labels for prefix in ("score", "true")]
    rows = scored.selectExpr(*kept, stack(("grid_index", "threshold"), *points))
    predicted = rows.selectExpr("*", *[f"cast(score_{l} >= threshold AS int) AS pred_{l}" for l in labels])
    return metrics_wide(predicted, labels, by=("grid_index", "threshold"))


def best_point(grid_metrics, metric="macro_f1"):
    """The grid row with the highest metric; the earlier entry wins a tie."""
    return grid_metrics.orderBy(F.desc(metric), "grid_index").limit(1)


def score_threshold_search(scored, grid=SCORE_GRID, labels=LABELS):
    return best_point(threshold_grid(scored, grid, labels))


def published_metrics(spark):
    rows = [(f"'{k}'", f"{v}D") for k, v in PUBLISHED_METRICS.items()]
    return spark.range(1).selectExpr(stack(("metric", "published"), *rows))


def compare_to_published(metrics):
    """Published value, own value and difference per metric; the published table has 23 rows."""
    reference = published_metrics(metrics.sparkSession)
    return F.broadcast(reference).join(metrics, "metric", "left").select(
        "metric", "published", F.col("value").alias("reproduced"), (F.col("value") - F.col("published")).alias("delta")
    )


def metric_delta_report(before, after):
    """Before, after, published and the differences; both inputs have one row per metric."""
    joined = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric")
    published = F.broadcast(published_metrics(before.sparkSession))
    return joined.join(published, "metric", "left").select(
        "metric", "before", "after", (F.col("after") - F.col("before")).alias("gain"),
        "published", (F.col("after") - F.col("published")).alias("delta"),
    )


AUROC_ROWS_PER_BIN = 50_000
AUROC_MOST_BINS = 8_192


def auroc_by_label(table, labels=LABELS, score="score_", true="true_", rows_per_bin=AUROC_ROWS_PER_BIN):
    """Area under the ROC curve per label, null when a label has one class only.

    Equal scores are added up first.  The distinct scores of all labels, whose
    number is measured, are cut into bins of about ``rows_per_bin``, so that the
    running sums inside a (label, bin) and over the bins of a label are both
    bounded; no task ranks a whole label.
    """
    rows = [(f"'{l}'", f"cast({score}{l} AS double)", f"{true}{l}") for l in labels]
    long = table.selectExpr(stack(("label", "s", "y"), *rows))
    counts = stage(
        long.groupBy("label", "s").agg(
            F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg")
        ),
        "score-counts",
    )
    n_bins = min(AUROC_MOST_BINS, max(16, counts.count() // rows_per_bin))
    shares = [i / n_bins for i in range(1, n_bins)]
    cuts = counts.agg(F.percentile_approx("s", shares, 40 * n_bins).alias("c")).first()["c"] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.5, float("inf")]
    binned = Bucketizer(splits=splits, inputCol="s", outputCol="bin").transform(counts)
    # at most labels x AUROC_MOST_BINS rows
    bins = binned.groupBy("label", "bin").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    over_bins = Window.partitionBy("label").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below = bins.select("label", "bin", F.coalesce(F.sum("bn").over(over_bins), F.lit(0.0)).alias("neg_below"))
    in_bin = Window.partitionBy("label", "bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.join(F.broadcast(below), ["label", "bin"]).withColumn(
        "lower", F.col("neg_below") + F.coalesce(F.sum("neg").over(in_bin), F.lit(0.0))
    )
    sums = ranked.groupBy("label").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)).alias("u"),
    )
    area = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n")))
    return sums.select("label", area.alias("auroc"))
