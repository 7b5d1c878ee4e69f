"""Thresholds, metrics, reports and grid searches over score tables."""

from pyspark.sql import functions as F

from ..constants import LABELS, PUBLISHED_METRICS, SCORE_GRID
from ..operators import metrics as M
from ..sources import views, writers
from ..staging import scratch_path
from .registry import ORACLES, query
from .views import with_views


def _predictions(spark, sf_dir):
    return views.predictions(spark, sf_dir)


@query(
    "p20_threshold_scores",
    with_views(
        "SELECT sample_id, " + ", ".join(f"(score_{l} >= 0.5)::INTEGER AS pred_{l}, (score_{l} > 0.5)::INTEGER AS strict_{l}" for l in LABELS) + " FROM scored",
        "scored",
    ),
)
def threshold_scores(spark, sf_dir):
    scored = views.with_scores(views.samples(spark, sf_dir))
    both = M.threshold_scores(M.threshold_scores(scored), strict=True, pred="strict_")
    return both.select("sample_id", *[f"{p}_{l}" for l in LABELS for p in ("pred", "strict")])


# long-form building blocks, written independently of the wide sums
_BY_LABEL = """by_label AS MATERIALIZED (SELECT {g} label, any_value(k) AS k, sum(y * p) AS tp, sum(p) AS pp, sum(y) AS tt, count(*) AS n FROM {cells} GROUP BY {g} label),
prf AS MATERIALIZED (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS pr, CASE WHEN tt > 0 THEN tp / tt ELSE 0 END AS re,
  CASE WHEN pp + tt > 0 THEN 2 * tp / (pp + tt) ELSE 0 END AS f1 FROM by_label),
by_sample AS MATERIALIZED (SELECT {g} sample_id, sum(y * p) AS i, sum(p) AS pp, sum(y) AS tt, min((y = p)::INT) AS exact, avg((y = p)::INT) AS cell FROM {cells} GROUP BY {g} sample_id),
rows_ AS MATERIALIZED (SELECT *, CASE WHEN pp + tt - i = 0 THEN {empty} ELSE i / (pp + tt - i) END AS ja, CASE WHEN pp > 0 THEN i / pp ELSE 0 END AS pr,
  CASE WHEN tt > 0 THEN i / tt ELSE 0 END AS re, CASE WHEN pp + tt > 0 THEN 2 * i / (pp + tt) ELSE 0 END AS f1 FROM by_sample)"""

_NAMES = {"precision": "pr", "recall": "re", "f1": "f1"}


def metric_ctes(cells="cells", group="", empty="1.0"):
    return _BY_LABEL.format(g=f"{group}," if group else "", cells=cells, empty=empty)


def metric_rows(group="", labels=LABELS):
    """SELECTs of (group, metric, value) for every metric."""
    g = f"{group}, " if group else ""
    by = f" GROUP BY {group}" if group else ""
    micro = {
        "precision": "CASE WHEN sum(pp) > 0 THEN sum(tp) / sum(pp) ELSE 0 END",
        "recall": "CASE WHEN sum(tt) > 0 THEN sum(tp) / sum(tt) ELSE 0 END",
        "f1": "CASE WHEN sum(pp) + sum(tt) > 0 THEN 2 * sum(tp) / (sum(pp) + sum(tt)) ELSE 0 END",
    }
    parts = [
        f"SELECT {g}'exact_match_ratio' AS metric, avg(exact)::DOUBLE AS value FROM rows_{by}",
        f"SELECT {g}'hamming_score', avg(ja) FROM rows_{by}",
        f"SELECT {g}'accuracy', avg(cell) FROM rows_{by}",
    ]
    for name, column in _NAMES.items():
        parts += [
            f"SELECT {g}'micro_{name}', {micro[name]} FROM prf{by}",
            f"SELECT {g}'macro_{name}', avg({column}) FROM prf{by}",
            f"SELECT {g}'weighted_{name}', CASE WHEN sum(tt) > 0 THEN sum({column} * tt) / sum(tt) ELSE 0 END FROM prf{by}",
            f"SELECT {g}'samples_{name}', avg({column}) FROM rows_{by}",
        ]
    parts.append(f"SELECT {g}'f1_' || label, f1 FROM prf")
    return " UNION ALL ".join(parts)


def with_metrics(select, cells="cells", group="", empty="1.0", extra="", needs=("cells",)):
    """``select`` over prf, rows_ and metrics(group, metric, value)."""
    base = with_views("", *needs).rstrip()
    middle = f",\n{extra}" if extra else ""
    return f"{base}{middle},\n{metric_ctes(cells, group, empty)},\nmetrics AS MATERIALIZED ({metric_rows(group)})\n{select}"


def _one(name, metric, column=None, empty=1.0):
    column = column or metric

    def run(spark, sf_dir):
        wide = M.metrics_wide(_predictions(spark, sf_dir), empty_value=empty)
        return wide.select(F.round(metric, 6).alias(column))

    query(name, with_metrics(f"SELECT round(value, 6) AS {column} FROM metrics WHERE metric = '{metric}'", empty=str(empty)))(run)


_one("e1_exact_match_ratio", "exact_match_ratio")
_one("e2_cell_accuracy", "accuracy")
_one("e3_hamming_score", "hamming_score")
_one("e3_hamming_score_empty_zero", "hamming_score", empty=0.0)
_one("e13_subset_accuracy", "exact_match_ratio", "subset_accuracy")


def _average(name, average):
    def run(spark, sf_dir):
        wide = M.metrics_wide(_predictions(spark, sf_dir))
        return wide.select(*[F.round(f"{average}_{k}", 6).alias(k) for k in _NAMES])

    columns = ", ".join(
        f"(SELECT round(value, 6) FROM metrics WHERE metric = '{average}_{k}') AS {k}" for k in _NAMES
    )
    query(name, with_metrics(f"SELECT {columns}"))(run)


_average("e4_prf_micro", "micro")
_average("e5_prf_macro", "macro")
_average("e6_prf_weighted", "weighted")
_average("e7_prf_samples", "samples")


@query("e8_f1_by_label", with_metrics("SELECT label, round(f1, 6) AS f1 FROM prf"))
def f1_by_label(spark, sf_dir):
    report = M.classification_report(_predictions(spark, sf_dir))
    return report.where(F.col("name").isin(*LABELS)).select(F.col("name").alias("label"), F.round("f1", 6).alias("f1"))


@query("e9_compute_metrics", with_metrics("SELECT metric, round(value, 6) AS value FROM metrics"))
def compute_metrics(spark, sf_dir):
    return M.compute_metrics(_predictions(spark, sf_dir)).select("metric", F.round("value", 6).alias("value"))


def _average_row(average):
    columns = ", ".join(f"(SELECT round(value, 6) FROM metrics WHERE metric = '{average}_{k}') AS {k}" for k in _NAMES)
    return f"SELECT '{average} avg', {columns}, (SELECT sum(tt)::BIGINT FROM prf)"


@query(
    "e10_classification_report",
    with_metrics(
        "SELECT label AS name, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, tt::BIGINT AS support FROM prf UNION ALL "
        + " UNION ALL ".join(_average_row(a) for a in M.AVERAGES)
    ),
)
def classification_report(spark, sf_dir):
    report = M.classification_report(_predictions(spark, sf_dir))
    return report.select("name", *[F.round(k, 6).alias(k) for k in _NAMES], "support")


@query("k3_write_report_json", ORACLES["e10_classification_report"])
def write_report(spark, sf_dir):
    report = M.classification_report(_predictions(spark, sf_dir)).select("name", *_NAMES, "support")
    lines = spark.read.text(writers.write_report_json(report, scratch_path(spark, "report")))
    entry = "struct<" + ", ".join(f"{k}: double" for k in _NAMES) + ", support: bigint>"
    rows = lines.select(F.explode(F.from_json("value", f"map<string, {entry}>")).alias("name", "v"))
    return rows.select("name", *[F.round(f"v.{k}", 6).alias(k) for k in _NAMES], "v.support")


@query(
    "a11_confusion_by_label",
    with_metrics("SELECT label, tp::BIGINT AS tp, (pp - tp)::BIGINT AS fp, (tt - tp)::BIGINT AS fn, (n - pp - tt + tp)::BIGINT AS tn FROM by_label"),
)
def confusion(spark, sf_dir):
    return M.confusion_by_label(_predictions(spark, sf_dir))


@query(
    "e11_auroc_by_label",
    with_views(
        "SELECT label, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN round((sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2.0) "
        "/ (sum(y) * sum(1 - y)), 6) END AS auroc FROM (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score) "
        "+ (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS mid FROM cells) GROUP BY label",
        "cells",
    ),
)
def auroc(spark, sf_dir):
    return M.auroc_by_label(_predictions(spark, sf_dir)).select("label", F.round("auroc", 6).alias("auroc"))


def _strict_cells(threshold):
    return f"strict_cells AS MATERIALIZED (SELECT sample_id, k, label, y, (score > {threshold})::INT AS p FROM cells)"


@query(
    "e12_score_accuracy",
    with_metrics(
        "SELECT 0.4::DOUBLE AS threshold, (SELECT round(value, 6) FROM metrics WHERE metric = 'accuracy') AS accuracy, "
        "(SELECT round(value, 6) FROM metrics WHERE metric = 'hamming_score') AS accuracy_strict",
        cells="strict_cells", empty="0.0", extra=_strict_cells(0.4),
    ),
)
def score_accuracy(spark, sf_dir):
    out = M.score_accuracy(_predictions(spark, sf_dir), 0.4)
    return out.select("threshold", F.round("accuracy", 6).alias("accuracy"), F.round("accuracy_strict", 6).alias("accuracy_strict"))


_PUBLISHED = "published AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in PUBLISHED_METRICS.items()) + ") t(metric, published))"


@query(
    "j8_compare_to_baseline",
    with_metrics(
        "SELECT metric, published, round(value, 6) AS reproduced, round(value - published, 6) AS delta FROM published LEFT JOIN metrics USING (metric)",
        extra=_PUBLISHED,
    ),
)
def compare_to_published(spark, sf_dir):
    out = M.compare_to_published(M.compute_metrics(_predictions(spark, sf_dir)))
    return out.select("metric", "published", F.round("reproduced", 6).alias("reproduced"), F.round("delta", 6).alias("delta"))


_TWO = (
    "two AS MATERIALIZED (SELECT 'before' AS run, sample_id, k, label, y, p FROM cells UNION ALL "
    "SELECT 'after', sample_id, k, label, y, (score >= 0.3)::INT FROM cells)"
)


@query(
    "e14_metric_delta_report",
    with_metrics(
        "SELECT b.metric, round(b.value, 6) AS before, round(a.value, 6) AS after, round(a.value - b.value, 6) AS gain, published, "
        "round(a.value - published, 6) AS delta FROM metrics b JOIN metrics a ON a.metric = b.metric AND a.run = 'after' "
        "LEFT JOIN published ON published.metric = b.metric WHERE b.run = 'before'",
        cells="two", group="run", extra=_TWO + ",\n" + _PUBLISHED,
    ),
)
def metric_delta(spark, sf_dir):
    scored = _predictions(spark, sf_dir)
    before = M.compute_metrics(scored)
    after = M.compute_metrics(M.threshold_scores(scored, 0.3))
    out = M.metric_delta_report(before, after)
    return out.select("metric", "published", *[F.round(c, 6).alias(c) for c in ("before", "after", "gain", "delta")])


_GRID = (
    "grid_cells AS MATERIALIZED (SELECT g.threshold, sample_id, k, label, y, (score >= g.threshold)::INT AS p FROM cells, "
    "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in SCORE_GRID) + ") g(threshold) WHERE split = 'val')"
)


@query(
    "m6_score_threshold_search",
    with_metrics("SELECT threshold, metric, round(value, 6) AS value FROM metrics", cells="grid_cells", group="threshold", extra=_GRID),
)
def threshold_grid(spark, sf_dir):
    grid = M.threshold_grid(_predictions(spark, sf_dir).where("split = 'val'"))
    long = M.to_long(grid, M.metric_columns(), ("threshold",))
    return long.select("threshold", "metric", F.round("value", 6).alias("value"))


@query("k4_write_threshold_search", ORACLES["m6_score_threshold_search"])
def write_threshold_search(spark, sf_dir):
    path = scratch_path(spark, "search")
    writers.write_predictions(M.threshold_grid(_predictions(spark, sf_dir).where("split = 'val'")), path, "csv")
    rows = spark.read.option("header", True).csv(path)
    numbers = rows.select(*[F.col(c).cast("double").alias(c) for c in rows.columns])
    long = M.to_long(numbers, M.metric_columns(), ("threshold",))
    return long.select("threshold", "metric", F.round("value", 6).alias("value"))


@query(
    "w4_best_threshold",
    with_metrics(
        "SELECT threshold, round(value, 6) AS macro_f1 FROM metrics WHERE metric = 'macro_f1' ORDER BY value DESC, threshold LIMIT 1",
        cells="grid_cells", group="threshold", extra=_GRID,
    ),
)
def best_threshold(spark, sf_dir):
    best = M.score_threshold_search(_predictions(spark, sf_dir).where("split = 'val'"))
    return best.select("threshold", F.round("macro_f1", 6).alias("macro_f1"))
