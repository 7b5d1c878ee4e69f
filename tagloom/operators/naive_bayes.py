"""Gaussian naive Bayes per label on sparse weights.

Zeros are implicit: a class moment is a sum over non-zeros divided by the class
size.  The log-odds of a label is a base value plus a·w + b·w² over the non-zero
terms of a sample, so scoring is one sum per model and partial sums leave one
row per sample to shuffle.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS, P_VALUE_GRID
from ..staging import Sized, lookup_join, stage, stage_sized
from .metrics import metrics_wide, stack
from .tfidf import select_by_p

VARIANCE_SMOOTHING = 1e-9


def _long_moments(selected, moments, labels):
    """(grid_index, p_value, term_id, label, class, n, mu, raw) of selected terms, zero-filled."""
    n = moments.documents
    cells = []
    for l in labels:
        ones = moments.positives[l]
        for c, size in ((0, n - ones), (1, ones)):
            s = F.col(f"s_{l}") if c else F.col("s") - F.col(f"s_{l}")
            q = F.col(f"q_{l}") if c else F.col("q") - F.col(f"q_{l}")
            mu = s / size if size else F.lit(0.0)
            raw = F.greatest((q - s * s / size) / size, F.lit(0.0)) if size else F.lit(0.0)
            cells.append(
                F.struct(
                    F.lit(l).alias("label"), F.lit(c).alias("class"), F.lit(size).cast("long").alias("n"),
                    mu.alias("mu"), raw.alias("raw"),
                )
            )
    spread = F.greatest((F.col("q") - F.col("s") * F.col("s") / n) / n, F.lit(0.0))
    return selected.withColumn("_spread", spread).select(
        "grid_index", "p_value", "term_id", "_spread", F.explode(F.array(*cells)).alias("_c")
    ).select("grid_index", "p_value", "term_id", "_spread", "_c.*")


def class_moments(selected, moments, labels=LABELS):
    """(grid_index, p_value, term_id, label, class, n, mu, var) with the smoothed variance.

    The smoothing term depends on the selected terms, so it is taken per grid point.
    """
    # a grid has a handful of points: the map of their highest variances is tiny
    spread = F.greatest((F.col("q") - F.col("s") * F.col("s") / moments.documents) / moments.documents, F.lit(0.0))
    highest = selected.groupBy("grid_index").agg(F.max(spread).alias("v"))
    epsilon = highest.agg(F.map_from_entries(F.collect_list(F.struct("grid_index", "v"))).alias("m")).scalar()
    long = _long_moments(selected, moments, labels)
    var = F.col("raw") + F.element_at(epsilon, F.col("grid_index")) * VARIANCE_SMOOTHING
    return long.withColumn("var", var).drop("raw", "_spread")


@dataclass(frozen=True)
class GaussianModels:
    """One model per (grid point, label): packed term parameters and base log-odds."""

    parameters: Sized
    base: dict
    grid: tuple
    labels: tuple
    moments: DataFrame

    def column(self, grid_index, label):
        return grid_index * len(self.labels) + self.labels.index(label)


def gnb_fit(moments, grid=P_VALUE_GRID, labels=LABELS):
    """All models of the grid from one table of moments."""
    selected = stage(select_by_p(moments, grid, labels), "selected")
    long = stage(class_moments(selected, moments, labels), "class-moments")
    labels = tuple(labels)
    position = F.element_at(
        F.create_map(*[v for i, l in enumerate(labels) for v in (F.lit(l), F.lit(i))]), F.col("label")
    )
    model = F.col("grid_index") * len(labels) + position
    sign = F.when(F.col("class") == 1, 1.0).otherwise(-1.0)
    usable = long.where(F.col("n") > 0)
    per_term = usable.groupBy("term_id", model.alias("model")).agg(
        F.sum(sign * F.col("mu") / F.col("var")).alias("a"),
        F.sum(-sign / (2.0 * F.col("var"))).alias("b"),
    )
    count = len(grid) * len(labels)

    def dense(name):
        known = F.map_from_entries(F.collect_list(F.struct("model", name)))
        return known.alias(f"_{name}")

    def fill(name):
        slots = F.sequence(F.lit(0), F.lit(count - 1))
        return F.transform(slots, lambda i: F.coalesce(F.element_at(F.col(f"_{name}"), i), F.lit(0.0))).alias(name)

    packed = per_term.groupBy("term_id").agg(dense("a"), dense("b")).select("term_id", fill("a"), fill("b"))
    at_zero = -0.5 * F.log(2.0 * F.pi() * F.col("var")) - F.col("mu") * F.col("mu") / (2.0 * F.col("var"))
    sums = usable.groupBy("grid_index", "label").agg(F.sum(sign * at_zero).alias("base")).collect()
    base = {}
    for row in sums:
        ones = moments.positives[row["label"]]
        zeros = moments.documents - ones
        base[(row["grid_index"], row["label"])] = (row["base"], ones, zeros)
    return GaussianModels(stage_sized(packed, "parameters"), base, tuple(grid), labels, long)


def _base_log_odds(models, grid_index, label, moments):
    from math import inf, log

    total, ones, zeros = models.base.get((grid_index, label), (0.0, *_sizes(moments, label)))
    if ones == 0:
        return -inf
    if zeros == 0:
        return inf
    return total + log(ones / moments.documents) - log(zeros / moments.documents)


def _sizes(moments, label):
    ones = moments.positives[label]
    return ones, moments.documents - ones


def gnb_scores(rows, entries, models, moments, grid_indexes=None, key="sample_id"):
    """Log-odds ``z_<grid>_<label>`` of every row, also of rows without any known term.

    A label with a single class in training keeps that class.
    """
    indexes = range(len(models.grid)) if grid_indexes is None else grid_indexes
    wanted = [(g, l) for g in indexes for l in models.labels]
    joined = lookup_join(entries, models.parameters, "term_id", spread=[key])
    sums = []
    for g, l in wanted:
        i = models.column(g, l)
        sums.append(F.expr(f"sum(w * a[{i}] + w * w * b[{i}]) AS z_{g}_{l}"))
    adjusted = joined.groupBy(key).agg(*sums)
    scored = rows.join(adjusted, key, "left")
    odds = {(g, l): f"double('{_base_log_odds(models, g, l, moments)}')" for g, l in wanted}
    return scored.withColumns(
        {f"z_{g}_{l}": F.expr(f"coalesce(z_{g}_{l}, 0D) + {odds[g, l]}") for g, l in wanted}
    )


def gnb_predict(rows, entries, models, moments, grid_index=0, key="sample_id"):
    """Arg-max class per label (ties to 0) as ``pred_<label>``."""
    scored = gnb_scores(rows, entries, models, moments, [grid_index], key)
    predicted = scored.withColumns(
        {f"pred_{l}": (F.col(f"z_{grid_index}_{l}") > 0).cast("int") for l in models.labels}
    )
    return predicted.drop(*[f"z_{grid_index}_{l}" for l in models.labels])


def threshold_grid_fit(rows, entries, models, moments, key="sample_id"):
    """Validation metrics of every grid point; ``rows`` holds ``true_<label>`` columns.

    All points are scored in one pass over the entries.
    """
    scored = gnb_scores(rows, entries, models, moments, key=key)
    points = [
        (str(g), f"{float(p)}D", *[f"cast(z_{g}_{l} > 0 AS int)" for l in models.labels])
        for g, p in enumerate(models.grid)
    ]
    names = ("grid_index", "p_value", *[f"pred_{l}" for l in models.labels])
    long = scored.selectExpr(*[f"true_{l}" for l in models.labels], stack(names, *points))
    metrics = metrics_wide(long, models.labels, by=("grid_index", "p_value"))
    counts = models.moments.where((F.col("label") == models.labels[0]) & (F.col("class") == 1)).groupBy("grid_index").agg(
        F.count(F.lit(1)).alias("selected_feature_count")
    )
    return metrics.join(F.broadcast(counts), "grid_index")

