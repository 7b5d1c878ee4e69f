"""Streams driven to the end of what has arrived; results equal the batch queries."""

from pyspark.sql import functions as F

from ..constants import LABELS
from ..operators.metrics import compute_metrics, threshold_scores
from ..sources import views
from ..staging import scratch_path, stage
from ..streaming.prepare import read_stream, stream_counts, stream_prepare, stream_summary
from ..streaming.publish import incremental_publish
from ..streaming.refine import stream_refine
from .evaluation import with_metrics
from .refinement import _REFINED_SELECT, _elements, _long_refined, _masks, _scored_test, _with_refined
from .registry import ORACLES, query
from .views import LABEL_LIST, with_views


def _raw_stream(spark, sf_dir):
    schema = views.table(spark, sf_dir, "documents").schema
    return views.raw_from_documents(read_stream(spark, sf_dir, schema, "documents.parquet"))


@query(
    "x1_stream_prepare",
    with_views(f"SELECT sample_id, split, text, raw_classification, project, {LABEL_LIST} FROM samples", "samples"),
)
def prepare_stream(spark, sf_dir):
    return stream_prepare(_raw_stream(spark, sf_dir)).select("sample_id", "split", "text", "raw_classification", "project", *LABELS)


@query(
    "x1_stream_counts",
    with_views("SELECT split, label, sum(y)::BIGINT AS n FROM long_labels GROUP BY ALL HAVING sum(y) > 0", "long_labels"),
)
def counts_stream(spark, sf_dir):
    return stream_counts(_raw_stream(spark, sf_dir))


def _landed(table, name, parts=4, key="sample_id"):
    """The table as several files, as they would land one after the other."""
    path = scratch_path(table.sparkSession, name)
    table.repartition(parts, key).write.parquet(path)
    return path


@query("x1_stream_counts_restarted", ORACLES["x1_stream_counts"])
def counts_restarted(spark, sf_dir):
    """Half of the rows land after the stream has stopped; the table goes on from its batches."""
    docs = stage(views.table(spark, sf_dir, "documents"), "documents")
    path, out, state = (scratch_path(spark, n) for n in ("landed", "counters", "stream-state"))
    for late in (0, 1):
        docs.where(F.pmod("doc_id", F.lit(2)) == late).repartition(3, "doc_id").write.mode("append").parquet(path)
        stream = views.raw_from_documents(read_stream(spark, path, docs.schema, files_per_trigger=2))
        counts = stream_counts(stream, out_path=out, checkpoint=state)
    return counts.select("split", "label", "n")


@query("x1_stream_summary", ORACLES["a1_prep_summary"])
def summary_stream(spark, sf_dir):
    return stream_summary(_raw_stream(spark, sf_dir))


def _scored_with_text(spark, sf_dir):
    scored = _scored_test(spark, sf_dir)
    return scored.join(views.samples(spark, sf_dir).select("sample_id", "text"), "sample_id")


@query("x2_stream_refine", _with_refined(_REFINED_SELECT))
def refine_stream(spark, sf_dir):
    rules = _masks(_elements(spark, sf_dir), False)
    scored = _scored_with_text(spark, sf_dir)
    arrivals = read_stream(spark, _landed(scored, "landed"), scored.schema, files_per_trigger=2)
    return _long_refined(stream_refine(arrivals, rules))


@query("x2_stream_refine_late", _with_refined(_REFINED_SELECT))
def refine_late_stream(spark, sf_dir):
    """Half of the samples land after the stream has run once; it goes on where it stopped."""
    rules = _masks(_elements(spark, sf_dir), False)
    scored = stage(_scored_with_text(spark, sf_dir), "scored")
    path, out, state = (scratch_path(spark, n) for n in ("landed", "refined", "stream-state"))
    for late in (0, 1):
        scored.where(F.col("sample_id") % 2 == late).write.mode("append").parquet(path)
        refined = stream_refine(read_stream(spark, path, scored.schema), rules, out_path=out, checkpoint=state)
    return _long_refined(refined)


_RUNS = (
    "run_cells AS MATERIALIZED (SELECT split AS run_id, sample_id, k, label, y, p FROM cells)"
)


@query(
    "x3_incremental_publish",
    with_metrics("SELECT run_id, metric, round(value, 6) AS value FROM metrics", cells="run_cells", group="run_id", extra=_RUNS),
)
def publish_stream(spark, sf_dir):
    scored = views.predictions(spark, sf_dir).withColumnRenamed("split", "run_id").drop("raw_classification")
    path = _landed(scored, "runs")
    out, state = scratch_path(spark, "published"), scratch_path(spark, "stream-state")
    for _ in range(2):
        # the second start finds nothing new and publishes nothing again
        runs = read_stream(spark, path, scored.schema, files_per_trigger=1)
        published = incremental_publish(runs, threshold_scores, out, state)
    metrics = compute_metrics(published, by=("run_id",))
    return metrics.select("run_id", "metric", F.round("value", 6).alias("value"))


@query("x3_incremental_publish_repeated", ORACLES["x3_incremental_publish"])
def publish_repeated_stream(spark, sf_dir):
    """Every run is delivered twice in a batch, again in a later one, and once more after a restart."""
    scored = views.predictions(spark, sf_dir).withColumnRenamed("split", "run_id").drop("raw_classification")
    scored = stage(scored, "scored")
    path = _landed(scored.union(scored), "runs")
    out, state = scratch_path(spark, "published"), scratch_path(spark, "stream-state")
    scored.repartition(3, "run_id").write.mode("append").parquet(path)
    for _ in range(2):
        runs = read_stream(spark, path, scored.schema, files_per_trigger=2)
        published = incremental_publish(runs, threshold_scores, out, state)
        scored.repartition(2, "run_id").write.mode("append").parquet(path)
    metrics = compute_metrics(published, by=("run_id",))
    return metrics.select("run_id", "metric", F.round("value", 6).alias("value"))
