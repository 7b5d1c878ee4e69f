"""Refinement of predictions as they land."""

from pyspark.sql import functions as F

from ..constants import FIELDS, LABELS
from ..operators.rules import build_elements, refine, rule_hits
from ..staging import scratch_path


def refine_batch(scored, rules, labels=LABELS, key="sample_id", text="text", **options):
    """Scores refined by rules: the token sets come with the rows, as ``text`` or as the three sets.

    Nothing about a sample has to be known before it arrives; only the learned
    rules, a measured table, are.
    """
    rows = scored if set(FIELDS) <= set(scored.columns) else build_elements(scored, text)
    kept = [c for c in rows.columns if c not in (*FIELDS, text)]
    return refine(rows.select(*kept), rule_hits(rows, rules, key), labels, key=key, **options)


def start_refine(scored_stream, rules, out_path, checkpoint, labels=LABELS, once=True, **options):
    """Each micro-batch looks its tokens up in the rules; a replayed batch overwrites its own partition only."""

    def publish(batch, batch_id):
        (
            refine_batch(batch, rules, labels, **options).withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path)
        )

    writer = scored_stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_refine(scored_stream, rules, labels=LABELS, out_path=None, checkpoint=None, **options):
    """Runs what has arrived to the end and returns the written table."""
    spark = scored_stream.sparkSession
    out = out_path or scratch_path(spark, "stream-refined")
    start_refine(scored_stream, rules, out, checkpoint or scratch_path(spark, "stream-state"), labels, **options).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")
