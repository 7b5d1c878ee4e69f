"""Each arrived run is processed once and published idempotently."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..staging import scratch_path, stage

BATCH = "batch_id"


def read_published(spark, path):
    """The published table with its batch numbers, or None where nothing was published yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def one_of_each(batch, keys):
    """One row per key: the one of least hash, so a replay chooses the same."""
    rest = [c for c in batch.columns if c not in keys]
    chosen = F.min_by(F.struct(*rest), F.xxhash64(*rest)) if rest else F.count(F.lit(1))
    rows = batch.groupBy(*keys).agg(chosen.alias("_rest"))
    return rows.select(*[F.col(c) if c in keys else F.col(f"_rest.`{c}`").alias(c) for c in batch.columns])


def not_published(batch, batch_id, out_path, run, key):
    """Rows of ``batch`` whose (run, key) no other batch has published.

    The published table is the state: only the partitions of the runs that
    arrive are read, and of them only the keys.  Rows that an earlier try of the
    same batch left behind do not count; they are overwritten.
    """
    spark = batch.sparkSession
    published = read_published(spark, out_path)
    rows = one_of_each(batch, [run, key])
    if published is None:
        return rows
    arrived = batch.select(F.col(run).alias("_arrived")).distinct()
    known = published.where(F.col(BATCH) != batch_id).select(F.col(run).cast(batch.schema[run].dataType).alias("_run"), F.col(key).alias("_key"))
    known = stage(known.join(arrived, F.col("_run").eqNullSafe(F.col("_arrived")), "left_semi"), "published-keys")
    return rows.join(known, F.col(run).eqNullSafe(F.col("_run")) & F.col(key).eqNullSafe(F.col("_key")), "left_anti")


def start_publish(runs_stream, transform, out_path, checkpoint, run="run_id", key="sample_id", once=True):
    """``transform`` is applied to the new rows of every micro-batch; the output is partitioned by run and batch.

    A row is named by its run and key and is published once, however often its
    run arrives: in one batch, in later ones, or after a restart.  The first
    delivery stays.  ``transform`` has to keep both columns.  A batch that is
    replayed after a failure overwrites its own partitions only, and the
    checkpoint skips files that were done before.
    """

    def publish(batch, batch_id):
        fresh = not_published(batch, batch_id, out_path, run, key)
        (
            transform(fresh).withColumn(BATCH, F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(run, BATCH).parquet(out_path)
        )

    writer = runs_stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def incremental_publish(runs_stream, transform, out_path=None, checkpoint=None, run="run_id", key="sample_id"):
    spark = runs_stream.sparkSession
    out = out_path or scratch_path(spark, "published")
    state = checkpoint or scratch_path(spark, "stream-state")
    start_publish(runs_stream, transform, out, state, run, key).awaitTermination()
    return spark.read.parquet(out).drop(BATCH)
