"""Streamed preparation with running counters."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators.prep import label_by_split, prep_summary, prepare
from ..staging import scratch_path

BATCH = "batch_id"
COUNTS = "split string, label string, n long"
SUMMARY = "processed_rows long, kept_rows long, skipped_no_label long, skipped_empty_text long"


def read_stream(spark, path, schema, pattern=None, files_per_trigger=None):
    """The files of ``path``; with a ``pattern`` the tables of that name in it, each one file or a folder of part files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # in braces even a plain name is a glob, which may lead to a file as well as to a folder
    return reader.parquet(f"{path}/{{{pattern}}}" if pattern else path)


def start_prepare(raw_stream, out_path, checkpoint, seed=42, once=True):
    """Appends clean samples as they arrive; the work is stateless."""
    writer = (
        prepare(raw_stream, seed).writeStream.format("parquet")
        .outputMode("append").option("path", out_path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def _start_deltas(raw_stream, count, out_path, checkpoint, once):
    """The counters of each batch as a few rows of their own; a replayed batch overwrites them."""

    def add(batch, batch_id):
        (
            count(batch).withColumn(BATCH, F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(out_path)
        )

    writer = raw_stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_counts(raw_stream, out_path, checkpoint, seed=42, once=True):
    """Running positives per split and label: at most 3 x 8 rows a batch, in a table that others can read."""
    return _start_deltas(raw_stream, lambda batch: label_by_split(prepare(batch, seed)), out_path, checkpoint, once)


def start_summary(raw_stream, out_path, checkpoint, once=True):
    """Running counters of processed, kept and skipped rows: one row a batch, in a table that others can read."""
    return _start_deltas(raw_stream, prep_summary, out_path, checkpoint, once)


def _deltas(spark, path, schema):
    """The counters of all batches; no rows before the first one."""
    schema = f"{schema}, {BATCH} long"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_counts(spark, path):
    """The counters up to the last finished batch; the table may be growing."""
    return _deltas(spark, path, COUNTS).groupBy("split", "label").agg(F.sum("n").alias("n"))


def read_summary(spark, path):
    """The summary up to the last finished batch; the table may be growing."""
    rows = _deltas(spark, path, SUMMARY)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns if c != BATCH])


def merge_deltas(spark, read, path, out_path):
    """The counters of ``path`` as a fresh table of one batch, for a stream that has made very many."""
    rows = read(spark, path)
    rows.withColumn(BATCH, F.lit(-1).cast("long")).write.partitionBy(BATCH).parquet(out_path)
    return out_path


def stream_prepare(raw_stream, seed=42):
    """Runs what has arrived to the end and returns the written table."""
    spark = raw_stream.sparkSession
    out = scratch_path(spark, "stream-prepared")
    start_prepare(raw_stream, out, scratch_path(spark, "stream-state"), seed).awaitTermination()
    return spark.read.schema(prepare(raw_stream, seed).schema).parquet(out)


def _finished(start, read, raw_stream, out_path, checkpoint, *args):
    """Runs a counter over what has arrived and returns its table."""
    spark = raw_stream.sparkSession
    out = out_path or scratch_path(spark, "stream-counters")
    start(raw_stream, out, checkpoint or scratch_path(spark, "stream-state"), *args).awaitTermination()
    return read(spark, out)


def stream_counts(raw_stream, seed=42, out_path=None, checkpoint=None):
    """Given the folders of an earlier run, goes on where it stopped."""
    return _finished(start_counts, read_counts, raw_stream, out_path, checkpoint, seed)


def stream_summary(raw_stream, out_path=None, checkpoint=None):
    """Given the folders of an earlier run, goes on where it stopped."""
    return _finished(start_summary, read_summary, raw_stream, out_path, checkpoint)
