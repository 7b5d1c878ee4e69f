"""Small helpers shared by the corpus operators."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.staging import stage_sized


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df, *names):
    """Column names that ``df`` does not use yet, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def in_slices(frame, fields, function, rows=512):
    """Rows through ``function`` (Arrow batch → arrays) in slices, so that no batch of long texts is built whole.

    ``fields`` are the result's; the function gets the columns of ``frame`` in
    order and returns an array for each field.
    """
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_arrays(function(batch.slice(at, rows)), names=names)

    return frame.mapInArrow(run, T.StructType(fields))


NO_ID = -(1 << 63)


def without(docs, dropped, id_col="doc_id", text_col="text", limit=32 * 1024 * 1024):
    """Rows of ``docs`` whose (id, hash of the text) is not among the (id, mark) of ``dropped``.

    Null ids match null ids.  ``dropped`` is written and measured: under the
    limit it is broadcast and the documents do not move, else both sides are
    shuffled.
    """
    key, mark = fresh(docs, "_drop_id", "_drop_mark")
    sized = stage_sized(dropped.select(F.coalesce("id", F.lit(NO_ID)).alias(key), F.col("mark").alias(mark)).distinct(), "dropped")
    marked = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(mark, F.xxhash64(text_col))
    side = F.broadcast(sized.df) if sized.fits(limit) else sized.df.hint("merge")
    return marked.join(side, [key, mark], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
