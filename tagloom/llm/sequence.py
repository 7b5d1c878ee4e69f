"""A table in the order of an id, in buckets that hold one row more: the next one."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tagloom.llm.common import fresh

FIRST = -(1 << 63)
MOST_BUCKETS = 20_000


def in_buckets(rows, id_col, rows_per_bucket=4096):
    """(frame, bucket, order, extra): ``rows`` cut into ranges of the id.

    Each bucket also holds the first rows of the next one, with ``extra`` true;
    the last holds those of the first, so every row has a successor within its
    bucket by (extra, order).  Bounds are quantiles of all ids.  The driver sees two
    numbers per bucket, at most ``MOST_BUCKETS`` of them.  Null ids come first;
    rows of one id stay together.
    """
    spark = rows.sparkSession
    bucket, order, extra = fresh(rows, "_bucket", "_order", "_extra")
    keyed = rows.withColumn(order, F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)))
    total = keyed.count()
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    count = max(1, min(MOST_BUCKETS, total, max(wanted, total // rows_per_bucket)))
    bounds = []
    if count > 1:
        shares = [i / count for i in range(1, count)]
        bounds = keyed.agg(F.percentile_approx(order, shares, 20 * count).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.int64), side="right").astype(np.int32))

    placed = keyed.withColumn(bucket, place(F.col(order)))
    firsts = sorted((r[0], r[1]) for r in placed.groupBy(bucket).agg(F.min(order)).collect())
    links = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    ends = spark.createDataFrame(links, f"{order} long, {bucket} int")
    again = keyed.join(F.broadcast(ends), order).withColumn(extra, F.lit(True))
    return placed.withColumn(extra, F.lit(False)).unionByName(again), bucket, order, extra
