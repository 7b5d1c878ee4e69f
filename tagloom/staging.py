"""Written intermediate tables, size-checked joins and distributed ordering.

Three things here keep every plan safe at scale:

* ``stage`` writes a shared intermediate as parquet into the folder named by
  ``spark.checkpoint.dir``.  It cuts lineage, survives lost executors and lets
  later scans prune columns.  The shuffles of the plan that was written go with
  it, and ``discard`` deletes a table that no plan reads any more.
* ``lookup_join`` broadcasts the small side only after measuring it; past the
  limit it does a shuffle join that salts the keys measured to be hot.
* ``number_rows`` and ``top_n`` order data without a single-task window.
"""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 1_000_000
TOP_IN_ONE_TASK = 100_000
FILTER_WORDS = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark, name):
    """A fresh path in the shared folder of the session."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tagloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)  # a local session's own folder ends with it
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tagloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_shuffles(spark):
    """Plans that run inside leave no shuffle files: what they write is all that later plans read."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stage(df, name="table"):
    """Write ``df`` once and read it back; later branches share the files."""
    path = scratch_path(df.sparkSession, name)
    with passing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def discard(*tables):
    """Delete staged tables; no plan that is still to run may read them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df, key):
    """Spread a table of few input splits over all cores before heavy row work.

    Large tables have far more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, key)


@dataclass(frozen=True)
class Sized:
    """A staged table with its measured size."""

    df: DataFrame
    rows: int
    bytes: int

    def fits(self, limit=BROADCAST_BYTES):
        return self.bytes <= limit


def _width(field):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        element = field.dataType.elementType
        if isinstance(element, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(column, "")), F.lit(0)) + 16 * F.size(column)
        return 16 + 8 * F.greatest(F.size(column), F.lit(0))
    return F.lit(8)


def stage_sized(df, name="table"):
    """Stage a model-sized table and measure what a broadcast of it would hold."""
    staged = stage(df, name)
    row_bytes = sum((_width(f) for f in staged.schema.fields), F.lit(16))
    measured = staged.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0)).alias("bytes")
    ).first()
    return Sized(staged, measured["rows"], measured["bytes"])


def _filter_word(on, words):
    return F.pmod(F.xxhash64(*on), F.lit(words)).cast("int")


def _filter_bits(on):
    """Four of 64 bits, from another hash than the word's."""
    draw = F.xxhash64(F.lit(1), *on)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(draw, s).bitwiseAND(F.lit(63)).cast("int")) for s in (0, 6, 12, 18)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _hashed_alike(big, small, on):
    plain = (T.IntegralType, T.StringType, T.DateType, T.BooleanType)
    return all(big.schema[c].dataType == small.schema[c].dataType and isinstance(big.schema[c].dataType, plain) for c in on)


def may_match(big, small, on, words=FILTER_WORDS):
    """Rows of ``big`` whose key may stand in ``small``, a ``Sized``: all that do and few others.

    The keys go into a Bloom filter of at most ``words`` words of 64 bits, four
    bits a key in one word.  Its table of (word, bits) is broadcast, so the rows
    of ``big`` are tested before a shuffle.  ``big`` comes back as it is where the
    filter would be too full to tell keys apart (a key for every two bits), or
    where keys of different or fractional types need not hash alike.
    """
    on = [on] if isinstance(on, str) else list(on)
    if small.rows > words * 32 or not _hashed_alike(big, small.df, on):
        return big
    words = min(words, 1 << max(10, (small.rows // 4).bit_length()))
    table = small.df.groupBy(_filter_word(on, words).alias("_word")).agg(F.bit_or(_filter_bits(on)).alias("_bits"))
    tested = big.withColumn("_word", _filter_word(on, words)).join(F.broadcast(stage(table, "filter")), "_word")
    mask = _filter_bits(on)
    return tested.where(F.col("_bits").bitwiseAND(mask) == mask).drop("_word", "_bits")


def lookup_join(big, small, on, spread, how="inner", limit=BROADCAST_BYTES, hot_rows=HOT_ROWS, selective=False):
    """Join a long table with a looked-up table on ``on``.

    ``small`` is a ``Sized``.  Under the limit it is broadcast and ``big`` is not
    shuffled.  Over it, the keys of ``big`` with more than ``hot_rows`` rows are
    counted first.  Rows of such a key are spread by ``spread`` over one salt per
    ``hot_rows`` of them, and its looked-up row is repeated as often; all other
    keys are joined as they are.  ``selective`` says that many keys of ``big`` have
    no match: over the limit ``may_match`` takes these out before the shuffle.
    """
    on = [on] if isinstance(on, str) else list(on)
    if small.fits(limit):
        return big.join(F.broadcast(small.df), on, how)
    if selective and how in ("inner", "left_semi"):
        big = may_match(big, small, on)
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    # at most one row per hot_rows of the long table
    hot = stage_sized(counts.select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")), "hot-keys")
    if not hot.rows:
        return big.join(small.df.hint("merge"), on, how)

    def marked(df):
        side = F.broadcast(hot.df) if hot.fits(limit) else hot.df.hint("merge")
        return df.join(side, on, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    salted = marked(big).withColumn("_salt", F.pmod(F.xxhash64(*spread), F.col("_salts").cast("long")).cast("int")).drop("_salts")
    repeated = marked(small.df).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return salted.join(repeated.hint("merge"), on + ["_salt"], how).drop("_salt")


_LOCAL_BITS = 33


def number_rows(df, order, name="row_number", start=1):
    """Global row numbers in ``order`` from one range sort.

    Rows are sorted over all tasks and numbered inside their partition; the
    partition sizes (one row per task) then give each partition its offset.
    The sorted rows are staged so that both passes see the same partitions.
    """
    sorted_rows = stage(df.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_seq", _LOCAL_BITS)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per task of the sort, so a single-partition window is bounded
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_seq").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local + F.lit(start))
        .drop("_part", "_offset", "_seq")
    )


def number_within(df, groups, order, name="row_number"):
    """1-based row numbers inside a bounded number of groups of unbounded size.

    The rows are numbered over all groups at once; the first number of each
    group (one row per group) is then taken off.
    """
    numbered = number_rows(df, [F.col(g) for g in groups] + list(order), "_number")  # reads the staged rows each time
    first = stage_sized(numbered.groupBy(*groups).agg(F.min("_number").alias("_first")), "groups")
    return (
        lookup_join(numbered, first, list(groups), spread=["_number"])
        .withColumn(name, F.col("_number") - F.col("_first") + 1)
        .drop("_number", "_first")
    )


def top_n(df, n, coarse, order):
    """The first ``n`` rows by ``order``; ``coarse`` is a number that sorts like it.

    The rows are read up to four times: stage what is costly to make.
    A quantile sketch of ``coarse``, a bounded buffer per task, gives a cut that
    leaves little more than ``n`` rows, and one count checks that it leaves
    enough.  What is left goes through one task if ``n`` is small, else it is
    numbered by a range sort.
    """
    keyed = df.withColumn("_coarse", coarse.cast("double"))
    accuracy = 10_000
    total = keyed.count()
    if total > n:
        share = min(1.0, (n + 1) / total * 1.01 + 2.0 / accuracy)
        cut = keyed.agg(F.percentile_approx("_coarse", F.lit(share), F.lit(accuracy)).alias("c")).first()["c"]
        if cut is not None and keyed.where(F.col("_coarse") <= cut).count() >= n:
            keyed = keyed.where(F.col("_coarse") <= cut)
    kept = keyed.drop("_coarse")
    if n <= TOP_IN_ONE_TASK:
        return kept.orderBy(*order).limit(n)
    return number_rows(kept, order, "_place").where(F.col("_place") <= n).drop("_place")
