"""Records of quoted text files that are read in byte ranges.

A line break ends a record only outside quotes, and whether a place is inside
quotes depends on all that stands before it.  Two passes settle it without
reading a file in one task:  each range reports the parity of its quotes, and
running parities over the ranges of a file (one row per range) tell in which
state a range begins.  Then every range cuts its own lines into records.  A
record that crosses ranges comes in fragments, at most two for a range, which
are glued afterwards.
"""

import csv

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..staging import lookup_join, stage, stage_sized

RECORDS = "_file string, _start long, _seq long, _kind int, _record string"
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
BYTE_ORDER = "\ufeff"


def _lines(spark, path):
    """Lines with the file and the byte range they were read from; a task sees the lines of a range in order."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), "value")


def _range_key(file="_file", start="_start"):
    return F.xxhash64(file, start)


def _open_ranges(lines, quote):
    """Keys of the ranges that begin inside quotes, one number each; a file whose quotes do not pair is an error."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(quote), F.lit("")))
    ranges = stage(lines.groupBy("_file", "_start").agg((F.sum(quotes) % 2).alias("_odd")), "ranges")
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    unpaired = ranges.groupBy("_file").agg((F.sum("_odd") % 2).alias("_odd")).where("_odd = 1").limit(1).collect()
    if unpaired:
        raise ValueError(f"quotes do not pair in {unpaired[0]['_file']}; read it with split=False")
    states = ranges.withColumn("_open", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2)
    return np.sort(states.where("_open = 1").select(_range_key().alias("k")).toArrow()["k"].to_numpy())


def _cut(open_ranges, quote):
    """Lines of ranges to records and fragments; what is open at the end of a batch goes on in the next."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def decoded(records):
        """Byte strings as text; bytes that are not UTF-8 become U+FFFD."""
        try:
            return records.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([r.decode("utf-8", "replace") for r in records.to_pylist()], pa.string())

    def joined(lines, ends):
        """Lines up to each of the given ends, joined by line breaks."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), lines.slice(0, int(ends[-1]))), b"\n")

    def rows(where, seqs, kinds, records):
        count = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array([where[0]] * count), pa.array([where[1]] * count, pa.int64()), pa.array(seqs, pa.int64()), pa.array(kinds, pa.int32()), decoded(records)],
            names=["_file", "_start", "_seq", "_kind", "_record"],
        )

    def run(batches):
        where, waiting, seq, inside, continued = None, [], 0, False, False

        def close():
            """The fragment that is open where its range ends."""
            if waiting:
                record = pa.array([b"\n".join(waiting)], pa.binary())
                yield rows(where, [-1 if continued else seq], [MIDDLE if continued else TAIL], record)

        for batch in batches:
            files, starts, keys = (batch.column(i) for i in (0, 1, 2))
            lines = batch.column(3).cast(pa.binary())
            key = keys.to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                now = (files[low].as_py(), starts[low].as_py(), int(key[low]))
                if now != where:
                    yield from close()
                    where, waiting, seq = now, [], 0
                    at = np.searchsorted(open_ranges, now[2])
                    inside = continued = bool(at < len(open_ranges) and open_ranges[at] == now[2])
                part = lines.slice(low, high - low)
                after = (np.cumsum(pc.count_substring(part, quote.encode()).to_numpy()) + inside) % 2
                ends = np.flatnonzero(after == 0) + 1
                inside = bool(after[-1])
                if len(ends):
                    records = joined(part, ends)
                    if waiting:
                        first = b"\n".join([*waiting, records[0].as_py()])
                        records = pa.concat_arrays([pa.array([first], pa.binary()), records.slice(1)])
                    kinds = np.full(len(ends), WHOLE)
                    kinds[0] = HEAD if continued else WHOLE
                    size = pc.binary_length(records).to_numpy() - pc.ends_with(records, pattern=b"\r").to_numpy(zero_copy_only=False)
                    kept = (size > 0) | (kinds == HEAD)
                    records = records.filter(pa.array(kept))
                    kinds = kinds[kept]
                    numbers = np.where(kinds == HEAD, -1, seq + np.cumsum(kinds != HEAD) - 1)
                    yield rows(where, numbers, kinds, records)
                    seq += int((kinds != HEAD).sum())
                    waiting, continued = [], False
                    part = part.slice(int(ends[-1]))
                waiting = waiting + part.to_pylist()
        yield from close()

    return run


def _glued(fragments):
    """Records that cross ranges, in the place where they begin."""
    keys = ["_file", "_start", "_seq", "_kind"]
    order = Window.partitionBy("_file").orderBy("_start", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    chains = fragments.select(*keys).withColumn("_chain", F.sum((F.col("_kind") == TAIL).cast("int")).over(order))
    parts = fragments.join(chains, keys).groupBy("_file", "_chain").agg(F.array_sort(F.collect_list(F.struct("_start", "_seq", "_record"))).alias("_parts"))
    first = F.col("_parts")[0]
    return parts.select("_file", first["_start"].alias("_start"), first["_seq"].alias("_seq"), F.array_join("_parts._record", "\n").alias("_record"))


def read_records(spark, path, quote='"', range_bytes=None):
    """(_file, _start, _seq, _record): records, with their number in the byte range where they begin.

    Empty lines between records are left out, as is a carriage return before the
    line break that ends a record.  Quotes may stand only around fields, and
    doubled inside them.  ``range_bytes`` is the most that a range holds, by
    default what the session reads in one task.  The driver sees one number for
    a range that begins inside quotes.  The records are written once.
    """
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    try:  # both passes have to see the same ranges, and both are done on return
        if range_bytes:
            spark.conf.set(setting, str(range_bytes))
        lines = _lines(spark, path)
        marked = lines.select("_file", "_start", _range_key().alias("_key"), F.col("value").cast("binary"))
        cut = stage(marked.mapInArrow(_cut(_open_ranges(lines, quote), quote), RECORDS), "records")
    finally:
        spark.conf.set(setting, before)
    whole = cut.where(F.col("_kind") == WHOLE).select("_file", "_start", "_seq", "_record")
    rows = whole.unionByName(_glued(cut.where(F.col("_kind") != WHOLE)))
    return rows.withColumn("_record", F.regexp_replace("_record", "\\r\\z", ""))


def _first_ranges(records):
    """By file, the range where its first record stands."""
    return records.groupBy("_file").agg(F.min("_start").alias("_first"))


def header(records, sep, quote):
    """The column names; files whose first records name others are an error, not a shift of columns."""
    firsts = records.where(F.col("_seq") == 0).groupBy("_file").agg(F.min(F.struct("_start", "_record")).alias("_head"))
    found = firsts.groupBy(F.col("_head._record").alias("_record")).agg(F.min("_file").alias("_file")).limit(100).collect()
    named = {tuple(next(csv.reader([r["_record"].removeprefix(BYTE_ORDER)], delimiter=sep, quotechar=quote))): r["_file"] for r in found}
    if len(named) > 1:
        raise ValueError(f"the header of {max(named.values())} has other column names than that of {min(named.values())}")
    names = list(next(iter(named), ()))
    return [n if names.count(n) == 1 else f"{n}{i}" for i, n in enumerate(names)]


def fields(record, count, sep, quote):
    """The text fields of a record as a struct of ``count`` columns."""
    options = {"sep": sep, "quote": quote, "escape": quote, "maxCharsPerColumn": "-1", "maxColumns": str(max(count, 1) + 1024)}
    return F.from_csv(record, ", ".join(f"c{i} string" for i in range(count)), options)


def number_records(records, name):
    """0-based numbers of the records after the headers, files in path order; one row per range gives the offsets."""
    counts = records.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n")).join(_first_ranges(records), "_file")
    counts = counts.select("_file", "_start", "_n", (F.col("_start") == F.col("_first")).cast("long").alias("_header"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("_n") - F.col("_header")).over(before), F.lit(0)) - F.col("_header")
    offsets = stage_sized(counts.select("_file", "_start", offset.alias("_offset"), "_header"), "offsets")
    found = lookup_join(records, offsets, ["_file", "_start"], spread=["_seq"]).where(F.col("_seq") >= F.col("_header"))
    return found.withColumn(name, F.col("_offset") + F.col("_seq")).drop("_offset", "_header")


def listed_files(spark, path):
    """Paths of the files in order, without opening them."""
    return [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]
