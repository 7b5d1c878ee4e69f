"""Scans: raw CSV, prepared splits, delimited legacy files, node dumps, vectors, scores."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import LABELS, RAW_CSV_COLUMNS
from ..functions.elements import NODE_KINDS
from ..operators.prep import once
from ..staging import lookup_join, stage, stage_sized
from . import records

RAW_CSV_SCHEMA = T.StructType([T.StructField(ours, T.StringType()) for ours in RAW_CSV_COLUMNS.values()])

# Lines of tool output inside a node dump.
DUMP_CHATTER = ("executing ", "Creating project ")


def _csv(spark, sep=","):
    """A file whose header differs from the first one's is an error, not a shift of its columns."""
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("sep", sep)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("maxCharsPerColumn", -1)
        .option("encoding", "UTF-8")
        .option("mode", "PERMISSIVE")
    )


def _by_name(rows, schema, names=None):
    """The columns of ``schema``, found by their names in the file, whatever their order and company."""
    names = names or {}
    wanted = {f.name: names.get(f.name, f.name) for f in schema.fields}
    missing = [theirs for theirs in wanted.values() if theirs not in rows.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(rows.columns)}")
    return [F.col(f"`{wanted[f.name]}`").cast(f.dataType).alias(f.name) for f in schema.fields]


def _numbered(rows, name, file="_file"):
    """0-based record numbers, files in path order.

    A quoted file is one partition, so the place of a record in its file is a
    difference of row ids, and one row per file gives the offsets.  The rows are
    staged once, neither shuffled nor sorted.
    """
    placed = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "records")
    files = placed.groupBy(file).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per file, so a single-partition window is bounded
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage_sized(files.select(file, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset")), "files")
    found = lookup_join(placed, offsets, file, spread=["_row"])
    return found.withColumn(name, F.col("_row") + F.col("_offset")).drop(file, "_row", "_offset")


def _split_records(spark, path, max_rows, sep=",", quote='"', range_bytes=None):
    """Text columns by name and ``_number`` of all records; with ``max_rows``, of the leading files that hold as many.

    Files are opened in path order, four times as many at a time, until there are enough records.
    """
    if max_rows is None:
        found = records.read_records(spark, path, quote, range_bytes)
    else:
        files, taken = records.listed_files(spark, path), 1
        while True:
            found = records.read_records(spark, files[:taken], quote, range_bytes)
            if taken >= len(files) or found.count() - taken >= max_rows:
                break
            taken = min(4 * taken, len(files))
    names = records.header(found, sep, quote)
    numbered = records.number_records(found, "_number")
    parsed = numbered.select(records.fields(F.col("_record"), len(names), sep, quote).alias("_fields"), "_number")
    return parsed.select(*[F.col("_fields")[f"c{i}"].alias(n) for i, n in enumerate(names)], "_number")


def scan_raw_csv(spark, path, schema=RAW_CSV_SCHEMA, rename=RAW_CSV_COLUMNS, numbered=True, max_rows=None, split=True, range_bytes=None):
    """Raw CSV with line breaks inside quotes; bytes that are not UTF-8 become U+FFFD.

    Columns are found by their names in the header; others are not read, and a
    missing one is an error.  ``sample_id`` is the 0-based record number, files
    in path order, and missing values are empty strings.  With ``max_rows`` only
    the leading files that hold these records are opened.  Files are read in
    byte ranges by all tasks, whatever their size; quotes may then stand only
    around fields, and an unpaired one is an error.  ``split=False`` reads each
    file in one task and takes stray quotes as they come.
    """
    theirs = {ours: name for name, ours in rename.items()}
    if split:
        rows = _split_records(spark, path, max_rows, range_bytes=range_bytes)
        columns = [*_by_name(rows, schema, theirs), F.col("_number").alias("sample_id")]
    else:
        if max_rows is not None:
            raise ValueError("max_rows needs split=True")
        rows = _csv(spark).csv(path)
        columns = [*_by_name(rows, schema, theirs), F.col("_metadata.file_path").alias("_file")]
    filled = rows.select(*columns).withColumns({f.name: F.coalesce(f.name, F.lit("")) for f in schema.fields})
    if not split and numbered:
        filled = _numbered(filled, "sample_id")
    if max_rows is not None:
        filled = filled.where(F.col("sample_id") < max_rows)
    return filled.select(*schema.names, *(["sample_id"] if numbered else []))


def scan_split(spark, path, split=None, fmt="parquet", schema=None, labels=LABELS):
    """A prepared table (or one of its splits) with integer labels; gzip is read by suffix."""
    rows = spark.read.parquet(path) if fmt == "parquet" else _csv(spark).csv(path)
    if fmt != "parquet":
        rows = rows.select(*_by_name(rows, schema))
    if split is not None:
        rows = rows.where(F.col("split") == split)
    return rows.withColumns({label: F.col(label).cast("int") for label in labels})


def scan_delimited_legacy(spark, path, schema, sep="#"):
    rows = _csv(spark, sep).csv(path)
    return rows.select(*_by_name(rows, schema))


def scan_node_dump(spark, path):
    """Tab-separated dump lines ``filename, label, value, code`` of the three node kinds.

    ``line_no`` orders the lines of a file; it grows with the position in the dump.
    """
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return parse_node_lines(lines)


def parse_node_lines(lines):
    value = F.col("value")
    chatter = [F.startswith(value, F.lit(prefix)) for prefix in DUMP_CHATTER]
    kept = lines.where(F.contains(value, F.lit("\t")) & ~chatter[0] & ~chatter[1])
    # a filter on the parts would split the line again for every use of them
    return (
        once(kept, "parts", F.split(value, "\t", 4))
        .where(F.size("parts") == 4)
        .select(
            "line_no",
            *[F.col("parts")[i].alias(n) for i, n in enumerate(("filename", "label", "value", "code"))],
        )
        .where(F.col("label").isin(*NODE_KINDS))
    )


def scan_vectors_text(spark, path):
    """Lines ``word f1 … fd`` to (word, vector); a leading ``count size`` line is left out."""
    parts = F.split(F.trim("value"), " +")
    return (
        spark.read.text(path)
        .select(parts.alias("p"))
        .where(F.size("p") > 2)
        .select(
            F.col("p")[0].alias("word"),
            F.slice("p", F.lit(2), F.size("p") - 1).cast("array<float>").alias("vector"),
        )
    )


def scan_vocabulary_text(spark, path):
    """Lines ``word id``; lines that do not have exactly two parts are left out."""
    parts = F.split(F.trim("value"), "[ \t]+")
    return (
        spark.read.text(path)
        .select(parts.alias("p"))
        .where(F.size("p") == 2)
        .select(F.col("p")[0].alias("word"), F.col("p")[1].cast("int").alias("token_id"))
    )


def scan_predictions(spark, path, labels=LABELS, fmt="csv", key="sample_id", kind="double"):
    """Score or label table with one column per label, found by name.

    ``key`` names the key column.  With ``key=None`` the file has none, and
    ``position``, the 0-based record number, is what such tables are aligned by.
    """
    schema = T.StructType([] if key is None else [T.StructField(key, T.LongType())])
    for label in labels:
        schema = schema.add(label, kind)
    rows = spark.read.parquet(path) if fmt == "parquet" else _csv(spark).csv(path)
    columns = _by_name(rows, schema)
    if key is not None:
        return rows.select(*columns)
    return _numbered(rows.select(*columns, F.col("_metadata.file_path").alias("_file")), "position").select("position", *labels)
