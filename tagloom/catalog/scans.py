"""Sources and sinks.  Files are made by Spark from the given tables, then read back."""

from pyspark.sql import functions as F

from ..constants import LABELS, RAW_CSV_COLUMNS
from ..operators.alignment import count_nodes, dump_nodes
from ..operators.prep import legacy_view
from ..sources import readers, views, writers
from ..staging import scratch_path
from .registry import query
from .views import LABEL_LIST, call_names, clean, controls, names, with_views

FILE_BYTES = 1 << 29
DUMP_LINES = 1 << 22

_RAW_NAMES = {ours: theirs for theirs, ours in RAW_CSV_COLUMNS.items()}


def _write_raw_csv(spark, sf_dir):
    path = scratch_path(spark, "raw-csv")
    raw = views.raw_samples(spark, sf_dir).orderBy("sample_id")
    columns = [F.col(ours).cast("string").alias(theirs) for ours, theirs in _RAW_NAMES.items()]
    raw.select(*columns).write.options(**writers.CSV_OPTIONS).csv(path)
    return path


@query(
    "s1_scan_raw_csv",
    with_views(
        "SELECT row_number() OVER (ORDER BY sample_id) - 1 AS sample_id, raw_classification, project, text, '1' AS vul FROM raw_samples",
        "raw_samples",
    ),
)
def scan_raw_csv(spark, sf_dir):
    rows = readers.scan_raw_csv(spark, _write_raw_csv(spark, sf_dir))
    return rows.select("sample_id", "raw_classification", "project", "text", "vul")


@query(
    "s1_scan_raw_csv_single_file",
    with_views(
        "SELECT row_number() OVER (ORDER BY sample_id) - 1 AS sample_id, raw_classification, project, text, '1' AS vul FROM raw_samples",
        "raw_samples",
    ),
)
def scan_single_csv(spark, sf_dir):
    """One file, read in ranges that begin anywhere: most of them inside quotes.

    A file is written by one task, so above ``FILE_BYTES`` of text there is one for every so many.
    """
    path = scratch_path(spark, "raw-csv")
    raw = views.raw_samples(spark, sf_dir)
    files = -(-(raw.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // FILE_BYTES)
    raw = (raw.repartitionByRange(files, "sample_id") if files > 1 else raw.coalesce(1)).sortWithinPartitions("sample_id")
    raw.select(*[F.col(ours).cast("string").alias(theirs) for ours, theirs in _RAW_NAMES.items()]).write.options(**writers.CSV_OPTIONS).csv(path)
    rows = readers.scan_raw_csv(spark, path, range_bytes=1 << 18)
    return rows.select("sample_id", "raw_classification", "project", "text", "vul")


def _write_other_csv(spark, sf_dir):
    """The raw columns in another order, between columns that are not asked for."""
    path = scratch_path(spark, "raw-csv")
    raw = views.raw_samples(spark, sf_dir).orderBy("sample_id")
    columns = [F.col(ours).cast("string").alias(theirs) for ours, theirs in reversed(_RAW_NAMES.items())]
    raw.select(F.concat(F.lit("x,"), "sample_id").alias("id"), *columns, F.lit('a "b"\nc').alias("Summary")).write.options(**writers.CSV_OPTIONS).csv(path)
    return path


@query(
    "s1_scan_raw_csv_by_name",
    with_views(
        "SELECT row_number() OVER (ORDER BY sample_id) - 1 AS sample_id, raw_classification, project, text, '1' AS vul FROM raw_samples",
        "raw_samples",
    ),
)
def scan_other_csv(spark, sf_dir):
    rows = readers.scan_raw_csv(spark, _write_other_csv(spark, sf_dir))
    return rows.select("sample_id", "raw_classification", "project", "text", "vul")


@query(
    "s1_scan_raw_csv_max_rows",
    with_views("SELECT row_number() OVER (ORDER BY sample_id) - 1 AS sample_id, project, md5(text) AS digest FROM raw_samples ORDER BY sample_id LIMIT 77", "raw_samples"),
)
def scan_first_rows(spark, sf_dir):
    rows = readers.scan_raw_csv(spark, _write_raw_csv(spark, sf_dir), max_rows=77)
    return rows.select("sample_id", "project", F.md5("text").alias("digest"))


@query(
    "s2_scan_split",
    with_views(f"SELECT sample_id, split, text, {LABEL_LIST} FROM samples WHERE split = 'train'", "samples"),
)
def scan_split(spark, sf_dir):
    path = writers.write_split_dataset(views.samples(spark, sf_dir), scratch_path(spark, "clean"))
    return readers.scan_split(spark, path, "train").select("sample_id", "split", "text", *LABELS)


_LEGACY_SELECT = (
    "SELECT row_number() OVER (PARTITION BY split ORDER BY sample_id) - 1 AS \"index\", sample_id, text, func_before, labels, exec_code, mem_corr FROM ("
    "SELECT sample_id, split, text, text AS func_before, exec AS exec_code, mem AS mem_corr, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {l} = 1 THEN '{l}' END" for l in LABELS)
    + "], lambda x: x IS NOT NULL), ',') AS labels FROM samples)"
)


def _legacy_files(spark, sf_dir, kinds=tuple(writers.LEGACY_SEPARATORS)):
    view = legacy_view(views.samples(spark, sf_dir))
    return view.drop("tags").schema, writers.write_legacy_views(view, scratch_path(spark, "legacy"), kinds)


@query("s3_scan_delimited_legacy", with_views(_LEGACY_SELECT, "samples"))
def scan_delimited_legacy(spark, sf_dir):
    schema, paths = _legacy_files(spark, sf_dir, ("hash",))
    rows = readers.scan_delimited_legacy(spark, paths["hash"], schema)
    return rows.select("index", "sample_id", "text", "func_before", "labels", "exec_code", "mem_corr")


_NODES = """nodes AS MATERIALIZED (
  SELECT filename, kind, label, value, code, pos FROM (
    SELECT fn AS filename, 0 AS kind, 'IDENTIFIER' AS label, unnest(v0) AS value, unnest(v0) AS code, generate_subscripts(v0, 1) AS pos FROM src
    UNION ALL SELECT fn, 1, 'CALL', unnest(v1), unnest(v1), generate_subscripts(v1, 1) FROM src
    UNION ALL SELECT fn, 2, 'CONTROL_STRUCTURE', '', unnest(v2), generate_subscripts(v2, 1) FROM src))"""


def with_nodes(select):
    """``select`` over nodes(filename, kind, label, value, code, pos) of all samples."""
    source = (
        "src AS MATERIALIZED (SELECT project || '/' || sample_id || '.cpp' AS fn, "
        f"{names('text')} AS v0, {call_names('text')} AS v1, {controls('text')} AS v2 FROM samples)"
    )
    base = with_views("", "samples").rstrip()
    return f"{base},\n{source},\n{_NODES}\n{select}"


@query(
    "s4_scan_node_dump",
    with_nodes("SELECT filename, label, value, code, count(*) AS n FROM nodes GROUP BY ALL"),
)
def scan_node_dump(spark, sf_dir):
    lines = dump_nodes(views.samples(spark, sf_dir)).select(F.concat_ws("\t", "filename", "label", "value", "code").alias("value"))
    chatter = spark.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in ("", "executing dump\tIDENTIFIER\tx\ty", "Creating project x\ty", "no tab", "f\tCALL\tshort", "f\tBLOCK\tv\tc")])).alias("value")
    )
    path = scratch_path(spark, "dump")
    # a file of gzip is read by one task, so its lines are bounded
    lines.unionByName(chatter).write.options(compression="gzip", maxRecordsPerFile=DUMP_LINES).text(path)
    rows = readers.scan_node_dump(spark, path)
    return count_nodes(rows)


@query(
    "s5_scan_vectors_text",
    "SELECT 'w' || vec_id AS word, generate_subscripts(embedding, 1)::BIGINT AS dim, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings",
)
def scan_vectors_text(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    path = scratch_path(spark, "vectors")
    vectors.select(
        F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id")), F.col("embedding").cast("array<string>")).alias("value")
    ).write.text(path)
    rows = readers.scan_vectors_text(spark, path)
    return rows.select("word", F.posexplode("vector").alias("d", "v")).select(
        "word", (F.col("d") + 1).cast("long").alias("dim"), F.round(F.col("v").cast("double"), 6).alias("value")
    )


@query(
    "s5_scan_vocabulary_text",
    "SELECT 'w' || vec_id AS word, vec_id::INTEGER AS token_id FROM embeddings WHERE label <> 0",
)
def scan_vocabulary_text(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    path = scratch_path(spark, "vocabulary")
    # lines of label 0 get a third part and must be left out
    vectors.select(
        F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id")), "vec_id", F.when(F.col("label") == 0, "x")).alias("value")
    ).write.text(path)
    return readers.scan_vocabulary_text(spark, path)


@query(
    "s6_scan_predictions",
    with_views("SELECT sample_id, " + ", ".join(f"score_{l} AS {l}" for l in LABELS) + " FROM scored", "scored"),
)
def scan_predictions(spark, sf_dir):
    scored = views.with_scores(views.samples(spark, sf_dir))
    path = scratch_path(spark, "scores")
    writers.write_predictions(scored.select("sample_id", *[F.col(f"score_{l}").alias(l) for l in LABELS]), path, "csv")
    return readers.scan_predictions(spark, path)


@query(
    "s6_scan_predictions_unkeyed",
    with_views(
        "SELECT row_number() OVER (ORDER BY sample_id) - 1 AS position, " + ", ".join(f"score_{l} AS {l}" for l in LABELS) + " FROM scored", "scored"
    ),
)
def scan_unkeyed(spark, sf_dir):
    scored = views.with_scores(views.samples(spark, sf_dir)).orderBy("sample_id")
    path = scratch_path(spark, "scores")
    writers.write_label_table(scored, path, "score_")
    return readers.scan_predictions(spark, path, key=None)


@query(
    "k4_write_true_labels",
    with_views("SELECT row_number() OVER (ORDER BY sample_id) - 1 AS position, " + LABEL_LIST + " FROM samples", "samples"),
)
def write_true_labels(spark, sf_dir):
    path = scratch_path(spark, "labels")
    writers.write_label_table(views.samples(spark, sf_dir).orderBy("sample_id"), path)
    return readers.scan_predictions(spark, path, key=None, kind="integer")


@query(
    "k1_write_split_dataset",
    with_views(f"SELECT sample_id, split, text, raw_classification, project, {LABEL_LIST} FROM samples", "samples"),
)
def write_split_dataset(spark, sf_dir):
    clean = views.samples(spark, sf_dir)
    path = writers.write_split_dataset(clean, scratch_path(spark, "clean-csv"), "csv")
    rows = readers.scan_split(spark, path, fmt="csv", schema=clean.drop("split").schema.add("split", "string"))
    return rows.select("sample_id", "split", "text", "raw_classification", "project", *LABELS)


@query("k2_write_legacy_views", with_views(_LEGACY_SELECT, "samples"))
def write_legacy_views(spark, sf_dir):
    schema, paths = _legacy_files(spark, sf_dir)
    rows = readers.scan_delimited_legacy(spark, paths["csv"], schema, ",")
    return rows.select("index", "sample_id", "text", "func_before", "labels", "exec_code", "mem_corr")


def _sql_map(body):
    return f"(SELECT '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' FROM ({body}))"


_ANY = " + ".join(LABELS)


@query(
    "k3_write_summary_json",
    with_views(
        "SELECT '{\"kept_rows\":' || (SELECT count(*) FROM samples)"
        " || ',\"label_by_split\":{' || (SELECT string_agg('\"' || split || '\":{' || pairs || '}', ',' ORDER BY split) FROM ("
        "SELECT split, string_agg('\"' || label || '\":' || n, ',' ORDER BY label) AS pairs FROM ("
        "SELECT split, label, sum(y)::BIGINT AS n FROM long_labels GROUP BY ALL HAVING sum(y) > 0) GROUP BY split)) || '}'"
        " || ',\"label_totals\":' || "
        + _sql_map("SELECT label AS k, sum(y)::BIGINT AS n FROM long_labels GROUP BY label")
        + " || ',\"processed_rows\":' || (SELECT count(*) FROM labelled) || ',\"seed\":42'"
        + f" || ',\"skipped_empty_text\":' || (SELECT count(*) FROM labelled WHERE {_ANY} > 0 AND {clean('text')} = '')"
        + f" || ',\"skipped_no_label\":' || (SELECT count(*) FROM labelled WHERE {_ANY} = 0)"
        + " || ',\"split_sizes\":' || "
        + _sql_map("SELECT split AS k, count(*) AS n FROM samples GROUP BY split")
        + " || ',\"top_raw_classifications\":[' || (SELECT string_agg('{\"raw_classification\":\"' || raw_classification || '\",\"n\":' || n || '}', ',' ORDER BY n DESC, first_id) FROM ("
        "SELECT raw_classification, count(*) AS n, min(sample_id) AS first_id FROM samples GROUP BY 1 ORDER BY n DESC, first_id LIMIT 25)) || ']'"
        + " || '}' AS value",
        "long_labels",
    ),
)
def write_summary_json(spark, sf_dir):
    path = writers.write_prep_summary(views.raw_samples(spark, sf_dir), views.samples(spark, sf_dir), scratch_path(spark, "summary"), seed=42)
    return spark.read.text(path)


@query(
    "k4_write_predictions",
    with_views(
        "SELECT sample_id, raw_classification, "
        + ", ".join(f"score_{l}, (score_{l} >= 0.5)::INTEGER AS pred_{l}, true_{l}" for l in LABELS)
        + " FROM scored",
        "scored",
    ),
)
def write_predictions(spark, sf_dir):
    table = writers.predictions_table(views.predictions(spark, sf_dir))
    return spark.read.schema(table.schema).parquet(writers.write_predictions(table, scratch_path(spark, "predictions")))


@query(
    "k5_write_source_bodies",
    with_views(
        "SELECT sample_id, project, 'sources/' || project || '/' || sample_id || '.cpp' AS source_path, raw_classification, "
        "CASE WHEN NOT contains(text, '#include') THEN '#include <stdint.h>' || chr(10) || '#include <stddef.h>' || chr(10) || chr(10) || text || chr(10) "
        "WHEN NOT ends_with(text, chr(10)) THEN text || chr(10) ELSE text END AS body FROM samples",
        "samples",
    ),
)
def write_source_bodies(spark, sf_dir):
    path = writers.write_source_bodies(views.samples(spark, sf_dir), scratch_path(spark, "bodies"))
    return spark.read.parquet(path)
