"""Code elements, node cells, joins of dumps and manifests, token sets."""

from pyspark.sql import functions as F

from ..constants import FIELDS, LABELS, LEGACY_RULE_LABELS
from ..functions import elements as E
from ..operators import alignment, rules
from ..operators.prep import once
from ..sources import views, writers
from .registry import query
from .scans import with_nodes
from .views import call_names, calls, controls, ids, names, quoted, split_identifier, with_views


def _sorted(column):
    return F.array_join(F.array_sort(column), " ")


def _sql_sorted(x):
    return f"array_to_string(list_sort({x}), ' ')"


def _text_query(name, function, expression):
    sql = with_views(f"SELECT sample_id, {_sql_sorted(expression)} AS tokens FROM samples", "samples")

    def run(spark, sf_dir):
        return views.samples(spark, sf_dir).select("sample_id", _sorted(function(F.col("text"))).alias("tokens"))

    query(name, sql)(run)


_text_query("c1_extract_identifiers", E.identifiers, ids("text"))
_text_query("c2_extract_calls", E.calls, calls("text"))
_text_query("c3_extract_controls", E.controls, controls("text"))


@query(
    "c4_build_elements_pages",
    f"SELECT page_id AS sample_id, {_sql_sorted(ids('html'))} AS ids, {_sql_sorted(calls('html'))} AS calls, "
    f"{_sql_sorted(controls('html'))} AS controls FROM pages",
)
def build_elements_pages(spark, sf_dir):
    return rules.build_elements(views.page_code(spark, sf_dir)).select("sample_id", *[_sorted(F.col(f)).alias(f) for f in FIELDS])


@query(
    "c4_build_elements",
    with_views("SELECT sample_id, split, " + ", ".join(f"{_sql_sorted(f)} AS {f}" for f in FIELDS) + " FROM element_sets", "element_sets"),
)
def build_elements(spark, sf_dir):
    return rules.build_elements(views.samples(spark, sf_dir)).select(
        "sample_id", "split", *[_sorted(F.col(f)).alias(f) for f in FIELDS]
    )


def _node_text(values, kind, key):
    return f"list_transform({values}, lambda v: '{{\"_label\": \"{kind}\", \"{key}\": \"' || v || '\"}}')"


_CELL = (
    "'[' || array_to_string(list_concat(list_concat("
    + _node_text(names("text"), "IDENTIFIER", "name") + ", "
    + _node_text(call_names("text"), "CALL", "name") + "), "
    + _node_text(controls("text"), "CONTROL_STRUCTURE", "code")
    + "), ', ') || ']--====--'"
)


@query(
    "c5_build_pseudo_cpg",
    with_views(f"SELECT sample_id, length(c)::INTEGER AS n_chars, md5(c) AS digest FROM (SELECT sample_id, {_CELL} AS c FROM samples)", "samples"),
)
def pseudo_cell(spark, sf_dir):
    cells = views.samples(spark, sf_dir).select("sample_id", E.pseudo_cell("text").alias("c"))
    return cells.select("sample_id", F.length("c").alias("n_chars"), F.md5("c").alias("digest"))


@query(
    "c6_parse_cpg",
    with_views(
        f"SELECT sample_id, CASE WHEN big THEN len({names('text')}) ELSE 0 END::INTEGER AS identifiers, "
        f"CASE WHEN big THEN len({call_names('text')}) ELSE 0 END::INTEGER AS calls, "
        f"CASE WHEN big THEN len({controls('text')}) ELSE 0 END::INTEGER AS controls "
        f"FROM (SELECT *, length({_CELL}) > 100 AS big FROM samples)",
        "samples",
    ),
)
def parse_cell(spark, sf_dir):
    cells = once(views.samples(spark, sf_dir), "_cell", E.pseudo_cell("text")).select("sample_id", "_cell")
    nodes = once(cells, "nodes", E.parse_cell("_cell"))

    def count(kind):
        return F.size(F.filter("nodes", lambda n: n["_label"] == kind))

    return nodes.select(
        "sample_id", *[count(k).alias(n) for k, n in zip(E.NODE_KINDS, ("identifiers", "calls", "controls"))]
    )


@query(
    "c6_parse_event_props",
    "SELECT event_id, (json_extract(props, '$.k'))::INTEGER AS k FROM events",
)
def parse_props(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_ALL_CALLS = "list_distinct(" + split_identifier("array_to_string(" + call_names("text") + ", ' ')") + ")"


@query(
    "c7_elements_from_nodes",
    with_views(
        f"SELECT sample_id, {_sql_sorted(ids('text'))} AS ids, {_sql_sorted(_ALL_CALLS)} AS calls, "
        f"{_sql_sorted(controls('text'))} AS controls FROM samples",
        "samples",
    ),
)
def elements_from_nodes(spark, sf_dir):
    rows = rules.elements_from_cells(views.samples(spark, sf_dir))
    return rows.select("sample_id", *[_sorted(F.col(f)).alias(f) for f in FIELDS])


@query(
    "c7_elements_from_dump",
    with_views(
        f"SELECT project || '/' || sample_id || '.cpp' AS filename, {_sql_sorted(ids('text'))} AS ids, {_sql_sorted(_ALL_CALLS)} AS calls, "
        f"{_sql_sorted(controls('text'))} AS controls FROM samples",
        "samples",
    ),
)
def elements_from_dump(spark, sf_dir):
    sets = alignment.file_elements(alignment.dump_nodes(views.samples(spark, sf_dir)))
    return sets.select("filename", *[_sorted(F.col(f)).alias(f) for f in FIELDS])


@query(
    "c8_select_label_columns",
    with_views(
        f"SELECT code, {', '.join(LEGACY_RULE_LABELS)}, (len({names('code')}) + len({call_names('code')}) + len({controls('code')}))::INTEGER AS n_nodes "
        "FROM (SELECT text AS code, * FROM samples)",
        "samples",
    ),
)
def label_columns(spark, sf_dir):
    rows = views.samples(spark, sf_dir).withColumn("cpg", E.pseudo_cell("text"))
    return rules.select_label_columns(rows).select("code", *LEGACY_RULE_LABELS, F.size("elements").alias("n_nodes"))


_CELLS_SQL = (
    "file_cells AS MATERIALIZED (SELECT filename, count(*) AS n_nodes, '[' || string_agg("
    "'{\"_label\": \"' || label || '\", \"name\": \"' || value || '\", \"code\": \"' || code || '\"}', ', ' ORDER BY kind, pos) "
    "|| ']--====--' AS cpg FROM nodes GROUP BY filename)"
)


def _with_cells(select):
    return with_nodes(select).replace("\n" + select, ",\n" + _CELLS_SQL + "\n" + select)


@query("c9_aggregate_nodes_by_file", _with_cells("SELECT filename, n_nodes, md5(cpg) AS digest FROM file_cells"))
def aggregate_nodes(spark, sf_dir):
    cells = alignment.aggregate_nodes_by_file(alignment.dump_nodes(views.samples(spark, sf_dir)))
    return cells.select("filename", "n_nodes", F.md5("cpg").alias("digest"))


_MANIFEST = "(SELECT sample_id, project, 'sources/' || project || '/' || sample_id || '.cpp' AS source_path, project || '/' || sample_id || '.cpp' AS filename FROM samples)"


def _dump(rows):
    # the dump holds the train files only, so that other files have no nodes
    return alignment.dump_nodes(rows.where("split = 'train'"))


_TRAIN_FILES = "filename IN (SELECT project || '/' || sample_id || '.cpp' FROM samples WHERE split = 'train')"


@query(
    "j1_join_manifest_nodes",
    _with_cells(
        f"SELECT m.sample_id, m.filename, coalesce(c.n_nodes, 0) AS n_nodes, md5(coalesce(c.cpg, '[]--====--')) AS digest "
        f"FROM {_MANIFEST} m LEFT JOIN (SELECT * FROM file_cells WHERE {_TRAIN_FILES}) c ON m.filename = c.filename"
    ),
)
def manifest_nodes(spark, sf_dir):
    rows = views.samples(spark, sf_dir)
    manifest = writers.source_bodies(rows).drop("body")
    joined = alignment.join_manifest_nodes(manifest, alignment.aggregate_nodes_by_file(_dump(rows)))
    return joined.select("sample_id", "filename", "n_nodes", F.md5("cpg").alias("digest"))


@query(
    "j2_join_source_cpg",
    _with_cells(
        "SELECT s.sample_id::VARCHAR AS sample_id, s.split, CASE WHEN s.split <> 'test' THEN 'sources/' || project || '/' || sample_id || '.cpp' END AS source_path, "
        "CASE WHEN s.split = 'train' THEN md5(c.cpg) WHEN s.split = 'val' THEN md5('[]--====--') END AS digest "
        "FROM samples s JOIN file_cells c ON c.filename = project || '/' || sample_id || '.cpp'"
    ),
)
def source_cells(spark, sf_dir):
    rows = views.samples(spark, sf_dir)
    manifest = writers.source_bodies(rows.where("split <> 'test'")).drop("body")
    cells = alignment.join_manifest_nodes(manifest, alignment.aggregate_nodes_by_file(_dump(rows)))
    return alignment.join_source_cells(rows, cells).select("sample_id", "split", "source_path", F.md5("cpg").alias("digest"))


@query(
    "a6_token_universe",
    with_views("SELECT DISTINCT field, token FROM element_tokens", "element_tokens"),
)
def token_universe(spark, sf_dir):
    return rules.token_universe(rules.build_elements(views.samples(spark, sf_dir)))


@query("u1_union_tokens", with_views("SELECT field, count(DISTINCT token) AS n FROM element_tokens GROUP BY field", "element_tokens"))
def union_tokens(spark, sf_dir):
    universe = rules.token_universe(rules.build_elements(views.samples(spark, sf_dir)))
    return universe.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u2_token_intersection",
    with_views(
        "SELECT sample_id, (len(list_intersect(ids, calls)) > 0)::INTEGER AS overlaps, len(list_intersect(ids, calls))::INTEGER AS n_common FROM element_sets",
        "element_sets",
    ),
)
def token_intersection(spark, sf_dir):
    rows = rules.build_elements(views.samples(spark, sf_dir))
    return rows.select(
        "sample_id", F.arrays_overlap("ids", "calls").cast("int").alias("overlaps"),
        F.size(F.array_intersect("ids", "calls")).alias("n_common"),
    )


@query(
    "u2_common_label_tokens",
    with_views(
        "SELECT field, token FROM element_tokens WHERE dos = 1 INTERSECT SELECT field, token FROM element_tokens WHERE info = 1",
        "element_tokens",
    ),
)
def common_label_tokens(spark, sf_dir):
    long = rules.field_tokens(rules.build_elements(views.samples(spark, sf_dir)), ("dos", "info"))
    both = long.groupBy("field", "token").agg(F.max("dos").alias("d"), F.max("info").alias("i"))
    return both.where("d = 1 AND i = 1").select("field", "token")


_PLAIN_CALLS = f"list_filter(list_distinct({call_names('text')}), lambda w: w NOT IN ({quoted(E.NOT_CALLS)}))"


@query(
    "u3_token_difference",
    with_views(
        f"SELECT sample_id, {_sql_sorted(_PLAIN_CALLS)} AS names FROM samples",
        "samples",
    ),
)
def token_difference(spark, sf_dir):
    kept = F.array_except(E.call_names(F.col("text")), F.array(*[F.lit(w) for w in E.NOT_CALLS]))
    return views.samples(spark, sf_dir).select("sample_id", _sorted(kept).alias("names"))


@query(
    "j3_align_predictions",
    with_views(
        "SELECT sample_id, " + ", ".join(f"score_{l}, true_{l}" for l in LABELS)
        + ", len(ids)::INTEGER AS n_ids FROM scored JOIN element_sets USING (sample_id)",
        "scored", "element_sets",
    ),
)
def align(spark, sf_dir):
    rows = views.samples(spark, sf_dir)
    scores = views.with_scores(rows).select("sample_id", *[f"score_{l}" for l in LABELS])
    sets = rules.build_elements(rows).select("sample_id", F.size("ids").alias("n_ids"))
    joined = alignment.align_predictions(scores, rows, sets)
    return joined.select("sample_id", *[c for l in LABELS for c in (f"score_{l}", f"true_{l}")], "n_ids")


@query(
    "j3_positions",
    with_views("SELECT row_number() OVER (ORDER BY sample_id) - 1 AS position, sample_id FROM samples", "samples"),
)
def positions(spark, sf_dir):
    return alignment.with_positions(views.samples(spark, sf_dir).select("sample_id"), ["sample_id"]).select("position", "sample_id")




@query(
    "j4_validate_alignment",
    with_views(
        "SELECT count(*) AS test_rows, (SELECT count(*) FROM samples) AS label_rows, 0::BIGINT AS repeated_keys, 0::BIGINT AS mismatched_rows, 1::INTEGER AS labels_match FROM samples",
        "samples",
    ),
)
def validate(spark, sf_dir):
    rows = views.samples(spark, sf_dir).select("sample_id", *LABELS)
    return alignment.validate_alignment(rows, rows.repartition("sample_id"))


@query(
    "j4_validate_misaligned",
    with_views(
        "SELECT count(*) AS test_rows, count(*) FILTER (split <> 'val') AS label_rows, "
        "0::BIGINT AS repeated_keys, count(*) FILTER (split = 'val' OR (split = 'test' AND dos = 0)) AS mismatched_rows, 0::INTEGER AS labels_match FROM samples",
        "samples",
    ),
)
def validate_misaligned(spark, sf_dir):
    rows = views.samples(spark, sf_dir).select("sample_id", "split", *LABELS)
    other = rows.where("split <> 'val'").withColumn("dos", F.when(F.col("split") == "test", 1).otherwise(F.col("dos")))
    return alignment.validate_alignment(rows, other)


@query(
    "j4_validate_repeated",
    with_views(
        "SELECT count(*) AS test_rows, count(*) + count(*) FILTER (split = 'test') AS label_rows, count(*) FILTER (split = 'test') AS repeated_keys, "
        "0::BIGINT AS mismatched_rows, 0::INTEGER AS labels_match FROM samples",
        "samples",
    ),
)
def validate_repeated(spark, sf_dir):
    rows = views.samples(spark, sf_dir).select("sample_id", "split", *LABELS)
    return alignment.validate_alignment(rows, rows.unionByName(rows.where("split = 'test'")))
