"""Labels, cleaning, splits, legacy views, counts and samples."""

from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.labels import assign_split, label_columns, label_mask, labels_to_list
from ..functions.text import (
    ensure_c_source, minimal_clean_text, safe_project_name, source_key,
)
from ..operators import prep
from ..sources import views, writers
from ..staging import scratch_path
from .registry import ORACLES, query
from .views import ANY_LABEL, LABEL_LIST, clean, split_of, strip, with_views

_SUM = " + ".join(LABELS)


@query("p1_normalize_labels", with_views(f"SELECT sample_id, {LABEL_LIST} FROM labelled", "labelled"))
def normalize_labels(spark, sf_dir):
    raw = views.raw_samples(spark, sf_dir).withColumn("m", label_mask("raw_classification"))
    return raw.select("sample_id", *label_columns("m"))


@query(
    "p1_normalize_labels_events",
    "SELECT event_type, CASE WHEN lower(event_type) IN ('', 'nan', 'none', 'null', 'n/a') THEN 0 ELSE 1 END AS other, count(*) AS n "
    "FROM events GROUP BY ALL",
)
def normalize_labels_events(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").withColumn("m", label_mask("event_type"))
    return events.select("event_type", *label_columns("m")).groupBy("event_type", "other").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p2_filter_labeled",
    with_views(f"SELECT sample_id, raw_classification FROM labelled WHERE {ANY_LABEL}", "labelled"),
)
def filter_labeled(spark, sf_dir):
    return prep.filter_labeled(views.raw_samples(spark, sf_dir)).select("sample_id", "raw_classification")


_LIST = "list_filter([" + ", ".join(f"CASE WHEN {l} = 1 THEN '{l}' END" for l in LABELS) + "], lambda x: x IS NOT NULL)"


@query(
    "p3_labels_to_list",
    with_views(f"SELECT sample_id, len({_LIST})::INTEGER AS n_tags, array_to_string({_LIST}, ',') AS labels FROM samples", "samples"),
)
def labels_list(spark, sf_dir):
    tagged = views.samples(spark, sf_dir).withColumn("tags", labels_to_list())
    return tagged.select("sample_id", F.size("tags").alias("n_tags"), F.array_join("tags", ",").alias("labels"))


@query("p4_minimal_clean_text", f"SELECT doc_id, {clean('text')} AS text FROM documents")
def clean_text(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", minimal_clean_text("text").alias("text"))


@query("p5_filter_nonempty_text", f"SELECT doc_id, {clean('text')} AS text FROM documents WHERE {clean('text')} <> ''")
def filter_nonempty(spark, sf_dir):
    return prep.filter_nonempty_text(views.documents(spark, sf_dir)).select("doc_id", "text")


@query("p6_assign_split", f"SELECT doc_id, {split_of('doc_id')} AS split FROM documents")
def split(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", assign_split("doc_id").alias("split"))


@query(
    "p7_legacy_view",
    with_views(
        "SELECT row_number() OVER (PARTITION BY split ORDER BY sample_id) - 1 AS \"index\", sample_id, text AS processed_func, text AS code, "
        "info AS \"+info\", priv AS \"+priv\", mem AS \"mem.\", exec AS exec_code, mem AS mem_corr, "
        f"array_to_string({_LIST}, ',') AS labels, '' AS cpg FROM samples",
        "samples",
    ),
)
def legacy_view(spark, sf_dir):
    return prep.legacy_view(views.samples(spark, sf_dir)).select(
        "index", "sample_id", "processed_func", "code", "+info", "+priv", "`mem.`", "exec_code", "mem_corr", "labels", "cpg"
    )


@query(
    "p8_safe_project_name",
    "SELECT page_id, coalesce(nullif(trim(regexp_replace(coalesce(nullif(url, ''), 'unknown_project'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'unknown_project') AS name FROM pages",
)
def project_name(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", safe_project_name("url").alias("name"))


@query(
    "p9_ensure_c_source",
    "SELECT doc_id, CASE WHEN NOT contains(text, '#include') THEN '#include <stdint.h>' || chr(10) || '#include <stddef.h>' || chr(10) || chr(10) || text || chr(10) "
    "WHEN NOT ends_with(text, chr(10)) THEN text || chr(10) ELSE text END AS body FROM documents",
)
def c_source(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", ensure_c_source("text").alias("body"))


@query(
    "p10_source_key",
    "SELECT page_id, array_to_string(list_slice(string_split(url, '/'), -2, -1), '/') AS key FROM pages",
)
def key(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", source_key("url").alias("key"))


@query(
    "p21_drop_rename_columns",
    with_views(
        f"SELECT sample_id, split, text, {LABEL_LIST}, array_to_string(list_sort(['sample_id', 'split', 'text', 'raw_classification', 'project', 'cve_id', 'cwe_id', 'vul', "
        "'tags', 'labels', 'exec_code', 'mem_corr', " + ", ".join(f"'{l}'" for l in LABELS) + "]), ',') AS left_columns FROM samples",
        "samples",
    ),
)
def drop_rename(spark, sf_dir):
    view = prep.legacy_view(views.samples(spark, sf_dir), numbered=False)
    kept = prep.drop_rename_columns(view)
    return kept.select("sample_id", "split", "text", *LABELS, F.lit(",".join(sorted(kept.columns))).alias("left_columns"))


@query(
    "a1_prep_summary",
    with_views(
        f"SELECT count(*) AS processed_rows, count(*) FILTER ({_SUM} > 0 AND {clean('text')} <> '') AS kept_rows, "
        f"count(*) FILTER ({_SUM} = 0) AS skipped_no_label, count(*) FILTER ({_SUM} > 0 AND {clean('text')} = '') AS skipped_empty_text FROM labelled",
        "labelled",
    ),
)
def summary(spark, sf_dir):
    return prep.prep_summary(views.raw_samples(spark, sf_dir))


@query("a2_split_sizes", with_views("SELECT split, count(*) AS n FROM samples GROUP BY split", "samples"))
def split_sizes(spark, sf_dir):
    return prep.split_sizes(views.samples(spark, sf_dir))


@query("a3_label_totals", with_views("SELECT label, sum(y)::BIGINT AS n FROM long_labels GROUP BY label", "long_labels"))
def label_totals(spark, sf_dir):
    return prep.label_totals(views.samples(spark, sf_dir))


@query(
    "a4_label_by_split",
    with_views("SELECT split, label, sum(y)::BIGINT AS n FROM long_labels GROUP BY ALL HAVING sum(y) > 0", "long_labels"),
)
def label_by_split(spark, sf_dir):
    return prep.label_by_split(views.samples(spark, sf_dir))


@query(
    "a4_label_by_split_rollup",
    with_views(
        "SELECT coalesce(split, 'all') AS split, coalesce(label, 'all') AS label, sum(y)::BIGINT AS n FROM long_labels "
        "WHERE y > 0 GROUP BY ROLLUP (split, label)",
        "long_labels",
    ),
)
def label_by_split_rollup(spark, sf_dir):
    return prep.label_by_split_rollup(views.samples(spark, sf_dir))


@query(
    "a5_top_raw_classifications",
    with_views(
        "SELECT raw_classification, count(*) AS n FROM samples GROUP BY raw_classification ORDER BY count(*) DESC, min(sample_id) LIMIT 25",
        "samples",
    ),
)
def top_raw(spark, sf_dir):
    return prep.top_raw_classifications(views.samples(spark, sf_dir))


@query(
    "a5_top_event_types",
    f"SELECT {strip('event_type')} AS raw_classification, count(*) AS n FROM events GROUP BY 1 ORDER BY count(*) DESC, min(event_id) LIMIT 25",
)
def top_events(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    return prep.top_raw_classifications(
        events.select(F.col("event_type").alias("raw_classification"), F.col("event_id").alias("sample_id"))
    )


@query(
    "a10_label_set_counts",
    with_views(f"SELECT array_to_string({_LIST}, ',') AS label_set, count(*) AS n FROM samples GROUP BY 1", "samples"),
)
def label_sets(spark, sf_dir):
    return prep.label_set_counts(views.samples(spark, sf_dir))


@query(
    "u4_union_splits",
    with_views(f"SELECT sample_id, split, {LABEL_LIST} FROM samples", "samples"),
)
def union_splits(spark, sf_dir):
    rows = views.samples(spark, sf_dir).select("sample_id", "split", *LABELS)
    return prep.union_splits(*[rows.where(F.col("split") == s) for s in ("train", "val", "test")])


@query(
    "w5_sample_subset",
    with_views(
        "SELECT sample_id, split FROM (SELECT * FROM samples ORDER BY sha1('42:' || sample_id), sample_id LIMIT 128) ORDER BY sample_id",
        "samples",
    ),
)
def sample_subset(spark, sf_dir):
    return prep.sample_subset(views.samples(spark, sf_dir), 128).select("sample_id", "split")


@query("w6_limit_head", with_views("SELECT sample_id, split, raw_classification FROM samples ORDER BY sample_id LIMIT 100", "samples"))
def limit_head(spark, sf_dir):
    return prep.limit_head(views.samples(spark, sf_dir), 100).select("sample_id", "split", "raw_classification")


@query(
    "prepare_samples",
    with_views(f"SELECT sample_id, split, text, raw_classification, project, {LABEL_LIST} FROM samples", "samples"),
)
def prepare(spark, sf_dir):
    return views.samples(spark, sf_dir).select("sample_id", "split", "text", "raw_classification", "project", *LABELS)


@query(
    "k1_write_observed_dataset",
    with_views(
        "SELECT counter, value::BIGINT AS value FROM (" + ORACLES["a1_prep_summary"].split("\n")[-1] + ") UNPIVOT (value FOR counter IN "
        "(processed_rows, kept_rows, skipped_no_label, skipped_empty_text)) "
        "UNION ALL SELECT split, count(*) FROM samples GROUP BY split UNION ALL SELECT split || ' ' || label, sum(y)::BIGINT FROM long_labels GROUP BY split, label",
        "samples", "labelled", "long_labels",
    ),
)
def write_observed_dataset(spark, sf_dir):
    """Counters of the pass that writes the dataset."""
    found = writers.write_observed_dataset(views.raw_samples(spark, sf_dir), scratch_path(spark, "clean"))
    return spark.createDataFrame(sorted(found.items()), "counter string, value long")
