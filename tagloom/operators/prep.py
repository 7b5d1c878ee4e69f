"""Preparation: labels, cleaning, splits, legacy views, summaries and samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import LABELS, METADATA_COLUMNS
from ..functions.labels import assign_split, label_columns, label_mask, labels_to_list
from ..functions.text import minimal_clean_text, strip
from ..staging import lookup_join, number_within, stage, stage_sized, top_n
from .metrics import stack


def once(rows, name, value):
    """Adds a costly column so that filters on it do not compute it again: they stop at the one-element explode."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def prepare(raw, seed=42, observe=None):
    """Raw rows to clean labelled samples: one narrow stage, no shuffle.

    Rows without a label go before their text is cleaned.  ``observe`` (rows,
    step) may add counters to the rows ``processed``, ``labelled`` and ``kept``.
    """
    seen = observe or (lambda rows, step: rows)
    raw = seen(raw, "processed")
    category = strip(F.coalesce("raw_classification", F.lit("")))
    known = [c for c in METADATA_COLUMNS if c in raw.columns]
    labelled = seen(once(raw, "_mask", label_mask("raw_classification")).where(F.col("_mask") > 0), "labelled")
    kept = (
        once(labelled, "_clean", minimal_clean_text("text"))
        .where(F.col("_clean") != "")
        .select(
            "sample_id", assign_split("sample_id", seed).alias("split"), F.col("_clean").alias("text"),
            category.alias("raw_classification"), *known, *label_columns("_mask"),
        )
    )
    return seen(kept, "kept")


def filter_labeled(raw):
    return once(raw, "mask", label_mask("raw_classification")).where(F.col("mask") > 0)


def filter_nonempty_text(rows):
    cleaned = once(rows, "_clean", minimal_clean_text("text")).where(F.col("_clean") != "")
    return cleaned.withColumn("text", F.col("_clean")).drop("_clean")


def prep_summary(raw):
    """processed, kept, skipped_no_label, skipped_empty_text in one pass."""
    labelled = F.col("_labelled")
    filled = F.col("_filled")
    return raw.select(
        (label_mask("raw_classification") > 0).alias("_labelled"),
        (minimal_clean_text("text") != "").alias("_filled"),
    ).agg(
        F.count(F.lit(1)).alias("processed_rows"),
        F.count_if(labelled & filled).alias("kept_rows"),
        F.count_if(~labelled).alias("skipped_no_label"),
        F.count_if(labelled & ~filled).alias("skipped_empty_text"),
    )


def split_sizes(clean):
    return clean.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _unpivot_counts(counts, keys, labels):
    return counts.selectExpr(*keys, stack(("label", "n"), *[(f"'{l}'", l) for l in labels]))


def label_totals(clean, labels=LABELS):
    """Positives per label; the wide sums are turned into rows after aggregation."""
    sums = clean.agg(*[F.expr(f"coalesce(sum(cast({l} AS bigint)), 0) AS {l}") for l in labels])
    return _unpivot_counts(sums, [], labels)


def label_by_split(clean, labels=LABELS):
    """Positives per split and label; combinations that do not occur are left out."""
    sums = clean.groupBy("split").agg(*[F.expr(f"sum(cast({l} AS bigint)) AS {l}") for l in labels])
    return _unpivot_counts(sums, ["split"], labels).where(F.col("n") > 0)


def label_by_split_rollup(clean, labels=LABELS):
    """As ``label_by_split`` with totals per split and over all."""
    return (
        label_by_split(clean, labels)
        .rollup("split", "label")
        .agg(F.sum("n").alias("n"))
        .select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("label", F.lit("all")).alias("label"), "n")
    )


def top_raw_classifications(clean, n=25, ranked=False):
    """The most frequent category strings; the one seen first wins a tie.  ``ranked`` adds their place."""
    counts = clean.groupBy("raw_classification").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id")
    )
    top = counts.orderBy(F.desc("n"), "first_id").limit(n)
    if ranked:  # a window over the n rows that are left
        return top.select("raw_classification", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first_id")).alias("rank"))
    return top.select("raw_classification", "n")


def label_set_counts(clean, labels=LABELS):
    """How often each exact combination of labels occurs."""
    return (
        clean.select(F.array_join(labels_to_list(labels), ",").alias("label_set"))
        .groupBy("label_set")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def union_splits(*splits):
    whole = splits[0]
    for split in splits[1:]:
        whole = whole.unionByName(split)
    return whole


def legacy_view(clean, numbered=True):
    """Alias columns of older consumers, with tags, joined labels and an empty cell."""
    rows = clean
    if numbered:  # every split is a table of its own and starts at 0
        rows = number_within(clean, ["split"], ["sample_id"], "index").withColumn("index", F.col("index") - 1)
    view = rows.withColumns(
        {
            "processed_func": F.col("text"),
            "func_before": F.col("text"),
            "code": F.col("text"),
            "+info": F.col("info"),
            "+priv": F.col("priv"),
            "mem.": F.col("mem"),
            "exec_code": F.col("exec"),
            "mem_corr": F.col("mem"),
            "tags": labels_to_list(),
        }
    ).withColumn("labels", F.array_join("tags", ","))
    return view if "cpg" in view.columns else view.withColumn("cpg", F.lit(""))


# Columns the training notebooks drop, and the names they restore.
LEGACY_DROPPED = (
    "Unnamed: 0", "Unnamed: 0.1", "CVE Page", "Summary", "Vulnerability Classification", "codeLink",
    "commit_id", "commit_message", "del_lines", "file_name", "vul_func_with_fix", "flaw_line",
    "flaw_line_index", "sql", "r.spl.", "dir.", "trav.", "http", "xss", "corr.", "cpg", "code",
)
LEGACY_RENAMED = {"+info": "info", "+priv": "priv", "mem.": "mem"}


def drop_rename_columns(view, text_column="processed_func", drop=LEGACY_DROPPED, rename=None):
    """Drop what is present of a list and restore label names; missing columns are ignored."""
    renamed = {text_column: "text", **(LEGACY_RENAMED if rename is None else rename)}
    others = {"func_before", "processed_func"} - {text_column}
    taken = set(renamed.values()) & set(view.columns)
    doomed = [c for c in view.columns if c in drop or c in others or c in taken]
    return view.drop(*doomed).withColumnsRenamed(renamed)


def _hash_bucket(digest):
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def sample_subset(rows, n=None, seed=42):
    """Exactly ``n`` rows without replacement, chosen by a hash of seed and (unique) id, sorted by id.

    Only ids and hashes are ranked; the rows are then looked up.
    """
    if not n or n <= 0:
        return rows
    digest = F.sha1(F.concat(F.lit(f"{seed}:"), F.col("sample_id").cast("string")))
    keyed = stage(rows.select("sample_id", digest.alias("_digest")), "digests")
    chosen = stage_sized(top_n(keyed, n, _hash_bucket(F.col("_digest")), ["_digest", "sample_id"]).select("sample_id"), "chosen")
    return lookup_join(rows, chosen, "sample_id", spread=["sample_id"], how="left_semi").orderBy("sample_id")


def limit_head(rows, n=None, order="sample_id"):
    return rows if n is None else rows.orderBy(order).limit(n)
