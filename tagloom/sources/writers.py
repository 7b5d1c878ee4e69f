"""Sinks.  All write in parallel; none goes through the driver."""

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.text import dotted_extension, ensure_c_source, safe_project_name
from ..operators.prep import label_by_split, label_totals, prep_summary, prepare, split_sizes, top_raw_classifications


# values are written as they are: quoted, untrimmed, quotes doubled
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "quoteAll": True,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_split_dataset(clean, path, fmt="parquet"):
    """The clean table, one folder per split, gzip-compressed.

    Tasks write their own rows of each split, so that the large train split is
    not pulled into one task.
    """
    writer = clean.write.mode("overwrite").partitionBy("split").option("compression", "gzip")
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.parquet(path)
    return path


def write_observed_dataset(raw, path, seed=42, fmt="parquet", splits=("train", "val", "test")):
    """The clean dataset, with the counters of the same pass over the raw rows.

    Returns a map of the four counters of ``prep_summary``, the size of each split
    and, as ``split label``, its positives.  The counters are metrics of the
    written plan, so nothing is read twice; a task that is run again after its
    result was counted may be counted again.
    """
    seen = {}

    def observe(rows, step):
        seen[step] = Observation(f"{step} {uuid.uuid4().hex}")
        counters = [F.count(F.lit(1)).alias("n")]
        if step == "kept":
            counters += [F.count_if(F.col("split") == s).alias(s) for s in splits]
            counters += [F.count_if((F.col("split") == s) & (F.col(l) == 1)).alias(f"{s} {l}") for s in splits for l in LABELS]
        return rows.observe(seen[step], *counters)

    write_split_dataset(prepare(raw, seed, observe), path, fmt)
    found = {step: observation.get for step, observation in seen.items()}
    rows = {step: counters["n"] for step, counters in found.items()}
    return {
        "processed_rows": rows["processed"], "kept_rows": rows["kept"], "skipped_no_label": rows["processed"] - rows["labelled"],
        "skipped_empty_text": rows["labelled"] - rows["kept"], **{k: v for k, v in found["kept"].items() if k != "n"},
    }


LEGACY_SEPARATORS = {"csv": ",", "hash": "#"}
LEGACY_FILE_BYTES = 1 << 28


def write_legacy_views(view, path, kinds=tuple(LEGACY_SEPARATORS), file_bytes=LEGACY_FILE_BYTES):
    """Comma- and hash-separated copies of a legacy view, gzip-compressed as the clean table is: a record holds its text four times.

    A quoted file is read by one task, so a file gets as many records as make
    about ``file_bytes`` of text at their mean size.
    """
    flat = view.drop("tags")
    letters = sum((F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in flat.schema if f.dataType.typeName() == "string"), F.lit(1).cast("long"))
    size = flat.agg(F.avg(letters)).first()[0] or 1
    paths = {}
    for name in kinds:
        paths[name] = f"{path}/{name}"
        writer = flat.write.mode("overwrite").options(**CSV_OPTIONS).option("sep", LEGACY_SEPARATORS[name]).option("compression", "gzip")
        writer.option("maxRecordsPerFile", max(1, int(file_bytes / size))).csv(paths[name])
    return paths


def counts_map(counts, key, value):
    """A small (key, value) table as one sorted map."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return counts.agg(F.map_from_entries(entries).alias("m")).scalar()


def json_lines(record):
    return record.select(F.to_json(F.struct(*sorted(record.columns))).alias("value"))


def write_summary_json(record, path):
    """One-row record as JSON, keys sorted."""
    json_lines(record).write.mode("overwrite").text(path)
    return path


def write_prep_summary(raw, clean, path, seed=42, top=25):
    """Counters of a preparation as one JSON object: rows, splits, labels, the most frequent category strings.

    Each part has as many entries as there are splits, labels or ``top`` strings.
    """
    by_split = label_by_split(clean).groupBy("split").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("n"))
    nested = F.transform(F.array_sort(F.collect_list(F.struct("split", "n"))), lambda e: F.struct(e["split"], F.map_from_entries(e["n"])))
    ranked = top_raw_classifications(clean, top, ranked=True)
    record = prep_summary(raw).withColumns(
        {
            "seed": F.lit(seed),
            "split_sizes": counts_map(split_sizes(clean), "split", "n"),
            "label_totals": counts_map(label_totals(clean), "label", "n"),
            "label_by_split": by_split.agg(F.map_from_entries(nested)).scalar(),
            "top_raw_classifications": ranked.agg(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", "raw_classification", "n"))), lambda e: e.dropFields("rank"))
            ).scalar(),
        }
    )
    return write_summary_json(record, path)


def write_label_table(rows, path, prefix="", labels=LABELS):
    """One column per label and no key, in the order of the rows: raw scores or true labels of older consumers."""
    rows.select(*[F.col(f"{prefix}{l}").alias(l) for l in labels]).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def write_rule_table(rules, path):
    """A rule table as JSON lines sorted by label, field, polarity and token; sorting is spread over tasks."""
    json_lines(rules.orderBy("label", "field", "polarity", "token")).write.mode("overwrite").text(path)
    return path


def write_report_json(report, path):
    """A classification report as one JSON object: name → precision, recall, f1 and support."""
    values = [c for c in report.columns if c != "name"]
    entries = F.array_sort(F.collect_list(F.struct("name", F.struct(*sorted(values)).alias("v"))))
    report.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.mode("overwrite").text(path)
    return path


def write_predictions(predictions, path, fmt="parquet"):
    writer = predictions.write.mode("overwrite")
    writer.parquet(path) if fmt == "parquet" else writer.options(**CSV_OPTIONS).csv(path)
    return path


def source_bodies(samples, root="sources", extension=".cpp"):
    """Manifest with source text: the table behind one-file-per-row exports."""
    path = F.concat_ws(
        "/", F.lit(root), safe_project_name("project"),
        F.concat(F.col("sample_id").cast("string"), dotted_extension(F.lit(extension))),
    )
    return samples.select(
        "sample_id", "project", path.alias("source_path"), "raw_classification",
        ensure_c_source("text").alias("body"),
    )


def write_source_bodies(samples, path, root="sources", extension=".cpp"):
    source_bodies(samples, root, extension).write.mode("overwrite").parquet(path)
    return path


def predictions_table(scored, labels=LABELS):
    """Columns of a prediction table in their published order."""
    kept = ["sample_id", "raw_classification"]
    for label in labels:
        kept += [c for c in (f"score_{label}", f"pred_{label}", f"true_{label}") if c in scored.columns]
    return scored.select(*kept)
