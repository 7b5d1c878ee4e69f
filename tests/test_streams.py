"""Streams that are stopped, restarted and fed the same rows again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.streaming.prepare import (
    merge_deltas, read_counts, read_stream, read_summary, start_counts, start_summary, stream_counts, stream_prepare, stream_summary,
)
from tagloom.streaming.publish import incremental_publish, not_published

RUNS = "run_id string, sample_id long, score double"
RAW = "sample_id long, raw_classification string, text string"


def land(spark, path, rows, schema=RUNS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def doubled(batch):
    return batch.withColumn("score", F.col("score") * 2)


def published(spark, tmp_path, files=1):
    runs = read_stream(spark, str(tmp_path / "in"), RUNS, files_per_trigger=files)
    rows = incremental_publish(runs, doubled, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    return sorted((r["run_id"] or "", r["sample_id"], r["score"]) for r in rows)


def test_a_run_that_arrives_again_is_published_once(spark, tmp_path):
    first = [("a", 1, 0.5), ("a", 2, 0.25), ("a", 2, 0.25)]
    land(spark, tmp_path / "in", first)
    land(spark, tmp_path / "in", first)
    want = [("a", 1, 1.0), ("a", 2, 0.5)]
    assert published(spark, tmp_path) == want
    # after a restart: the same run with another score, a new row of it, and a new run
    land(spark, tmp_path / "in", [("a", 1, 9.0), ("a", 3, 1.0), ("b", 1, 2.0)])
    want = sorted([*want, ("a", 3, 2.0), ("b", 1, 4.0)])
    assert published(spark, tmp_path) == want
    land(spark, tmp_path / "in", first)
    assert published(spark, tmp_path, files=3) == want
    assert published(spark, tmp_path) == want


def test_nulls_name_rows_too(spark, tmp_path):
    land(spark, tmp_path / "in", [(None, 1, 1.0), ("a", None, 1.0), (None, 1, 1.0)])
    land(spark, tmp_path / "in", [(None, 1, 1.0), ("a", None, 1.0)])
    rows = read_stream(spark, str(tmp_path / "in"), RUNS, files_per_trigger=1)
    got = incremental_publish(rows, doubled, str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted((r["run_id"] or "", r["sample_id"] or 0) for r in got) == [("", 1), ("a", 0)]


def test_a_replayed_batch_keeps_its_rows(spark, tmp_path):
    """What an earlier try of the same batch has written does not make its rows look published."""
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0)], RUNS)
    rows.where("sample_id = 1").withColumn("batch_id", F.lit(0)).write.partitionBy("run_id", "batch_id").parquet(str(tmp_path / "out"))
    again = lambda number: {r["sample_id"] for r in not_published(rows, number, str(tmp_path / "out"), "run_id", "sample_id").collect()}
    assert again(0) == {1, 2} and again(1) == {2}


def test_counters_last(spark, tmp_path):
    labels = ["DoS", "+Info", "Overflow DoS", "", "NaN"]
    rows = [(i, labels[i % 5], "int a" if i % 7 else " ") for i in range(60)]
    paths = {n: str(tmp_path / n) for n in ("in", "counts", "summary", "state", "state2", "merged")}
    for part in range(3):
        land(spark, paths["in"], rows[part::3], RAW)
        stream = read_stream(spark, paths["in"], RAW, files_per_trigger=1)
        start_counts(stream, paths["counts"], paths["state"]).awaitTermination()
        start_summary(stream, paths["summary"], paths["state2"]).awaitTermination()
        summary = read_summary(spark, paths["summary"]).first().asDict()
        assert summary["processed_rows"] == 20 * (part + 1)
    kept = [r for r in rows if r[1] not in ("", "NaN") and r[2].strip()]
    assert summary["kept_rows"] == len(kept) and summary["skipped_no_label"] == 24
    total = Counter()
    for r in read_counts(spark, paths["counts"]).collect():
        total[r["label"]] += r["n"]
    assert total["dos"] == sum("DoS" in r[1] for r in kept) and total["info"] == sum("Info" in r[1] for r in kept)
    # a replayed batch overwrites its own counters, and merged counters are the same
    before = {tuple(r) for r in read_counts(spark, paths["counts"]).collect()}
    merge_deltas(spark, read_counts, paths["counts"], paths["merged"])
    assert {tuple(r) for r in read_counts(spark, paths["merged"]).collect()} == before


@pytest.mark.parametrize("folder", [False, True])
def test_a_named_table_is_a_file_or_a_folder(spark, tmp_path, folder):
    """A table beside others may be one file or hold part files of any name."""
    rows = [(i, "DoS", "int a") for i in range(20)]
    made, table = tmp_path / "made", tmp_path / "tables" / "raw.parquet"
    spark.createDataFrame(rows, RAW).repartition(3 if folder else 1).write.parquet(str(made))
    table.parent.mkdir()
    for part in made.glob("part-*") if not folder else [made]:
        part.rename(table)
    land(spark, table.parent / "other.parquet", [(99, "DoS", "int b")], RAW)
    stream = read_stream(spark, str(table.parent), RAW, "raw.parquet")
    assert stream_summary(stream).first().asDict() == {"processed_rows": 20, "kept_rows": 20, "skipped_no_label": 0, "skipped_empty_text": 0}
    assert sum(r["n"] for r in stream_counts(stream).collect()) == 20
    assert stream_prepare(stream).count() == 20


def test_a_stream_without_rows_has_empty_counters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = read_stream(spark, str(tmp_path / "in"), RAW)
    assert stream_counts(stream).collect() == []
    assert stream_summary(stream).first().asDict() == {"processed_rows": 0, "kept_rows": 0, "skipped_no_label": 0, "skipped_empty_text": 0}
