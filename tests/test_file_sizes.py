"""Files that one task writes or reads stay bounded; rows and numbers do not change."""

from pathlib import Path

from pyspark.sql import functions as F

from tagloom.catalog import QUERIES, scans
from tagloom.operators.prep import legacy_view
from tagloom.sources import readers, views, writers


def test_single_csv_is_cut_where_it_is_large(spark, sf_dir, monkeypatch):
    paths = []
    monkeypatch.setattr(scans, "scratch_path", lambda s, name, f=scans.scratch_path: paths.append(f(s, name)) or paths[-1])
    name = "s1_scan_raw_csv_single_file"
    whole = sorted(QUERIES[name](spark, sf_dir).collect())
    monkeypatch.setattr(scans, "FILE_BYTES", 100_000)
    assert sorted(QUERIES[name](spark, sf_dir).collect()) == whole
    one, many = (sorted(Path(p.removeprefix("file:")).glob("part-*")) for p in paths[:2])
    assert len(one) == 1 < len(many)
    assert max(f.stat().st_size for f in many) < one[0].stat().st_size / 2


def test_legacy_files_are_bounded(spark, sf_dir, tmp_path):
    view = legacy_view(views.samples(spark, sf_dir)).coalesce(1).localCheckpoint()
    paths = writers.write_legacy_views(view, str(tmp_path), file_bytes=200_000)
    assert set(paths) == {"csv", "hash"}
    for kind, sep in writers.LEGACY_SEPARATORS.items():
        assert len(list(Path(paths[kind]).glob("part-*"))) > 3
        rows = readers.scan_delimited_legacy(spark, paths[kind], view.drop("tags").schema, sep)
        assert sorted(r[0] for r in rows.select(F.md5("text")).collect()) == sorted(r[0] for r in view.select(F.md5("text")).collect())
    assert set(writers.write_legacy_views(view, str(tmp_path / "one"), ("hash",))) == {"hash"}


def _bytes(path):
    return sum(f.stat().st_size for f in Path(path.removeprefix("file:")).glob("part-*"))


def test_legacy_files_hold_a_text_once(spark, sf_dir, tmp_path):
    view = legacy_view(views.samples(spark, sf_dir)).localCheckpoint()
    text = view.agg(F.sum(F.octet_length("text"))).first()[0]
    paths = writers.write_legacy_views(view, str(tmp_path))
    assert all(_bytes(p) < text for p in paths.values())
    rows = readers.scan_delimited_legacy(spark, paths["csv"], view.drop("tags").schema, ",")
    assert sorted(rows.select("index", "text", "code").collect()) == sorted(view.select("index", "text", "code").collect())


def test_dump_is_small_and_cut(spark, sf_dir, monkeypatch):
    paths = []
    monkeypatch.setattr(scans, "scratch_path", lambda s, name, f=scans.scratch_path: paths.append(f(s, name)) or paths[-1])
    whole = sorted(QUERIES["s4_scan_node_dump"](spark, sf_dir).collect())
    monkeypatch.setattr(scans, "DUMP_LINES", 1000)
    assert sorted(QUERIES["s4_scan_node_dump"](spark, sf_dir).collect()) == whole
    lines = spark.read.text(paths[0])
    assert _bytes(paths[0]) < lines.agg(F.sum(F.octet_length("value"))).first()[0] / 4
    assert all(spark.read.text(str(f)).count() <= 1000 for f in list(Path(paths[1].removeprefix("file:")).glob("part-*"))[:3])
