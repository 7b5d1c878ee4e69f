"""Quoted CSV read in byte ranges, against a reader that goes through a file from its start."""

import csv
import random

import pytest
from pyspark.sql import types as T

from tagloom.sources import readers, records

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "te,xt", "c")])


def write(path, rows, ending="\n", quoting=csv.QUOTE_MINIMAL, header=("id", "te,xt", "c"), start=b"", end=b""):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=ending, quoting=quoting)
        writer.writerow(header)
        writer.writerows(rows)
    body = path.read_bytes()
    path.write_bytes(start + body + end)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(1)
    field = lambda: "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", " ", 'x"y', ""]) for _ in range(rng.randint(0, 12)))
    folder = tmp_path_factory.mktemp("csv")
    rows = lambda k: [(f"{k}-{i}", field(), field()) for i in range(40)]
    write(folder / "a.csv", rows(0), end=b'\n\nlast,"a\nb",c')
    write(folder / "b.csv", rows(1), ending="\r\n", start="﻿".encode())
    write(folder / "c.csv", rows(2), quoting=csv.QUOTE_ALL)
    write(folder / "d.csv", [("long", "\n\n\n" * 900, "x"), ("empty", "", "")])
    write(folder / "e.csv", [])
    return folder


def expected(folder):
    rows = []
    for path in sorted(folder.iterdir()):
        with open(path, newline="", encoding="utf-8-sig") as lines:
            rows += [r for r in csv.reader(lines) if r][1:]
    return [(*r, i) for i, r in enumerate(rows)]


@pytest.mark.parametrize("size", [61, 1000, None])
def test_ranges_of_any_size(spark, folder, size):
    got = readers.scan_raw_csv(spark, str(folder), SCHEMA, {}, range_bytes=size).orderBy("sample_id").collect()
    assert [tuple(r) for r in got] == expected(folder)


def test_a_file_is_read_by_many_tasks(spark, folder):
    found = records.read_records(spark, str(folder / "a.csv"), range_bytes=100)
    assert found.select("_start").distinct().count() > 5


def test_max_rows_opens_only_what_it_needs(spark, folder, monkeypatch):
    want, opened = expected(folder), []
    real = records.read_records
    monkeypatch.setattr(records, "read_records", lambda spark, path, *a: opened.append(len(path)) or real(spark, path, *a))
    for most, files in ((0, [1]), (7, [1]), (41, [1]), (42, [1, 4]), (1000, [1, 4, 5])):
        opened.clear()
        got = readers.scan_raw_csv(spark, str(folder), SCHEMA, {}, max_rows=most).orderBy("sample_id").collect()
        assert [tuple(r) for r in got] == want[:most] and opened == files


def test_broken_files(spark, tmp_path):
    write(tmp_path / "a.csv", [("1", "x", "y")])
    write(tmp_path / "b.csv", [("1", "x", "y")], header=("id", "c", "te,xt"))
    with pytest.raises(ValueError, match="other column names"):
        readers.scan_raw_csv(spark, str(tmp_path), SCHEMA, {})
    with pytest.raises(ValueError, match="no column z"):
        readers.scan_raw_csv(spark, str(tmp_path / "a.csv"), T.StructType([T.StructField("z", T.StringType())]), {})
    (tmp_path / "c.csv").write_bytes(b'id,"te,xt",c\n1,"open,2\n')
    with pytest.raises(ValueError, match="do not pair"):
        readers.scan_raw_csv(spark, str(tmp_path / "c.csv"), SCHEMA, {})
    (tmp_path / "d.csv").write_bytes(b'id,"te,xt",c\n1,"\xff\xfe\nz",3\n')
    got = readers.scan_raw_csv(spark, str(tmp_path / "d.csv"), SCHEMA, {}).collect()
    assert [tuple(r) for r in got] == [("1", "��\nz", "3", 0)]


def test_whole_files(spark, folder):
    """The reader that takes a file in one task finds the same rows; it turns quoted line breaks into those of the file."""
    got = readers.scan_raw_csv(spark, str(folder), SCHEMA, {}, split=False).orderBy("sample_id").collect()
    same = lambda rows: [tuple(str(v).replace("\r\n", "\n") for v in r) for r in rows]
    assert same(got) == same(expected(folder))
    assert readers.scan_raw_csv(spark, str(folder), SCHEMA, {}, numbered=False).columns == ["id", "te,xt", "c"]
