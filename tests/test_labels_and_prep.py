import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tagloom.constants import LABELS
from tagloom.functions.labels import ALIASES, assign_split, label_columns, label_mask
from tagloom.operators import prep
from tagloom.sources import writers
from tagloom.sources.readers import scan_predictions, scan_raw_csv
from tagloom.staging import lookup_join, may_match, number_rows, number_within, stage_sized, top_n


def spec_labels(raw):
    text = " ".join((raw or "").split())
    if text.lower() in ("", "nan", "none", "null", "n/a"):
        return set()
    rest, found = text.lower(), set()
    for label, aliases in ALIASES:
        for alias in aliases:
            if alias.lower() in rest:
                found.add(label)
                rest = rest.replace(alias.lower(), " ")
    for mark in "+/.,;:_-":
        rest = rest.replace(mark, " ")
    if [w for w in rest.split() if w not in ("nan", "none", "null", "n/a")]:
        found.add("other")
    return found


def test_labels(spark):
    rng = random.Random(3)
    words = [a for _, aliases in ALIASES for a in aliases] + ["NaN", "n/a", "none", "XSS", "Code", "Exec", "+", ".", "Mem", "Corr"]
    rows = [
        "Overflow, DoS; Exec Code", "SQL Inj.", "nan", "", None, "N/A", "n/a y", "MemOverflowCorr", "bypass \t dos",
    ]
    rows += [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(1500)]
    frame = spark.createDataFrame([(r,) for r in rows], "raw string").withColumn("m", label_mask("raw"))
    for row in frame.select("raw", *label_columns("m")).collect():
        assert {l for l in LABELS if row[l]} == spec_labels(row.raw), row.raw


def test_split_is_stable_and_near_80_10_10(spark):
    rows = spark.range(5000).select("id", assign_split("id").alias("s")).collect()
    for row in rows[:300]:
        bucket = int(hashlib.sha1(f"42:{row.id}".encode()).hexdigest()[:8], 16) % 10
        assert row.s == ("train" if bucket < 8 else "val" if bucket == 8 else "test")
    assert abs(sum(r.s == "train" for r in rows) / 5000 - 0.8) < 0.03


RAW = [
    (0, "int a;", "DoS"), (1, " \r\n", "Overflow"), (2, "x", "NaN"), (3, "y\r\nz", "XSS +Info"), (4, "w", ""),
]


def test_prepare_and_summary(spark):
    raw = spark.createDataFrame(RAW, "sample_id long, text string, raw_classification string")
    clean = {r.sample_id: r for r in prep.prepare(raw).collect()}
    assert set(clean) == {0, 3} and clean[3].text == "y\nz" and clean[3].other == 1 and clean[3].info == 1
    assert prep.prep_summary(raw).first().asDict() == {
        "processed_rows": 5, "kept_rows": 2, "skipped_no_label": 2, "skipped_empty_text": 1,
    }
    view = prep.legacy_view(prep.prepare(raw)).orderBy("index").collect()
    assert [(r["index"], r.labels, r.cpg) for r in view] == [(0, "dos", ""), (0, "info,other", "")] or len({r.split for r in view}) == 1


def test_raw_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        b"Vulnerability Classification,func_before,CVE ID,CWE ID,project,commit_id,vul\n"
        b'DoS,"line ""one""\nline two, end\xff",CVE-1,,p,c1,1\n,plain,,,q,,0\n'
    )
    rows = scan_raw_csv(spark, str(tmp_path)).orderBy("sample_id").collect()
    assert [(r.sample_id, r.raw_classification, r.project) for r in rows] == [(0, "DoS", "p"), (1, "", "q")]
    assert rows[0].text == 'line "one"\nline two, end�'
    assert scan_raw_csv(spark, str(tmp_path), max_rows=1).count() == 1


def test_raw_csv_finds_columns_by_name(spark, tmp_path):
    head = b"id,CVE ID,project,func_before,Vulnerability Classification,more,CWE ID,commit_id,vul\n"
    (tmp_path / "a.csv").write_bytes(head + b'17,CVE-9,p1,"f()\n{}",DoS,z,CWE-1,c1,1\n18,,p2,g,,,,,\n')
    (tmp_path / "b.csv").write_bytes(head + b"19,,p3,h,Overflow,,,,0\n")
    rows = scan_raw_csv(spark, str(tmp_path)).orderBy("sample_id").collect()
    assert [(r.sample_id, r.raw_classification, r.cve_id, r.project, r.text, r.vul) for r in rows] == [
        (0, "DoS", "CVE-9", "p1", "f()\n{}", "1"), (1, "", "", "p2", "g", ""), (2, "Overflow", "", "p3", "h", "0"),
    ]
    assert [r.sample_id for r in scan_raw_csv(spark, str(tmp_path), max_rows=2).collect()] == [0, 1]
    (tmp_path / "b.csv").write_bytes(b"id,project\n1,p\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        scan_raw_csv(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="func_before"):
        scan_raw_csv(spark, str(tmp_path / "b.csv"))


def test_tables_without_a_key(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",".join(reversed(LABELS)) + "\n" + ",".join(f"0.{i}" for i in range(8)) + "\n" + ",".join(["0.5"] * 8) + "\n")
    rows = scan_predictions(spark, str(tmp_path), key=None).orderBy("position").collect()
    assert [r.position for r in rows] == [0, 1] and [rows[0][l] for l in reversed(LABELS)] == [i / 10 for i in range(8)]
    with pytest.raises(ValueError, match="sample_id"):
        scan_predictions(spark, str(tmp_path))


def test_numbering_and_top_n(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 7).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 10).alias("k"))
    numbered = number_rows(rows, [F.desc("k"), F.col("id")], "n", start=0).collect()
    expected = sorted(((-(i % 10), i) for i in range(1000)))
    assert {r.id: r.n for r in numbered} == {i: n for n, (_, i) in enumerate(expected)}
    within = number_within(rows, ["g"], ["id"], "n").collect()
    assert all(r.n == r.id // 3 + 1 for r in within)
    top = top_n(rows, 137, -F.col("k"), [F.desc("k"), F.col("id")]).collect()
    assert [r.id for r in top] == [i for _, i in expected[:137]]
    assert top_n(rows, 5000, -F.col("k"), ["id"]).count() == 1000
    monkeypatch.setattr("tagloom.staging.TOP_IN_ONE_TASK", 10)
    assert {r.id for r in top_n(rows, 137, -F.col("k"), [F.desc("k"), F.col("id")]).collect()} == {i for _, i in expected[:137]}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_are_joined_like_others(spark, how):
    """Over the limit, with one key that holds half of the rows and one that the looked-up side lacks."""
    big = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"))
    small = stage_sized(spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")))
    want = sorted(map(tuple, big.join(small.df, "k", how).collect()), key=repr)
    for hot_rows in (1 << 30, 500, 7):
        for selective in (False, True):
            got = lookup_join(big, small, "k", spread=["id"], how=how, limit=0, hot_rows=hot_rows, selective=selective)
            assert sorted(map(tuple, got.collect()), key=repr) == want


def test_rows_without_a_match_go_before_the_shuffle(spark):
    big = spark.range(50_000).select("id", F.concat(F.lit("w"), F.col("id") % 10_000).alias("k"), (F.col("id") % 2).alias("p"))
    big = big.union(spark.range(5).select("id", F.lit(None).cast("string"), F.lit(0).cast("long")))
    small = stage_sized(spark.range(0, 300, 2).select(F.concat(F.lit("w"), F.col("id")).alias("k"), F.lit(0).cast("long").alias("p")))
    matches = big.join(small.df, ["k", "p"]).count()
    left = may_match(big, small, ["k", "p"])
    assert left.columns == big.columns and left.join(small.df, ["k", "p"]).count() == matches == 750
    assert left.count() < 1.3 * matches
    assert may_match(big, small, ["k", "p"], words=4).count() == big.count(), "too full a filter is not used"
    other = stage_sized(small.df.select("k", F.col("p").cast("int").alias("p")))
    assert may_match(big, other, ["k", "p"]).count() == big.count(), "keys of other types hash otherwise"
    assert may_match(big, stage_sized(small.df.limit(0)), ["k", "p"]).count() == 0


@pytest.mark.parametrize("n", [None, 0, 17, 5000])
def test_sample_subset(spark, n):
    rows = spark.range(300).withColumnRenamed("id", "sample_id")
    got = [r.sample_id for r in prep.sample_subset(rows, n).collect()]
    assert len(set(got)) == (17 if n == 17 else 300) and got == sorted(got)


def test_counters_of_the_writing_pass(spark, tmp_path):
    rows = [(1, "DoS", "int a"), (2, "", "int b"), (3, "NaN", " "), (4, "+Info", " \n"), (5, "Overflow DoS", "x")]
    raw = spark.createDataFrame(rows, "sample_id long, raw_classification string, text string")
    found = writers.write_observed_dataset(raw, str(tmp_path / "clean"))
    assert {k: found[k] for k in ("processed_rows", "kept_rows", "skipped_no_label", "skipped_empty_text")} == prep.prep_summary(raw).first().asDict()
    assert found["processed_rows"] == 5 and found["kept_rows"] == spark.read.parquet(str(tmp_path / "clean")).count() == 2
    assert sum(found[s] for s in ("train", "val", "test")) == 2 and sum(found[f"{s} dos"] for s in ("train", "val", "test")) == 2
