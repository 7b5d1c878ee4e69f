import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.llm import collocations

SCHEMA = "text string, lang string, score double, words string"


def brute(rows, least, longest=4, limit=2000):
    """The contract, phrase by phrase."""
    total, count = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                count.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    known = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, words), a in known.items():
        longer = [
            b for (other, more), b in known.items()
            if other == lang and len(more) > len(words) and any(more[i : i + len(words)] == words for i in range(len(more)))
        ]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (count[lang, words[:k]] + count[lang, words[k:]]), k, count[lang, words[:k]], count[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, total[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:limit]
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(mine)]
    return sorted(ranked)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(t, g, 1.0, "x") for t, g in rows], SCHEMA)
    return sorted(tuple(r) for r in collocations.mine(frame, **options).collect())


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    words = ["The", "of", "house", "é", "日本", "a\x01b", "GARDEN", "x-y", "d'un", "ÉT"]
    weights = [9, 7, 5, 4, 3, 3, 2, 2, 1, 1]
    rows = []
    for i in range(90):
        chosen = rng.choices(words, weights, k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "\x0b"]) for w in chosen)
        rows.append((text, rng.choice(["en", "en", "fr", None])))
    return rows + rows[:9] + [(None, "en"), ("", None), (" .. ", "de"), ("of the house " * 4000, "en"), (None, None)]


@pytest.mark.parametrize("least", [2, 3, 30, 300])
def test_brute_force(spark, prose, least):
    assert mined(spark, prose, least=least) == brute(prose, least)


def test_small_runs_ranges_and_groups(spark, prose, monkeypatch):
    """Many runs, an order cut into many ranges and salted ranking give the same rows."""
    monkeypatch.setattr(collocations, "ROWS_PER_TASK", 7)
    monkeypatch.setattr(collocations, "RUN_BYTES", 500)
    assert mined(spark, prose, least=3, limit=3) == brute(prose, 3, limit=3)


def test_other_lengths(spark, prose):
    for longest in (2, 3, 5):
        assert mined(spark, prose, least=4, longest=longest) == brute(prose, 4, longest)


def test_scan_crosses_ranges(spark):
    """Counts of beginnings, and extensions, reach over the borders of the sorted ranges."""
    rows = [(("lang"), w, n) for w, n in ((["a"], 90), (["a", "b"], 50), (["a", "b", "c"], 45), (["a", "b", "d"], 3), (["a", "e"], 7), (["f"], 2))]
    counts = spark.createDataFrame(rows, "lang string, words array<string>, n long")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        found = collocations._in_order(counts, 6, "order").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    parts = {tuple(r["words"]): r["parts"] for r in found if r["own"]}
    assert parts == {("a",): [], ("a", "b"): [90], ("a", "b", "c"): [90, 50], ("a", "b", "d"): [90, 50], ("a", "e"): [90], ("f",): []}
    best = {}
    for r in found:
        best[tuple(r["words"])] = max(best.get(tuple(r["words"]), 0), r["extension"])
    assert best == {("a",): 50, ("a", "b"): 45, ("a", "b", "c"): 0, ("a", "b", "d"): 0, ("a", "e"): 0, ("f",): 0}


def test_products_over_64_bits(spark):
    frame = spark.createDataFrame([(4 * 10**15, 5 * 10**15)], "a long, l long")
    value = frame.select(F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(10,0))) div (l + l)").alias("s")).first()["s"]
    assert value == 2_000_000 * 4 * 10**15 // 10**16


def test_empty_tables(spark, no_docs, edge_docs):
    assert collocations.mine(no_docs).collect() == []
    rows = [(r["text"], r["lang"]) for r in edge_docs.collect()]
    assert sorted(tuple(r) for r in collocations.mine(edge_docs, least=3).collect()) == brute(rows, 3)
