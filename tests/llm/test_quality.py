import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import quality
from tagloom.llm.queries import QUERIES


def slow(text):
    """The features of one text, one by one."""
    raw = text.encode()
    chars = len(text)
    blank = [c in " \t\n\x0b\x0c\r" for c in text]
    words, now = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            words, now = (words + [now] if now else words), ""
        else:
            now += c
    words += [now] if now else []
    letters = sum(c.isascii() and c.isalpha() or not c.isascii() for c in text)
    symbol = lambda c: c.isascii() and 32 < ord(c) < 127 and not c.isalnum() and c not in ".,;:!?"
    share = lambda a, b: a / b if b else 0.0
    n = len(words)
    return [
        np.log2(1 + chars), np.log2(1 + n), share(chars - sum(blank), n), share(sum("A" <= c <= "Z" for c in text), letters),
        share(sum("0" <= c <= "9" for c in text), chars), share(sum(map(symbol, text)), chars), share(sum(c in "!?" for c in text), chars),
        share(sum(c in ".,;:" for c in text), chars), share(sum(symbol(w[-1]) or w[-1] in "!?" for w in words), n),
        share(sum("A" <= w[0] <= "Z" for w in words), n), share(sum(a == b for a, b in zip(words, words[1:])), n), share(len(set(words)), n),
        share(max((words.count(w) for w in words), default=0), n), n / (text.count("\n") + 1),
        np.log2(1 + max((len(w.encode()) for w in words), default=0)), share(sum(a == b for a, b in zip(raw, raw[1:])), chars),
    ]


TEXTS = ["", "a", " \n ", "Hello, world! world! 12", "É!! $$$ the the the", "日本 x\ny\n\n", "A" * 50, "w\x0bv\x0c-\r.", "end. End. end."]


@pytest.mark.parametrize("size", [quality.TEXT_BYTES, 1, 20])
def test_features(monkeypatch, size):
    monkeypatch.setattr(quality, "TEXT_BYTES", size)
    column = pa.array([t.encode() for t in ["skipped"] + TEXTS + ["x " * 500]], pa.binary()).slice(1)
    assert np.allclose(quality.measured(column), [slow(t) for t in TEXTS + ["x " * 500]])
    assert quality.measured(column.slice(0, 0)).shape == (0, len(quality.FEATURES))


def test_trees_are_the_best_cuts():
    rng = np.random.default_rng(4)
    g, h = rng.normal(size=9), rng.random(9) + 0.1
    gain = lambda a, b: a.sum() ** 2 / (b.sum() + quality.SHRINK)
    at = max(range(1, 9), key=lambda c: gain(g[:c], h[:c]) + gain(g[c:], h[c:]))
    stump = quality.tree(g, h, 1)
    assert len(set(stump[:at])) == 1 and len(set(stump[at:])) == 1
    assert np.isclose(stump[0], g[:at].sum() / (h[:at].sum() + quality.SHRINK))
    assert len(set(quality.tree(g, h))) <= 4
    square = np.zeros((4, 4))
    square[:2, :2] = square[2:, 2:] = 1.0
    square[:2, 2:] = square[2:, :2] = -1.0
    values, won = quality.pair_tree(square * 10, np.ones((4, 4)))
    assert won > 0 and (np.sign(values) == np.sign(square)).all()


def test_a_pair_is_learned():
    """An exclusive or has no single-feature effect; only a pair table explains it."""
    rng = np.random.default_rng(5)
    values = rng.random((3000, 3))
    truth = ((values[:, 0] > 0.5) ^ (values[:, 1] > 0.5)).astype(float)
    cuts = [np.linspace(0, 1, 17)[1:-1]] * 3
    weights = np.ones(3000)
    gains = quality.boost(values, truth, weights, cuts, cuts, [], 20, 0.2)[3]
    assert max(gains, key=gains.get) == (0, 1)
    base, tables, pair_tables, _ = quality.boost(values, truth, weights, cuts, cuts, [(0, 1)], 20, 0.2)
    model = quality.Model(base, cuts, tables, cuts, [(0, 1)], pair_tables)
    assert ((model.score(values) > 0) == truth).mean() > 0.98
    by_hand = [
        base + sum(t[np.searchsorted(c, x, side="right")] for t, c, x in zip(tables, cuts, row))
        + pair_tables[0][np.searchsorted(cuts[0], row[0], side="right"), np.searchsorted(cuts[1], row[1], side="right")] for row in values[:50]
    ]
    assert np.allclose(model.score(values[:50]), by_hand)


def test_edge_tables(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20, 50)] + [(None, 1), (5, None), (6, 7), (9, 1), (9, 0), (0, 1), (0, 1)], "doc_id long, quality int")
    model = quality.fit(edge_docs, labels, rounds=5, bags=2)
    rows = quality.rated(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r["id"], r["score"]) == r["score"] or r["id"] is None
    assert by_id[3] == by_id[4]  # null and empty
    again = quality.fit(edge_docs, labels, rounds=5, bags=2)
    assert np.isclose(again.base, model.base) and all(np.allclose(a, b) for a, b in zip(again.tables, model.tables))
    nothing = quality.fit(edge_docs, labels.limit(0))
    assert {r["score"] for r in quality.rated(edge_docs, nothing).collect()} == {0.5}
    single = quality.fit(edge_docs, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int"), rounds=3, bags=2)
    assert all(r["score"] > 0.5 for r in quality.rated(edge_docs, single).collect())
    assert quality.rated(no_docs, model).count() == 0 and quality.fit(no_docs, labels).base == 0.0


def test_the_sample_is_bounded(spark, monkeypatch):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i % 900, " ".join(rng.choice("abcdef") for _ in range(9))) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, quality int")
    sizes = []
    real = quality.stage
    monkeypatch.setattr(quality, "stage", lambda df, name: sizes.append((name, real(df, name))) or sizes[-1][1])
    quality.fit(docs, labels, fit_rows=100, rounds=2, bags=1)
    assert dict(sizes)["sample"].count() < 160


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op11_quality_classifier"](spark, sf_dir).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert {r["doc_id"]: r["held_out"] for r in rows} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
