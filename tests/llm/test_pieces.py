from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import pieces
from tagloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def small():
    return pieces.Vocabulary(("▁", "a", "b", "ab", "▁a", "aa", "▁ab"), (300, 301, 302, 303, 304, 305, 306), tuple(range(256)), 307)


def ways(text, weights):
    """All segmentations with their weights."""
    if not text:
        return {(): 1.0}
    out = {}
    for n in range(1, len(text) + 1):
        if text[:n] in weights:
            i, w = weights[text[:n]]
            for rest, v in ways(text[n:], weights).items():
                out[(i, *rest)] = w * v
    return out


@pytest.mark.parametrize("sharpness", [0.0, 1.0, 3.0])
def test_draws_follow_the_weights_of_all_segmentations(sharpness):
    vocabulary = small()
    weights = {p: (i, float(np.exp(vocabulary.log_weights(sharpness)[i]))) for p, i in zip(vocabulary.pieces, vocabulary.ids)}
    text, n = " aabab", 20000
    lists = pieces.segment([text] * n, np.arange(n), vocabulary, pieces.Lattices(vocabulary, sharpness))
    seen = Counter(map(tuple, lists.to_pylist()))
    expected = ways(text.replace(" ", "▁"), weights)
    total = sum(expected.values())
    assert set(seen) <= set(expected)
    for way, weight in expected.items():
        share = weight / total
        assert abs(seen[way] / n - share) < 5 * np.sqrt(share * (1 - share) / n) + 1e-9


def test_lossless_and_reproducible(spark, edge_docs, no_docs, vocabulary):
    odd = ["▁ ▁▁", "\x00\x07", "", "  two  spaces ", "\r\n\t", "日本語 \U0001f600́é", "x" * 30000, "ab " * 9000, "<0x41> <s> </s> <unk>"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = edge_docs.unionByName(extra, allowMissingColumns=True)
    first = pieces.encode(docs, vocabulary)
    assert first.columns == [*docs.columns, "pieces"]
    back = first.select("doc_id", "text", "pieces", pieces.decoder(spark, vocabulary)(F.col("pieces")).alias("back")).collect()
    assert len(back) == docs.count() and all(r["text"] == r["back"] for r in back)
    assert all((r["pieces"] is None) == (r["text"] is None) for r in back)
    again = pieces.encode(docs.repartition(5, "text").sortWithinPartitions(F.desc("text")), vocabulary).select("doc_id", "pieces").collect()
    assert sorted(((r["doc_id"], r["pieces"]) for r in back), key=repr) == sorted(((r["doc_id"], r["pieces"]) for r in again), key=repr)
    other = {r["doc_id"]: r["pieces"] for r in pieces.encode(docs, vocabulary, seed=7).select("doc_id", "pieces").collect()}
    assert any(r["pieces"] != other[r["doc_id"]] for r in back)
    assert pieces.encode(no_docs, vocabulary).count() == 0


def test_units_are_independent(vocabulary):
    texts = ["The house, and 12 more... (see ab.cd)", "naïve-café_x ²."]
    lattices = pieces.Lattices(vocabulary, 1.0)
    for text in texts:
        units = vocabulary.unit.findall(vocabulary.symbols(text))
        assert "".join(units) == vocabulary.symbols(text)
        joints = {a[-1] + b[0] for a, b in zip(units, units[1:])}
        assert not any(j in p for j in joints for p in vocabulary.pieces)
    assert len(lattices.sample([], np.zeros(0, np.uint64))[0]) == 0


def test_tables_may_be_cleared(monkeypatch, vocabulary):
    texts = [f"word{i} thing{i} again" for i in range(50)]
    want = pieces.segment(texts, np.arange(50), vocabulary, pieces.Lattices(vocabulary, 1.0)).to_pylist()
    monkeypatch.setattr(pieces, "ARCS_KEPT", 10)
    lattices = pieces.Lattices(vocabulary, 1.0)
    got = [pieces.segment([t], np.array([i]), vocabulary, lattices).to_pylist()[0] for i, t in enumerate(texts)]
    assert got == want


def test_query(spark, sf_dir):
    rows = QUERIES["op9_sentencepiece"](spark, sf_dir)
    assert rows.where("lossless").count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_taken_names(spark):
    frame = spark.createDataFrame([(1, "a word", "mine", "too")], "doc_id long, text string, pieces string, Lossless string")
    got = pieces.encode(frame, pieces.load(), lossless_col="lossless")
    assert got.columns == ["doc_id", "text", "pieces", "Lossless", "_pieces", "_lossless"]
    assert got.first()["pieces"] == "mine" and got.first()["_lossless"] is True and got.write.format("noop").mode("overwrite").save() is None
