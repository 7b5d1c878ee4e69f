"""Registered queries against their SQL on the smallest tables.

All queries are compared at any scale by ``python tests/compare.py <sf_dir>``.
"""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from tagloom.catalog import ORACLES, QUERIES, models
from tagloom.operators import vectors

@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert compare(got, duck(sf_dir).execute(ORACLES[name]).df()) is None


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["metric", "before", "after", "gain"] and frame.count() == 23
    assert set(entry.oracle_sql()) < set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    # iterative fits of word vectors; their counts, their vocabulary and the classifier on given vectors have SQL
    assert set(QUERIES) - set(ORACLES) == {"f7_word2vec_fit", "f7_pmi_vectors", "m7_train_doc_classifier"}


def test_word_vectors_at_the_defaults(spark, sf_dir, monkeypatch):
    fits = []
    real = vectors.word2vec_fit
    monkeypatch.setattr(vectors, "word2vec_fit", lambda rows, **given: fits.append((given, real(rows, **given))) or fits[-1][1])
    for name in ("f7_word2vec_fit", "m7_train_doc_classifier"):
        QUERIES[name](spark, sf_dir).count()
        given, model = fits.pop()
        assert not given and model.getVectorSize() == 100 and model.getMinCount() == 1 and model.getMaxIter() == 10


def test_classifiers_see_every_component(spark, sf_dir):
    for name in ("m3_binary_relevance_gaussian_whole", "m4_classifier_chain_gaussian_whole"):
        assert "embedding[64]" in ORACLES[name]
    rows = models._vector_rows(spark, sf_dir)
    width = duck(sf_dir).execute("SELECT max(len(embedding)) FROM embeddings").fetchone()[0]
    assert {len(r["features"]) for r in rows.select("features").collect()} == {width}
