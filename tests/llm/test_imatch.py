import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.llm import imatch, sequence
from tagloom.llm.queries import QUERIES


def by_hand(texts):
    """(n_chars, digest of the edited text) of texts in order."""
    out = []
    for i, text in enumerate(texts):
        k = len(text) // 4
        following = texts[(i + 1) % len(texts)]
        out.append((len(text), hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest()))
    return out


def test_query(spark, sf_dir):
    got = sorted(QUERIES["op5_imatch_fingerprints"](spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    assert [(r["n_chars"], r["edited_sha256"]) for r in got] == by_hand([d["text"] or "" for d in docs])
    prints = {}
    for r, d in zip(got, docs):
        assert prints.setdefault(d["text"], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    for a, b in zip(got, got[1:] + got[:1]):
        assert (a["near_next"] == 1) >= (a["fingerprint"] == b["fingerprint"])
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > 0.3 and mean("near_next") < 0.05


@pytest.mark.parametrize("rows_per_bucket", [1, 3, 4096])
def test_every_row_finds_the_next(spark, rows_per_bucket):
    rng = random.Random(rows_per_bucket)
    ids = rng.sample(range(-1000, 1000), 60) + [5000, 5000, None, None]
    rows = [(i, f"t{n}") for n, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cut, bucket, order, extra = sequence.in_buckets(frame, "doc_id", rows_per_bucket)
    following = Window.partitionBy(bucket).orderBy(extra, order, "text")
    got = {(r["doc_id"], r["text"]): r["after"] for r in cut.withColumn("after", F.lead("text").over(following)).where(~F.col(extra)).collect()}
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {r: in_order[(n + 1) % len(in_order)][1] for n, r in enumerate(in_order)}


def test_one_row_and_none(spark, no_docs):
    one = spark.createDataFrame([(7, "only")], "doc_id long, text string")
    cut, bucket, order, extra = sequence.in_buckets(one, "doc_id")
    assert sorted(r[extra] for r in cut.collect()) == [False, True]
    assert sequence.in_buckets(no_docs, "doc_id")[0].count() == 0


def distinct_words(text):
    return set("".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split(" ")) - {""}


def test_lexicon_is_the_band(spark, edge_docs):
    texts = [r["text"] or "" for r in edge_docs.collect()]
    seen = {}
    for t in texts:
        for w in distinct_words(t):
            seen[w] = seen.get(w, 0) + 1
    low, high = 0.05, 0.3
    want = {w for w, n in seen.items() if low * len(texts) <= n <= high * len(texts)}
    assert imatch.lexicon(edge_docs, band=(low, high)) == {w: imatch.term_hash(w) for w in want}
    with pytest.raises(ValueError):
        imatch.lexicon(edge_docs, band=(low, high), limit=0)


def test_signatures():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    known = {w: imatch.term_hash(w) for w in words[:300]}
    subsets = imatch.Subsets()
    a = words[:60]
    texts = [" ".join(x) for x in (a, rng.permutation(a), a + words[300:], a[:45], words[60:120], [], words[300:303])]
    got = imatch.signatures(texts, known, subsets)
    assert (got[0] == got[1]).all() and (got[0] == got[2]).all()  # order and terms outside the band do not matter
    share = lambda i, j: ((got[i] == got[j]) & (got[i] > 0)).sum()
    assert share(0, 3) > 8 and share(0, 4) == 0
    assert not got[5].any() and got[6].any()
    alone = np.concatenate([imatch.signatures([x], known, subsets) for x in texts])
    assert (alone == got).all()


def test_likeness_bounds():
    subsets = imatch.Subsets()
    a, b = np.zeros((1, subsets.count), int), np.zeros((1, subsets.count), int)
    b[0, -1] = 7
    assert imatch.likeness(a, a, subsets) == imatch.likeness(b, b, subsets) == 1 and imatch.likeness(a, b, subsets) == 0


def test_edge_table(spark, edge_docs, no_docs, monkeypatch):
    known = imatch.lexicon(edge_docs, band=(0.05, 0.3))
    whole = sorted(map(tuple, imatch.against_next(edge_docs, known).collect()), key=repr)
    monkeypatch.setattr(imatch, "AT_ONCE", 3)
    assert sorted(map(tuple, imatch.against_next(edge_docs, known).collect()), key=repr) == whole
    assert len(whole) == edge_docs.count()
    prints = {r["id"]: r["p"] for r in edge_docs.select(F.col("doc_id").alias("id"), imatch.fingerprinter(spark, known)(F.col("text")).alias("p")).collect()}
    assert prints[0] == prints[1] and all(row[3] == prints[row[0]] for row in whole)
    assert imatch.against_next(no_docs, {}).count() == 0 and imatch.lexicon(no_docs) == {}
