import math

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import mixing
from tagloom.llm.queries import MIX, QUERIES


def corpus(spark, n=300):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows, labels = [], []
    for i in range(n):
        kind = ["clean", "low", "toxic"][int(rng.choice(3, p=[0.6, 0.25, 0.15]))]
        text = rng.choice(words, rng.integers(5, 60)).tolist()
        if kind == "low":
            text = [w.upper() + "!!" for w in text]
        if kind == "toxic":
            text += rng.choice(["nasty", "vile", "awful"], 2).tolist()
        rows.append((i, " ".join(text)))
        if i % 2:
            labels.append((i, kind))
    rows += [(n, None), (n + 1, ""), (None, "no id here"), (7, "same id, other text"), (8, rows[8][1]), (8, rows[8][1])]
    labels += [(None, "clean"), (3, None), (9999, "toxic")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")


def posteriors(model, features):
    """By hand, from the table of weights."""
    weights = {r["token"]: [r[f"w_{k}"] for k in range(len(model.domains))] for r in model.weights.collect()}
    matched = [t for t in dict.fromkeys(features) if t in set(model.lexicon)]
    used = [mixing.ALL, *matched] + ([] if any(not t.startswith("#") for t in matched) else [mixing.PLAIN])
    scores = [sum(weights[t][k] for t in used if t in weights) for k in range(len(model.domains))]
    raised = [math.exp(s - max(scores)) for s in scores]
    return [r / sum(raised) for r in raised]


def test_classifier(spark):
    docs, labels = corpus(spark)
    model = mixing.fit(docs, labels)
    assert model.domains[0] == "clean" and set(model.domains) == {"clean", "low", "toxic"}
    assert {"nasty", "vile", "awful"} <= set(model.lexicon)
    given = {r["id"]: r["domain"] for r in labels.select(F.col("doc_id").alias("id"), "domain").collect() if r["id"] is not None and r["domain"]}
    rows = {(r["id"], r["mark"]): r for r in mixing.described(docs, "doc_id", "text").collect()}
    learned = {}
    for (i, mark), r in sorted(rows.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if i in given:
            learned.setdefault(mark, (given[i], r["features"]))
    n = len(learned)
    for r in model.weights.where(~F.col("token").isin(mixing.ALL, mixing.PLAIN)).collect():
        has = [d for d, f in learned.values() if r["token"] in f]
        for k, domain in enumerate(model.domains):
            share = sum(d == domain for d, _ in learned.values()) / n
            assert math.isclose(r[f"w_{k}"], math.log((has.count(domain) + 30 * share) / (len(has) + 30) / share), abs_tol=1e-9)
    got = {(r["id"], r["mark"]): r for r in mixing.memberships(docs, model).collect()}
    assert set(got) == set(rows) and got[(8, next(m for i, m in rows if i == 8))]["rows"] == 3
    for key, r in got.items():
        assert r["tokens"] == rows[key]["tokens"]
        assert np.allclose([r[f"p_{k}"] for k in range(3)], posteriors(model, rows[key]["features"]))
    truth = {i: d for i, d in given.items() if (i, None) not in rows}
    best = {i: model.domains[int(np.argmax([r[f"p_{k}"] for k in range(3)]))] for (i, _), r in got.items() if r["rows"] == 1}
    held = [i for i in truth if i in best]
    assert sum(best[i] == truth[i] for i in held) >= 0.9 * len(held)


def by_hand(tokens, p, wanted, max_rate, steps=3000):
    rate, now = np.ones(len(tokens)), tokens @ p
    for _ in range(steps):
        rate = np.clip(rate - p @ (((tokens * rate) @ p - wanted) / now), 0, max_rate or np.inf)
    return rate


@pytest.mark.parametrize("max_rate", [None, 1.0])
def test_rates_meet_the_targets(spark, max_rate):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.2, 0.2], 400)
    tokens = rng.integers(1, 500, 400)
    rows = [(i, i, int(t), 1, *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p))]
    members = spark.createDataFrame(rows, "id long, mark long, tokens long, rows long, p_0 double, p_1 double, p_2 double")
    targets = {"a": 5.0, "b": 3.0, "c": 2.0}
    out = mixing.fit_rates(members, ("a", "b", "c"), targets, max_rate=max_rate, tolerance=1e-4).collect()
    rate = np.array([r["rate"] for r in sorted(out, key=lambda r: r["id"])])
    assert (rate >= 0).all() and (max_rate is None or rate.max() <= max_rate)
    now = tokens @ p
    goal = now.sum() if max_rate is None else min(now.sum(), min(now / np.array([0.5, 0.3, 0.2])))
    wanted = goal * np.array([0.5, 0.3, 0.2])
    best = by_hand(tokens, p, wanted, max_rate)
    off = lambda r: np.abs((tokens * r) @ p - wanted).max() / goal
    assert off(rate) <= off(best) + 2e-3
    assert max_rate or np.abs(rate - best).max() < 0.05  # at the bound many rates meet the targets as well


def test_a_scarce_domain_lowers_no_clean_rate(spark):
    """0.1 % toxic rows: they stay, clean rows stay, only the ample domain is lowered to its share of the clean tokens."""
    kinds = ["toxic" if i < 2 else "low" if i < 300 else "clean" for i in range(2000)]
    rows = [(i, i, 10, 1, *(1.0 if k == d else 0.0 for d in ("clean", "low", "toxic"))) for i, k in enumerate(kinds)]
    members = spark.createDataFrame(rows, "id long, mark long, tokens long, rows long, p_0 double, p_1 double, p_2 double")
    out = mixing.fit_rates(members, ("clean", "low", "toxic"), MIX, max_rate=1.0, anchor="clean").collect()
    rates = {d: [r["rate"] for r in out if kinds[r["id"]] == d] for d in MIX}
    assert set(rates["clean"]) == set(rates["toxic"]) == {1.0}
    assert math.isclose(sum(rates["low"]) / len(rates["clean"]), 0.04 / 0.94, rel_tol=2e-3)


@pytest.mark.parametrize("shares", [[0.869, 0.13, 0.001], [0.989, 0.01, 0.001], [0.7, 0.001, 0.299]])
def test_stage_keeps_clean_documents(spark, sf_dir, monkeypatch, shares):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "abcde" for b in "klmnopqr"]
    kinds = np.repeat(["clean", "low", "toxic"], [round(3000 * s) for s in shares]).tolist()
    texts = [rng.permutation(words).tolist() for _ in kinds]  # so only the marks of a domain tell
    texts = [[w.upper() + "!!" for w in t] if k == "low" else t + ["nasty", "vile"] if k == "toxic" else t for k, t in zip(kinds, texts)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, domain string")
    monkeypatch.setattr(corpus_pipeline, "labelled_domains", lambda *_: labels)
    kept = [kinds[r["doc_id"]] for r in corpus_pipeline.source_mixing(spark, docs, sf_dir).select("doc_id").collect()]
    assert kept.count("clean") >= 0.99 * kinds.count("clean")
    for kind, share in MIX.items():
        assert kind == "clean" or kept.count(kind) <= 1.6 * share / MIX["clean"] * kinds.count("clean") + 3


def test_an_anchor_without_labels_is_an_error(spark):
    members = spark.createDataFrame([(1, 1, 10, 1, 1.0)], "id long, mark long, tokens long, rows long, p_0 double")
    with pytest.raises(ValueError, match="clean"):
        mixing.fit_rates(members, ("toxic",), MIX, max_rate=1.0, anchor="clean")


def test_take_has_the_rate_as_mean(spark):
    frame = spark.range(20000).withColumn("rate", F.lit(1.3)).select(mixing.take(F.col("rate"), "id").alias("n"))
    counts = {r["n"]: r["count"] for r in frame.groupBy("n").count().collect()}
    assert set(counts) == {1, 2} and abs(counts[2] / 20000 - 0.3) < 0.02


def test_empty(spark, no_docs):
    docs, labels = corpus(spark, 40)
    model = mixing.fit(docs, labels)
    assert mixing.fit_rates(mixing.memberships(no_docs, model), model.domains, MIX).count() == 0
    nothing = mixing.fit(docs, labels.limit(0))
    assert nothing.domains == () and mixing.fit_rates(mixing.memberships(docs, nothing), nothing.domains, MIX).count() == 0


def test_query_and_native_plan(spark, sf_dir):
    out = QUERIES["op2_source_mixing"](spark, sf_dir)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    names = sorted(MIX)
    p = np.array([[r[f"p_{d}"] for d in names] for r in rows])
    tokens, rate = np.array([r["tokens"] for r in rows]), np.array([r["rate"] for r in rows])
    wanted = tokens.sum() * np.array([MIX[d] for d in names])
    off = lambda r: np.abs((tokens * r) @ p - wanted).max() / tokens.sum()
    assert off(rate) <= max(off(by_hand(tokens, p, wanted, None)), 2e-3) * 1.05 and off(rate) < off(np.ones(len(rows)))


def test_every_domain_is_learned(spark, monkeypatch):
    rows = [(i, f"word{'abcdefghij'[i % 10]} more{'abcdefghij'[i // 10 % 10]} text") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, f"d{i % 100:03d}") for i in range(600)], "doc_id long, domain string")
    model = mixing.fit(docs, labels)
    assert len(model.domains) == 100
    got = mixing.memberships(docs, model).agg(F.count("p_99").alias("n"), F.sum("p_99").alias("p")).first()
    assert got["n"] == 600 and got["p"] > 0
    monkeypatch.setattr(mixing, "MOST_DOMAINS", 99)
    with pytest.raises(ValueError, match="over 99 domains"):
        mixing.fit(docs, labels)


def test_targets_that_cannot_be_met_are_named(spark):
    """Memberships of .9 and .1 in all rows give these shares and no others."""
    members = spark.createDataFrame([(i, i, 10, 1, 0.9, 0.1) for i in range(50)], "id long, mark long, tokens long, rows long, p_0 double, p_1 double")
    with pytest.warns(mixing.Unmet) as caught:
        rates = mixing.fit_rates(members, ("a", "b"), {"a": 0.1, "b": 0.9}).collect()
    missed = next(w.message.args[0] for w in caught if isinstance(w.message, mixing.Unmet))
    rate = rates[0]["rate"]
    assert all(abs(r["rate"] - rate) < 1e-9 for r in rates)
    assert abs(missed["a"] - (450 * rate - 50)) <= 1 and abs(missed["b"] - (50 * rate - 450)) <= 1
    # the least of (450 r - 50)^2 / 450 + (50 r - 450)^2 / 50
    assert abs(rate - 1.0) < 2e-2
    with pytest.raises(mixing.NotConverged):
        mixing.fit_rates(members, ("a", "b"), {"a": 0.1, "b": 0.9}, most_steps=0)
