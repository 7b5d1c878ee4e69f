import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import simhash
from tagloom.llm.components import components
from tagloom.llm.queries import QUERIES


def by_hand(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def groups(values, linked):
    """Smallest index reachable, by brute force."""
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_rows_of_the_edge_table(edge_docs):
    got = [(r["id"], r["fp"], r["component"]) for r in simhash.near_duplicates(edge_docs).collect()]
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    prints = [by_hand(t) for _, t in rows]
    label = groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {g: min((rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None), default=None) for g in label}
    want = [(i, p - (1 << 64) if p >> 63 else p, least[g]) for (i, _), p, g in zip(rows, prints, label)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("bucket_rows", [2, 64])
@pytest.mark.parametrize("max_bits,segments", [(2, 5), (2, 3), (1, 4), (3, 7), (0, 2)])
def test_links_connect_like_all_pairs(spark, max_bits, segments, bucket_rows):
    rng = np.random.default_rng(max_bits + segments)
    values = {int(v) for v in rng.integers(0, 1 << 63, 60)}
    for v in list(values)[:40]:
        for _ in range(4):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.links(frame, max_bits, segments, bucket_rows)
    assert all(near(r["a"], r["b"]) for r in found.collect())
    got = {r["node"]: r["component"] for r in components(found).collect()}
    label = groups(signed, near)
    assert [got.get(v, v) for v in signed] == [signed[g] for g in label]


@pytest.mark.parametrize("limit, hot_rows", [(1 << 26, 1 << 20), (0, 1 << 20), (0, 1000)])
def test_components_of_a_hub(spark, limit, hot_rows):
    """A node linked to half of all, two chains and a pair; looked up by broadcast, shuffle and salted shuffle."""
    hub = spark.range(20_000).select(F.lit(50_000).alias("a"), F.col("id").alias("b"))
    chain = spark.range(30_000, 30_020).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    tied = spark.createDataFrame([(19_999, 30_000), (60_000, 60_001), (None, 1), (7, 7)], "a long, b long")
    edges = hub.union(chain).union(tied)
    got = components(edges, limit, hot_rows).groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["component"]: r["n"] for r in got} == {0: 20_022, 60_000: 2}


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_query(spark, sf_dir):
    rows = QUERIES["op4_simhash_near_dedup"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == {i: by_hand(t) for i, t in texts.items()}
    ids = sorted(texts)
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    label = groups([prints[i] for i in ids], lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: ids[g] for i, g in zip(ids, label)}


def test_one_of_each(spark, edge_docs, no_docs):
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    found = simhash.near_duplicates(edge_docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    prints = {(r["id"], r["mark"]): r["fp"] for r in found}
    label = groups(list(prints.values()), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert len(rows) == len(set(label)) and len(set(rows)) == len(rows)
    wanted = {r["component"] for r in found if r["component"] is not None}
    assert {i for i, _ in rows if i is not None} == wanted
    assert simhash.one_of_each(no_docs).count() == 0
