import hashlib
import random

import pytest

from tagloom.llm import debruijn
from tagloom.llm.queries import QUERIES


def by_hand(rows, k=13):
    """(id, n_words, n_removed, kept) of (id, text) rows."""
    split = [[w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in t or "").split(" ") if w] for _, t in rows]
    first = {}
    for (doc, _), words in zip(rows, split):
        if doc is not None:
            for i in range(len(words) - k + 1):
                key = tuple(words[i : i + k])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - k + 1):
            if doc is not None and first[tuple(words[i : i + k])] < doc:
                gone.update(range(i, i + k))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def run(frame, **options):
    got = debruijn.remove_repeats(frame, **options)
    assert got.columns == [*frame.columns, "n_words", "n_removed", "kept"]
    return sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


def shuffled(seed, k):
    """Documents that copy passages from each other, with branches, loops and overlaps."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    pool = [[rng.choice(words) for _ in range(rng.randint(k, 4 * k))] for _ in range(8)]
    rows = []
    for doc in rng.sample(range(1000), 60):
        text = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                text += [rng.choice(words) for _ in range(rng.randint(1, 2 * k))]
            else:
                passage = rng.choice(pool)
                a = rng.randint(0, len(passage) - k)
                text += passage[a : a + rng.randint(k, len(passage))] * rng.randint(1, 2)
        rows.append((doc, rng.choice([" ", "\n", " \t "]).join(text)))
    return rows


@pytest.mark.parametrize("seed,k,options", [(1, 13, {}), (2, 5, dict(windows_per_bucket=50)), (3, 3, dict(windows_per_bucket=20)), (4, 1, {})])
def test_like_by_hand(spark, monkeypatch, seed, k, options):
    monkeypatch.setattr(debruijn, "BYTES_AT_ONCE", 300 * seed)
    rows = shuffled(seed, k)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(frame, k=k, **options) == by_hand(rows, k)


def test_a_run_that_most_documents_share(spark):
    """Windows that straddle one common run, with other words around it, do not all meet in one group."""
    rng = random.Random(6)
    runs = [[f"c{i}", "rights", "are", "reserved"] for i in range(3000)]
    common = min(runs, key=lambda r: debruijn.windows([" ".join(r).encode()], 4, 42)[4][0])  # a run of a low hash
    rows = [
        (i, " ".join([f"a{rng.randrange(99999)}" for _ in range(12)] + common + [f"b{rng.randrange(99999)}" for _ in range(12)]))
        for i in range(600)
    ]
    rows += [(600 + i, text) for i, (_, text) in enumerate(rows[:30])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = frame.selectExpr("doc_id AS doc", "0L AS mark", "CAST(text AS binary) AS text")
    largest = {}
    for per in (500, 10**6):
        hot = debruijn.hot_buckets(keyed, 13, 16, 42, per)
        packed = keyed.mapInPandas(debruijn._mapper(13, (16, hot), 42, 0, 64), debruijn.PACKED).where("kind = 0")
        sizes = packed.selectExpr("bucket", "length(first) / 8 AS n").groupBy("bucket").sum("n").collect()
        largest[per] = max(n for _, n in sizes)
    assert largest[10**6] > 5000 and largest[500] <= 1000
    assert run(frame, windows_per_bucket=500) == by_hand(rows)


def test_edge_table(edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert run(docs) == by_hand(rows) and run(docs, k=2) == by_hand(rows, 2)


def test_one_hash_for_different_windows(spark, monkeypatch):
    """The check of the words finds it, and the search is run again under another seed."""
    seeds = []
    monkeypatch.setattr(debruijn, "_mapper", lambda *a, real=debruijn._mapper: seeds.append(a[2:]) or real(*a))
    rows = [(i, 0, t.encode()) for i, t in shuffled(9, 4)]
    paths = debruijn.repeated_spans(spark.createDataFrame(rows, "doc long, mark long, text binary"), k=4, bits=3)
    assert seeds == [(42, 0, 3), (43, 2, 64)]
    texts = {i: t.split() for i, _, t in rows}
    found = paths.collect()
    assert found and all(r["src_doc"] < r["doc"] for r in found)
    for r in found:
        n = r["size"] + 3
        assert texts[r["doc"]][r["pos"] : r["pos"] + n] == texts[r["src_doc"]][r["src_pos"] : r["src_pos"] + n]


@pytest.mark.parametrize("values", [[], [5], [7] * 9, [3, 2, 1], [0, 255], [-5, 1 << 40], [-(1 << 63), (1 << 63) - 1], list(range(1000))])
def test_packing(values):
    assert debruijn.unpack(debruijn.pack(values)).tolist() == values


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op6_substring_dedup"](spark, sf_dir).collect()), key=repr)
    assert got == sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in by_hand(rows)), key=repr)
