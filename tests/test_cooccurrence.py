import random
from collections import Counter

import numpy as np
import pytest

from tagloom.operators import cooccurrence


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    topics = [words[i : i + 12] for i in range(0, 36, 6)]
    return [[rng.choice(rng.choice(topics)) if rng.random() < 0.2 else rng.choice(topics[i % 6]) for _ in range(rng.randint(0, 30))] for i in range(120)] + [[], None]


def counted(documents, window):
    out = Counter()
    for tokens in documents:
        for i, a in enumerate(tokens or ()):
            for b in tokens[i + 1 : i + 1 + window]:
                out[a, b] += 1
                out[b, a] += 1
    return out


@pytest.mark.parametrize("window", [1, 4, 25])
def test_counts(spark, documents, window):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "sample_id long, tokens array<string>")
    got = {(r["a"], r["b"]): r["n"] for r in cooccurrence.cooccurrence_counts(rows, window=window).collect()}
    assert got == counted(documents, window)


def mutual(documents, window):
    counts = counted(documents, window)
    total = sum(counts.values())
    margin = Counter()
    for (a, _), n in counts.items():
        margin[a] += n
    words = sorted(margin)
    matrix = np.zeros((len(words), len(words)))
    for (a, b), n in counts.items():
        matrix[words.index(a), words.index(b)] = max(0.0, np.log(n * total / (margin[a] * margin[b])))
    return words, matrix


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_span_the_leading_directions(spark, documents, monkeypatch, block):
    """Products of vectors are those of the exact eigenvectors, whatever the number of vocabulary blocks."""
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "sample_id long, tokens array<string>")
    size = 5
    found = {r["word"]: r["vector"] for r in cooccurrence.pmi_vectors(rows, vector_size=size, window=4, spare=15, iterations=12).collect()}
    words, matrix = mutual(documents, 4)
    values, vectors = np.linalg.eigh(matrix)
    best = np.argsort(-values)[:size]
    assert set(found) == set(words) and {len(v) for v in found.values()} == {size}
    ours = np.array([found[w] for w in words])
    exact = vectors[:, best] * values[best] @ vectors[:, best].T
    assert np.abs(ours @ ours.T - exact).max() < 1e-3 * np.abs(exact).max()


def test_rare_words_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"])], "sample_id long, tokens array<string>")
    found = cooccurrence.pmi_vectors(rows, vector_size=2, window=2, min_count=2, spare=1, iterations=2).collect()
    assert {r["word"] for r in found} == {"a"}
    every = cooccurrence.pmi_vectors(rows, vector_size=2, window=2, spare=2, iterations=1).collect()
    assert {r["word"] for r in every} == {"a", "b", "c"} and all(np.isfinite(r["vector"]).all() for r in every)
    assert cooccurrence.pmi_vectors(rows.limit(0), vector_size=2, window=2, iterations=1).count() == 0


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_cells_of_any_size_hold_all_pairs(spark, documents, monkeypatch, limit):
    """Sums handed over many times, many classes, cut cells and shuffled margins: the same counts and information."""
    for name, value in (("PAIRS_HELD", 60), ("TOKENS_AT_ONCE", 16), ("PAIRS_OF_CELL", 500), ("ENTRIES_OF_CELL", 7), ("ROWS_OUT", 3)):
        monkeypatch.setattr(cooccurrence, name, value)
    lookup = cooccurrence.lookup_join
    monkeypatch.setattr(cooccurrence, "lookup_join", lambda *a, **k: lookup(*a, **k, limit=limit))
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "sample_id long, tokens array<string>")
    want = counted(documents, 4)
    counts = cooccurrence.cooccurrence_counts(rows, window=4)
    assert "explode(flatten" not in counts._jdf.queryExecution().toString()
    got = counts.collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["n"] for r in got} == want
    cells = cooccurrence.packed_counts(rows, window=4)
    assert cells.classes > 3
    words, matrix = mutual(documents, 4)
    found = {(r["a"], r["b"]): r["pmi"] for r in cooccurrence.positive_pmi(cells).collect()}
    assert len(found) == (matrix > 0).sum()
    assert all(abs(matrix[words.index(a), words.index(b)] - x) < 1e-9 for (a, b), x in found.items())


def test_vectors_of_cut_tiles_and_repeated_blocks(spark, documents, monkeypatch):
    """Small tiles, cut by their rows, that meet shuffled and repeated blocks of the basis: the same vectors."""
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "sample_id long, tokens array<string>")
    settings = dict(vector_size=3, window=4, spare=7, iterations=2)
    monkeypatch.setattr(cooccurrence, "BLOCK", 8)
    whole = {r["word"]: r["vector"] for r in cooccurrence.pmi_vectors(rows, **settings).collect()}
    for name, value in (("BLOCKS_OF_TILE", 2), ("ENTRIES_OF_TILE", 20), ("TILES_TOGETHER", 1)):
        monkeypatch.setattr(cooccurrence, name, value)
    lookup = cooccurrence.lookup_join
    monkeypatch.setattr(cooccurrence, "lookup_join", lambda *a, **k: lookup(*a, **k, limit=0))
    cut = {r["word"]: r["vector"] for r in cooccurrence.pmi_vectors(rows, **settings).collect()}
    ours, want = (np.array([found[w] for w in sorted(whole)]) for found in (cut, whole))
    assert set(cut) == set(whole) and np.abs(ours @ ours.T - want @ want.T).max() < 1e-3 * np.abs(want @ want.T).max()


def test_packed_numbers_and_words():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for values in ([], [0], [255, 256, 0], rng.integers(1 << 62, size=1000), np.arange(70000)):
        assert cooccurrence._unsqueezed(cooccurrence._squeezed(np.array(values, np.int64))).tolist() == list(values)
    for words in ([], ["", "é", None, "a b\n", "", "日本"], ["x"] * 300):
        packed = (pa.array([x], pa.binary()) for x in cooccurrence._squeezed_words(pa.array(["cut", *words], pa.string())[1:]))
        assert cooccurrence._words(pa.RecordBatch.from_arrays([*packed], names=["sizes", "letters"]), 0).to_pylist() == words


def test_cells_are_packed_and_lists_are_not_repeated(spark, documents):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "sample_id long, tokens array<string>")
    cells = cooccurrence.packed_counts(rows, window=4)
    packed = sum(len(x) for row in cells.df.collect() for x in row if isinstance(x, (bytes, bytearray)))
    pairs = sum(1 for a, b in counted(documents, 4) if a <= b)
    assert packed < 6 * pairs, "a pair took 16 bytes"
    # a join gave every cell the whole lists of its two classes
    assert "Join" not in cooccurrence.positive_pmi(cells)._jdf.queryExecution().executedPlan().toString()


def test_tiles_hold_a_pair_once_and_spent_tables_go(spark, documents, monkeypatch):
    """A tile asks for the rows of its own words only, and of the steps before the last nothing stays on disk."""
    import os

    monkeypatch.setattr(cooccurrence, "BLOCK", 8)
    monkeypatch.setattr(cooccurrence, "BLOCKS_OF_TILE", 2)
    made, held = [], []
    real_stage, real_tiles = cooccurrence.stage, cooccurrence._tiles
    monkeypatch.setattr(cooccurrence, "stage", lambda df, name: made.append((name, real_stage(df, name))) or made[-1][1])

    def tiles(entries):
        found = real_tiles(entries)
        held.extend(cooccurrence._unranked(found.limit(99).toArrow().combine_chunks().to_batches()[0], i) for i in range(found.count()))
        return found

    monkeypatch.setattr(cooccurrence, "_tiles", tiles)
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "sample_id long, tokens array<string>")
    assert cooccurrence.pmi_vectors(rows, vector_size=3, window=4, spare=7, iterations=2).count() == 40
    pairs = [p for numbers, _, (a, b, _) in held for p in zip(numbers[a], numbers[b])]
    assert len(held) > 2 and len(set(pairs)) == len(pairs) == np.triu(mutual(documents, 4)[1] > 0).sum()
    assert all(set(numbers) == set(numbers[a]) | set(numbers[b]) for numbers, _, (a, b, _) in held)
    assert {name for name, table in made if os.path.exists(table.staged_path.removeprefix("file:"))} == {"needs", "last"}
