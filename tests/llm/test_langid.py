import zlib

import numpy as np

from tagloom.llm import langid
from tagloom.llm.queries import QUERIES


def slow_counts(text, slots):
    """Gram slots one by one, from the normalised text."""
    kept = [c if c.isalpha() else " " for c in text.lower()]
    joined = " " + "".join(kept) + " "
    while "  " in joined:
        joined = joined.replace("  ", " ")
    codes = [ord(c) for c in joined]
    out = np.zeros(slots, np.int64)
    if not any(c.isalpha() for c in text):
        return out
    mask, shift = (1 << 32) - 1, 32 - slots.bit_length() + 1
    for i in range(len(codes) - 2):
        pair = (codes[i] * 0x9E3779B1 + codes[i + 1]) & mask
        for key in (codes[i] ^ 0x51ED270B, pair, (pair * 0x85EBCA6B + codes[i + 2]) & mask):
            out[((key * 2654435761) & mask) >> shift] += 1
    return out


def test_counts_match_a_slow_pass(monkeypatch):
    texts = ["Hello,  World 12 ab", "é", "", None, "12 !!", "Ünder one İ", "x" * 50, "word " * 40]
    for size in (langid.CHARS_AT_ONCE, 7):
        monkeypatch.setattr(langid, "CHARS_AT_ONCE", size)
        want = sum(slow_counts(t, 256) for t in texts if t)
        assert (langid.count_grams(texts, 256) == want).all()


def test_posteriors_match_a_slow_pass(spark):
    docs = spark.createDataFrame(
        [(i, "the house and the garden " * 3 if i % 2 else "la maison et le jardin " * 3, "en" if i % 2 else "fr") for i in range(40)],
        "doc_id long, text string, lang string",
    )
    model = langid.fit(docs)
    assert model.langs == ("en", "fr")
    counts = {lang: sum(slow_counts(r["text"], langid.SLOTS) for r in docs.collect() if r["lang"] == lang) for lang in model.langs}
    texts = ["the garden", "le jardin", "house maison x", "?", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.identify(frame, model).collect()}
    for i, text in enumerate(texts):
        seen = slow_counts(text or "", langid.SLOTS)
        if not seen.any():
            assert got[i] == ("und", 0.0)
            continue
        logs = [(seen * np.log((c + 0.1) / (c.sum() + 0.1 * langid.SLOTS))).sum() for c in counts.values()]
        share = np.exp(logs - max(logs))
        best = int(np.argmax(share))
        assert got[i][0] == model.langs[best] and abs(got[i][1] - share[best] / share.sum()) < 1e-4


def test_no_language_is_left_out(spark, monkeypatch):
    """Three hundred languages, each with a word of its own; the matrix has fewer slots and all columns."""
    monkeypatch.setattr(langid, "MATRIX_BYTES", 300 * 4 * 4096)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[(i * k + i // 7) % 26] for k in (1, 3, 5, 7, 11)) + letters[i % 26] + letters[i // 26] * 3
    rows = [(i, word(i % 300) + " " + word(i % 300), f"l{i % 300:03d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 300 and model.matrix.shape == (4096, 300)
    got = {r["id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert len(set(got.values())) > 280 and sum(got[i] == lang for i, _, lang in rows) > 0.9 * len(rows)


def test_edge_table(edge_docs, no_docs):
    model = langid.fit(edge_docs)
    assert model.langs == ("de", "en", "fr")
    rows = langid.identify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (3, 4, 5, 7))
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = langid.fit(no_docs)
    assert nothing.langs == () and langid.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge_docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark, sf_dir):
    rows = QUERIES["op1_language_id"](spark, sf_dir).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in truth}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
