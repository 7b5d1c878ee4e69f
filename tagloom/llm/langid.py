"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

UNDETERMINED = "und"
SLOTS = 1 << 15
MATRIX_BYTES = 64 * 1024 * 1024
CHARS_AT_ONCE = 1 << 18
SPACE = 32


@dataclass(frozen=True)
class Model:
    """Learned languages, their log priors, and log-probabilities by (slot, language)."""

    langs: tuple
    prior: np.ndarray
    matrix: np.ndarray


@cache
def _letters():
    """By code point: is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_codes(text):
    """Lower-cased code points; each run of other characters, and either end, is one space.

    Empty if the text is null or has no letter.
    """
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    padded = np.full(len(codes) + 2, SPACE, np.uint32)
    padded[1:-1][letter] = codes[letter]
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != SPACE) | (padded[:-1] != SPACE)
    return padded[keep]


def _mix(key, slots):
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - slots.bit_length() + 1)).astype(np.intp)


def gram_slots(codes, slots):
    """Slots of all 1-, 2- and 3-grams that start in ``codes[:-2]``."""
    one, two, three = codes[:-2], codes[1:-1], codes[2:]
    pair = one * np.uint32(0x9E3779B1) + two
    return _mix(one ^ np.uint32(0x51ED270B), slots), _mix(pair, slots), _mix(pair * np.uint32(0x85EBCA6B) + three, slots)


def _pieces(texts):
    """(numbers, starts, codes) of groups of texts, code arrays joined, of a bounded length each.

    A longer text comes in several groups that overlap by two code points, so
    that each n-gram is seen once.
    """
    numbers, arrays, size = [], [], 0
    for number, text in enumerate(texts):
        codes = letter_codes(text)
        for at in range(0, max(len(codes) - 2, 0), CHARS_AT_ONCE):
            part = codes[at : at + CHARS_AT_ONCE + 2]
            if size + len(part) > CHARS_AT_ONCE + 2 and arrays:
                yield numbers, arrays
                numbers, arrays, size = [], [], 0
            numbers.append(number)
            arrays.append(part)
            size += len(part)
    if arrays:
        yield numbers, arrays


def _grams(arrays, slots):
    """For each order, slots of the joined arrays, and where each array's begin.

    The grams that would run from one array into the next are left out.
    """
    codes = np.concatenate(arrays)
    sizes = np.array([len(a) for a in arrays])
    ends = np.cumsum(sizes)
    inside = np.ones(len(codes) - 2, bool)
    for back in (1, 2):
        inside[ends[:-1] - back] = False
    starts = np.r_[0, np.cumsum(sizes - 2)[:-1]]
    return [g[inside] for g in gram_slots(codes, slots)], starts


def count_grams(texts, slots):
    counts = np.zeros(slots, np.int64)
    for _, arrays in _pieces(texts):
        for grams in _grams(arrays, slots)[0]:
            counts += np.bincount(grams, minlength=slots)
    return counts


def joint(texts, model):
    """(log prior + log likelihood by text and language, has a letter by text)."""
    out = np.tile(model.prior, (len(texts), 1))
    known = np.zeros(len(texts), bool)
    for numbers, arrays in _pieces(texts):
        grams, starts = _grams(arrays, len(model.matrix))
        known[numbers] = True
        for one in grams:
            np.add.at(out, numbers, np.add.reduceat(model.matrix[one], starts, axis=0, dtype=np.float64))
    return out, known


def fit(docs, text_col="text", lang_col="lang", key_col="doc_id", rows_per_lang=2000, smoothing=0.1):
    """Learn a model from the rows with a language.

    The classifier is fitted on a bounded sample: about ``rows_per_lang`` rows
    of every language that occurs, drawn by a hash of the key.  n-grams are
    counted in the tasks; one row per task, language and slot is shuffled.  There
    are ``SLOTS`` hash slots, halved until the matrix takes no more than
    ``MATRIX_BYTES``, but 1,024 at least: with many languages the n-grams share
    slots, no language is left out.  Languages are equally likely beforehand.

    Rows with a null language or key are not learned from; repeated rows count
    as often as they are drawn.  Long texts are counted a stretch at a time.
    Other columns are not read.  Without any row the model has no language and
    predicts ``und``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key_col).alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("key").isNotNull() & F.col("lang").isNotNull())
    found = rows.groupBy("lang").count().collect()  # one row per language
    langs = tuple(sorted(r["lang"] for r in found))
    sizes = {r["lang"]: r["count"] for r in found}
    slots = SLOTS
    while slots > 1024 and slots * len(langs) * 4 > MATRIX_BYTES:
        slots //= 2
    counts = np.zeros((slots, len(langs)), np.int64)
    if langs:
        share = spark.createDataFrame(
            [(i, lang, min(1.0, rows_per_lang / sizes[lang])) for i, lang in enumerate(langs)], "code int, lang string, share double"
        )
        draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = rows.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("code", "text")
        tasks = 1 + len(langs) * rows_per_lang // 2000

        def partial(batches):
            for batch in batches:
                for code, texts in batch.groupby("code")["text"]:
                    seen = count_grams(texts.tolist(), slots)
                    at = np.flatnonzero(seen)
                    yield pd.DataFrame({"code": np.full(len(at), code, np.int32), "slot": at.astype(np.int32), "n": seen[at]})

        total = sample.repartition(tasks).mapInPandas(partial, "code int, slot int, n long").groupBy("code", "slot").agg(F.sum("n").alias("n"))
        table = total.toArrow()
        counts[table["slot"].to_numpy(), table["code"].to_numpy()] = table["n"].to_numpy()
    matrix = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * slots)
    # languages count alike: a third of all rows in one language must not win short texts
    prior = np.full(len(langs), -np.log(max(len(langs), 1)))
    return Model(langs, prior, matrix.astype(np.float32))


def predictor(spark, model):
    """A column function text → struct(lang_pred, score); the model is broadcast once.

    ``score`` is the posterior of the predicted language, ties going to the
    first name.  Null texts and texts without a letter are ``und`` with score 0.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        model = shared.value
        if not model.langs:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(text), "score": 0.0})
        scores, known = joint(text.tolist(), model)
        best = scores.argmax(axis=1)
        top = scores.max(axis=1, keepdims=True)
        posterior = 1.0 / np.exp(scores - top).sum(axis=1)
        names = np.array(model.langs, object)[best]
        return pd.DataFrame({"lang_pred": np.where(known, names, UNDETERMINED), "score": np.where(known, posterior, 0.0)})

    return predict


def identify(docs, model, id_col="doc_id", text_col="text"):
    """(id, lang_pred, score) of every row; only the id and the text are read.  Repeated rows are judged alike."""
    predict = predictor(docs.sparkSession, model)
    rows = docs.select(F.col(id_col).alias("id"), predict(F.col(text_col)).alias("p"))
    return rows.select("id", "p.lang_pred", "p.score")


def held_out(key):
    """Rows that no model may learn from: one fold of three by the key's CRC."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
