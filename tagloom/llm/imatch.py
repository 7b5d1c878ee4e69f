"""I-Match fingerprints: idf-banded terms hashed under randomised lexicon subsets."""

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tagloom.llm.sequence import in_buckets
from tagloom.staging import stage_sized

BREAK = r"[\x00-/:-@\[-`{-\x7f]+"
AT_ONCE = 1024


@dataclass(frozen=True)
class Subsets:
    """Randomised lexicon subsets: ``each`` of them keep a term with probability 2 ** -bits.

    A text with many terms has a few of them in the sparse subsets and one with
    few terms has some in the dense ones, so for either there are subsets that a
    local edit leaves alone.  A text with fewer than ``least_terms`` terms of the
    lexicon counts all its terms: short texts and rare words stay comparable.
    """

    bits: tuple = (1, 2, 4, 6, 8)
    each: int = 16
    seed: int = 42
    least_terms: int = 4

    @property
    def count(self):
        return len(self.bits) * self.each


def words(text):
    """Distinct terms of a text column: runs of ASCII letters and digits and of other characters outside ASCII, lower-cased."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), BREAK)), "")


def lexicon(docs, text_col="text", band=(0.0005, 0.05), limit=64 * 1024 * 1024):
    """Terms whose share of all documents lies in ``band``, with their hashes.

    The band is one of idf, minus the log of that share.  Document frequencies
    are counted over all documents with map-side combine.  Each term of the
    lexicon takes at least the lower share of all (document, term) pairs, so it
    has at most (distinct terms of a mean document) / (lower share) entries
    whatever the corpus; the measured size is checked before it is collected.
    """
    low, high = band
    total = docs.count()
    counted = docs.select(F.explode(words(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    kept = stage_sized(counted.where((F.col("n") >= low * total) & (F.col("n") <= high * total)).select("term"), "lexicon")
    if not kept.fits(limit):
        raise ValueError(f"{kept.rows} terms in the band: raise its lower end")
    found = kept.df.toArrow()["term"].to_pylist()
    return {w: term_hash(w) for w in found}


def term_hash(word):
    return xxhash.xxh64_intdigest(word.encode())


def considered(text, lexicon, least):
    """Sorted hashes of the terms that count: those of the lexicon, or all if they are fewer than ``least``."""
    found = set(re.split(BREAK, text.lower())) - {""} if text else set()
    known = found & lexicon.keys()
    out = [lexicon[w] for w in known] if len(known) >= least else [term_hash(w) for w in found]
    out.sort()
    return out


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(texts, lexicon, subsets):
    """(texts, subsets) hashes from 1; 0 where no term of the text is in the subset."""
    out = np.zeros((len(texts), subsets.count), np.uint16)
    lists = [considered(t, lexicon, subsets.least_terms) for t in texts]
    flat = np.array([h for one in lists for h in one], np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
    number = 0
    for bits in subsets.bits:
        spare = 0
        for _ in range(subsets.each):
            salt = _mix(np.array([subsets.seed * 1000003 + number + 1], np.uint64))
            if spare < bits:  # a draw of 64 bits decides for several subsets
                draw, spare = _mix(flat + salt), 64
            chosen = (draw >> np.uint64(64 - spare)) & np.uint64((1 << bits) - 1) == 0
            spare -= bits
            own, picked = owner[chosen], flat[chosen]
            if len(own):
                heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                # hash of the sorted sequence: each term is mixed with its rank
                rank = np.arange(len(own)) - np.repeat(heads, np.diff(np.r_[heads, len(own)]))
                sums = np.add.reduceat(_mix(picked + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt), heads)
                out[own[heads], number] = _mix(sums) % np.uint64(0xFFFF) + np.uint64(1)
            number += 1
    return out


def hexed(signatures):
    return [row.astype(">u2").tobytes().hex() for row in signatures]


def fingerprinter(spark, lexicon, subsets=None):
    """A column function text → hex fingerprint; the lexicon is broadcast once.  A null text counts as empty."""
    shared, subsets = spark.sparkContext.broadcast(lexicon), subsets or Subsets()

    @F.pandas_udf("string")
    def fingerprint(text: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(text), AT_ONCE):
            out += hexed(signatures(text.iloc[at : at + AT_ONCE].tolist(), shared.value, subsets))
        return pd.Series(out, dtype=object)

    return fingerprint


def likeness(left, right, subsets):
    """Likeness of two matrices of signatures, row by row, 0 to 1.

    Per density, the share of equal hashes among the subsets in which either
    text has a term; the best density with at least a quarter of its subsets so
    counts, else all subsets together.  Equal fingerprints have 1, also those
    without any term.
    """
    shape = (-1, len(subsets.bits), subsets.each)
    left, right = left.reshape(shape), right.reshape(shape)
    used = (left != 0) | (right != 0)
    same = ((left == right) & used).sum(axis=2)
    of = used.sum(axis=2)
    share = np.where(4 * of >= subsets.each, same / np.maximum(of, 1), -1.0).max(axis=1)
    share = np.where(share < 0, same.sum(axis=1) / np.maximum(of.sum(axis=1), 1), share)
    return np.where((left == right).all(axis=(1, 2)), 1.0, share)


def edit(text, following):
    """The last quarter of the code points replaced by the first as many of the next text."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


EDITED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs, lexicon, id_col="doc_id", text_col="text", subsets=None):
    """(id, ...EDITED): each text against its edited form and against the next text by id.

    One shuffle: rows are dealt by ranges of the id, sorted, and paired while
    they stream by.  The last row is followed by the first.  A null text is
    empty; null ids come first; rows of one id are ordered by a hash of the text.
    """
    shared, subsets = docs.sparkSession.sparkContext.broadcast(lexicon), subsets or Subsets()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut, bucket, order, extra = in_buckets(rows, "id")
    dealt = cut.repartition(bucket).sortWithinPartitions(bucket, extra, order, F.xxhash64("text"))

    def pair(rows, marks):
        """All rows but the last, each with its successor where that is in its bucket."""
        first, second = rows.iloc[:-1], rows.iloc[1:]
        use = np.flatnonzero((first[bucket].to_numpy() == second[bucket].to_numpy()) & ~first[extra].to_numpy(bool))
        texts, following = first["text"].iloc[use].tolist(), second["text"].iloc[use].tolist()
        edited = [edit(a, b) for a, b in zip(texts, following)]
        changed = signatures(edited, shared.value, subsets)
        return pd.DataFrame({
            "id": first["id"].iloc[use].reset_index(drop=True), "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": hexed(marks[use]), "edited_fingerprint": hexed(changed),
            "near_edited": likeness(marks[use], changed, subsets), "near_next": likeness(marks[use], marks[use + 1], subsets),
        })

    def stream(batches):
        last, last_mark = None, None
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                rows = batch.iloc[at : at + AT_ONCE]
                marks = signatures(rows["text"].tolist(), shared.value, subsets)
                if last is not None:
                    rows, marks = pd.concat([last, rows]), np.concatenate([last_mark, marks])
                yield pair(rows, marks)
                last, last_mark = rows.iloc[-1:], marks[-1:]

    kind = dict(docs.dtypes)[id_col]
    return dealt.mapInPandas(stream, f"id {kind}, {EDITED}")
