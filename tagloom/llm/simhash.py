"""SimHash fingerprints and near-duplicate groups by pigeonring filtering."""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tagloom.llm.common import without
from tagloom.llm.components import components
from tagloom.staging import stage

BITS = 64
SLICE = 1 << 16


def shingle_hashes(text, width):
    """XXH64 (seed 42) of each ``width``-word shingle of a UTF-8 text, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and white space is \\x20 and \\x09-\\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[i:j], 42) for i, j in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts)
    )


def fingerprint_array(texts, width):
    """Signed 64-bit fingerprints of a list of byte strings; no words give 0."""
    hashes = [shingle_hashes(t, width) if t else np.zeros(0, np.uint64) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(texts), BITS), np.int64)
    if sizes.sum():
        flat = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        for at in range(0, len(flat), SLICE):  # bits of a slice only: 4 MB, however long a text is
            part, own = flat[at : at + SLICE], owner[at : at + SLICE]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    majority = counts * 2 > sizes[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view(np.int64).ravel()


def fingerprint_udf(width):
    @F.pandas_udf("long")
    def fingerprint(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text), np.int64)
        step = 512
        for at in range(0, len(text), step):
            part = [None if t is None else t.encode() for t in text.iloc[at : at + step]]
            out[at : at + step] = fingerprint_array(part, width)
        return pd.Series(out)

    return fingerprint


def _signed(mask):
    return mask - (1 << 64) if mask >> 63 else mask


class Ring:
    """Segments of a fingerprint in a ring, and what a chain of them may differ by.

    Two fingerprints within ``max_bits`` have a segment from which every chain
    of l consecutive segments differs by at most ``l * max_bits / segments``.
    The first ``fixed`` segments of such a chain are therefore equal; they are
    the lookup key of that starting point.
    """

    def __init__(self, max_bits, segments):
        if not 0 <= max_bits < segments:
            raise ValueError("a ring needs more segments than bits that may differ")
        edges = [BITS * i // segments for i in range(segments + 1)]
        masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(segments)]
        self.max_bits, self.segments = max_bits, segments
        self.fixed = max(n for n in range(1, segments + 1) if n * max_bits // segments == 0)
        self.chains = [
            [sum(masks[(s + i) % segments] for i in range(n)) for n in range(1, segments + 1)] for s in range(segments)
        ]

    def key_mask(self, start):
        return self.chains[start][self.fixed - 1]

    def within_budget(self, start, differing):
        """Every longer chain from ``start``, the whole ring last, keeps its budget."""
        checks = [
            F.bit_count(differing.bitwiseAND(F.lit(_signed(mask)))) <= n * self.max_bits // self.segments
            for n, mask in enumerate(self.chains[start], 1) if n > self.fixed
        ]
        out = F.lit(True)
        for check in checks:
            out = out & check
        return out

    def near_keys(self, start, radius):
        """(bits to flip, how many) outside the key of ``start``, up to ``radius`` bits."""
        free = [1 << i for i in range(BITS) if not self.key_mask(start) >> i & 1]
        return [(_signed(sum(c)), n) for n in range(radius + 1) for c in combinations(free, n)]


def links(fingerprints, max_bits=2, segments=5, bucket_rows=64):
    """Links (a, b) that connect all distinct fingerprints within ``max_bits``.

    ``fingerprints`` has one distinct long column ``fp``.  Rows meet on the key
    of each starting point; chains over their budget are pruned before the last
    chain, which is the full Hamming check.  In a bucket of at most
    ``bucket_rows`` every pair within the distance is returned.  A fuller bucket
    is not paired: its members are grouped by the fingerprints near them, and
    each group, whose members are all within the distance of its centre, gives
    a star.  Stars lose no connection, and grow as the bucket, not as its square.
    """
    ring = Ring(max_bits, segments)
    starts = F.explode(
        F.array(*(
            F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(ring.key_mask(s)))).alias("key"))
            for s in range(segments)
        ))
    ).alias("k")
    keys = stage(fingerprints.select("fp", starts).select("fp", "k.start", "k.key"), "ring")
    full = stage(
        keys.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
        .select("start", "key"), "full",
    )
    small = keys.join(full, ["start", "key"], "left_anti")
    differing = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    budget = F.lit(False)
    for s in range(segments):
        budget = budget | ((F.col("l.start") == s) & ring.within_budget(s, differing))
    pairs = small.alias("l").join(
        small.alias("r"),
        (F.col("l.start") == F.col("r.start")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & budget,
    ).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))

    outer, inner = max_bits - max_bits // 2, max_bits // 2
    flips = keys.sparkSession.createDataFrame(
        [(s, flip, n) for s in range(segments) for flip, n in ring.near_keys(s, outer)], "start int, flip long, n int"
    )
    crowded = keys.join(full, ["start", "key"], "left_semi").join(F.broadcast(flips), "start")
    near = crowded.select("start", "key", "fp", "n", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    centre = near.where(F.col("n") <= inner).groupBy("start", "key", "near").agg(F.min("fp").alias("b"))
    stars = near.join(centre, ["start", "key", "near"]).where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.union(stars)


def near_duplicates(docs, id_col="doc_id", text_col="text", shingle=3, max_bits=2, segments=5, bucket_rows=64):
    """(id, mark, fp, component, first) of every row; ``mark`` is a hash of the text.

    The text is read once, for its fingerprint; equal fingerprints are one node
    whatever the size of their group.  ``component`` is the smallest id among
    fingerprints linked directly or through others; ``first`` is true for the
    rows of that id with the least mark.

    Null and blank texts have fingerprint 0 and link as any other.  Rows with a
    null id link too and never name a component; a component of such rows only
    is null.  Repeated rows give repeated rows.  Other columns are not read.
    """
    rows = stage(
        docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), fingerprint_udf(shingle)(F.col(text_col)).alias("fp")),
        "fingerprints",
    )
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("least")
    nodes = stage(rows.groupBy("fp").agg(least), "nodes")
    found = components(links(nodes.select("fp"), max_bits, segments, bucket_rows))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("top")), "root").select("fp", "top")
    first = F.col("id").eqNullSafe(F.col("top.id")) & (F.col("mark") == F.col("top.mark"))
    return rows.join(named, "fp").select("id", "mark", "fp", F.col("top.id").alias("component"), first.alias("first"))


def one_of_each(docs, id_col="doc_id", text_col="text", **options):
    """``docs`` with one row of each near-duplicate group: that of the smallest id, nulls last."""
    found = stage(near_duplicates(docs, id_col, text_col, **options), "groups")
    kept = without(docs, found.where(~F.col("first")), id_col, text_col)
    repeated = stage(found.where("first").groupBy("id", "mark").count().where("count > 1").select("id", "mark"), "repeated")
    if repeated.isEmpty():
        return kept
    # rows that repeat both id and text: one of them, by a hash of all columns
    alone = without(kept, repeated, id_col, text_col)
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = without(kept, found.join(repeated, ["id", "mark"], "left_anti"), id_col, text_col)
    one = again.groupBy(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_mark")).agg(F.min_by(every, F.xxhash64(every)).alias("_row"))
    return alone.unionByName(one.select("_row.*"))


def hex16(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))

