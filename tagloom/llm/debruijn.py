"""Repeated word spans across documents, by compacting a De Bruijn graph of word windows.

A window of k words is an edge from its first k - 1 words to its last.  Windows
are dealt to partitions by their minimizer, the least hash of the short shingles
inside, so neighbouring windows mostly stay together and equal windows always
do.  A bucket with over twice the windows aimed at is dealt again by the hash of
the whole window, where equal windows still meet.  A partition finds the edges
that repeat across documents, names each by the coordinates of its first
occurrence, and compacts stretches that follow the same source without a branch.
Stretches are glued across partitions, and the words at both coordinates are
compared before anything is removed.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import fresh, in_slices
from tagloom.staging import stage

BYTES_AT_ONCE = 8 << 20
SHINGLE = 4
PACKED = "bucket int, kind int, docs binary, marks binary, starts binary, sizes binary, first binary, second binary, src_docs binary, src_marks binary, src_starts binary"
SPANS = "doc long, mark long, pos int, size int, src_doc long, src_mark long, src_pos int"
ARRAYS = ("docs", "marks", "starts", "sizes", "src_docs", "src_marks", "src_starts")


def pack(values):
    """Whole numbers as their least, and the distances from it in as few bytes as hold them."""
    values = np.asarray(values, np.int64)
    least = values.min() if len(values) else np.int64(0)
    away = (values - least).view(np.uint64)
    most = int(away.max()) if len(values) else 0
    width = next(w for w in (0, 1, 2, 4, 8) if most < 1 << 8 * w)
    body = away.astype(f"u{width}").tobytes() if width else np.uint64(len(values)).tobytes()
    return bytes([width]) + np.int64(least).tobytes() + body


def unpack(raw):
    width, least = raw[0], np.frombuffer(raw, np.int64, 1, 1)[0]
    if not width:
        return np.full(int(np.frombuffer(raw, np.uint64, 1, 9)[0]), least)
    return np.frombuffer(raw, f"u{width}", -1, 9).astype(np.uint64).view(np.int64) + least


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sequence_hash(words, k, seed):
    """A hash of each ``k`` neighbouring word hashes."""
    factors = _mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
    count = len(words) - k + 1
    out = np.zeros(count, np.uint64)
    for j, factor in enumerate(factors):
        out += words[j : j + count] * factor
    return _mix(out)


def _sliding_min(values, n):
    """The least of each ``n`` neighbours, by doubling."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = n - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def windows(texts, k, seed, hashes=True):
    """(text number, position, hash, second hash, minimizer) of all windows of a list of byte texts.

    Both hashes are empty unless ``hashes``.
    """
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    total = int(sizes.sum())
    empty = np.zeros(0, np.uint64)
    if total < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), empty, empty, empty
    digest = xxhash.xxh64_intdigest
    words = np.fromiter((digest(w) for one in split for w in one), np.uint64, total)
    del split
    first = _sequence_hash(words, k, seed) if hashes else None
    second = _sequence_hash(words, k, seed + 0x5DEECE66D) if hashes else None
    shingle = min(SHINGLE, k)
    minimizer = _sliding_min(_sequence_hash(words, shingle, 7), k - shingle + 1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: total - k + 1]
    place = np.arange(total - k + 1)
    inside = place + k <= ends[owner]
    if not hashes:
        return owner[inside], (place - (ends - sizes)[owner])[inside], empty, empty, minimizer[inside]
    return owner[inside], (place - (ends - sizes)[owner])[inside], first[inside], second[inside], minimizer[inside]


def _stretches(*consecutive):
    """Start indexes of runs in which each array goes on by its step: (values, step) pairs."""
    n = len(consecutive[0][0])
    breaks = np.zeros(n, bool)
    if n:
        breaks[0] = True
        for values, step in consecutive:
            breaks[1:] |= values[1:] != values[:-1] + step
    return np.flatnonzero(breaks)


def _compact(doc, mark, pos, src_doc, src_mark, src_pos):
    """Windows in document order to spans: runs that follow one source word by word."""
    heads = _stretches((doc, 0), (mark, 0), (pos, 1), (src_doc, 0), (src_mark, 0), (src_pos, 1))
    sizes = np.diff(np.r_[heads, len(doc)])
    return doc[heads], mark[heads], pos[heads], sizes, src_doc[heads], src_mark[heads], src_pos[heads]


def _slices(batch):
    """The rows of a batch by about BYTES_AT_ONCE of text."""
    part = batch["text"].str.len().cumsum().to_numpy() // BYTES_AT_ONCE
    for low in np.unique(part):
        yield batch[part == low]


def _counter(k, buckets, seed):
    """(bucket, n): windows of the documents of a task by bucket, as the mapper deals them at first."""

    def run(batches):
        for batch in batches:
            for frame in _slices(batch):
                minimizer = windows(frame["text"].tolist(), k, seed, hashes=False)[4]
                bucket, n = np.unique((_mix(minimizer) % np.uint64(buckets)).astype(np.int64), return_counts=True)
                yield pd.DataFrame({"bucket": bucket, "n": n})

    return run


def hot_buckets(keyed, k, buckets, seed, windows_per_bucket):
    """Bucket → parts of about ``windows_per_bucket`` windows, of buckets with over twice as many."""
    counted = keyed.select("text").mapInPandas(_counter(k, buckets, seed), "bucket long, n long")
    hot = counted.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * windows_per_bucket)
    return {r["bucket"]: -(-r["n"] // windows_per_bucket) for r in hot.collect()}


def _mapper(k, deal, seed, wide, bits):
    """Windows of the documents of a task, packed by bucket.

    ``deal`` is the number of buckets and the parts of hot ones, which are dealt to
    as many buckets of their own, after all others, by the hash of the whole window.

    Windows that repeat within a batch are settled there: of equal ones only
    those of the smallest document go on, so a window that very many documents
    share reaches its bucket once per batch.
    """

    buckets, hot = deal
    split = np.zeros(buckets, np.int64)
    for b, parts in hot.items():
        split[b] = parts
    moved = buckets + np.cumsum(split) - split  # the first part of a hot bucket

    def settle(frame):
        frame = frame.sort_values(["doc", "mark"], kind="stable")
        docs, marks = frame["doc"].to_numpy(np.int64), frame["mark"].to_numpy(np.int64)
        owner, pos, first, second, minimizer = windows(frame["text"].tolist(), k, seed)
        first >>= np.uint64(64 - bits)
        second = second if wide else np.zeros_like(second)
        order = np.lexsort((np.arange(len(first)), second, first))
        heads = np.r_[True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])] if len(order) else np.zeros(0, bool)
        source = np.empty(len(order), np.int64)
        source[order] = order[np.flatnonzero(heads)][np.cumsum(heads) - 1] if len(order) else 0
        later = docs[owner] > docs[owner[source]]
        out = {name: [] for name in ("bucket", "kind", *ARRAYS[:4], "first", "second", *ARRAYS[4:])}

        def put(bucket, kind, arrays, first=b"", second=b""):
            for name, value in zip(("bucket", "kind", "first", "second"), (bucket, kind, first, second)):
                out[name].append(value)
            for name, values in zip(ARRAYS, [*arrays, *[np.zeros(0, np.int64)] * 7]):
                out[name].append(pack(values))

        if later.any():
            here, there = owner[later], owner[source[later]]
            spans = _compact(docs[here], marks[here], pos[later], docs[there], marks[there], pos[source[later]])
            put(int(docs[here[0]] % buckets), 1, spans)
        open_ = np.flatnonzero(~later)
        bucket = (_mix(minimizer[open_]) % np.uint64(buckets)).astype(np.int64)
        if hot:
            parts = split[bucket]
            part = (_mix(first[open_]) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
            bucket = np.where(parts > 0, moved[bucket] + part, bucket)
        order = np.argsort(bucket, kind="stable")
        open_, bucket = open_[order], bucket[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(open_) else [0]
        for low, high in zip(edges[:-1], edges[1:]):
            part = open_[low:high]
            heads = _stretches((owner[part], 0), (pos[part], 1))
            lead = part[heads]
            sizes = np.diff(np.r_[heads, len(part)])
            extra = second[part].view(np.uint8).reshape(-1, 8)[:, :wide].tobytes() if wide else b""
            put(int(bucket[low]), 0, (docs[owner[lead]], marks[owner[lead]], pos[lead], sizes), first[part].tobytes(), extra)
        return pd.DataFrame(out)

    def run(batches):
        for batch in batches:
            yield from map(settle, _slices(batch))

    return run


def _reducer(wide):
    """The windows of one bucket to spans of those that also start in a smaller document."""

    def repeated(group):
        columns = [[unpack(v) for v in group.loc[group["kind"] == 1, name]] for name in ARRAYS]
        spans = [tuple(np.concatenate(c) for c in columns)] if columns[0] else []
        fresh_ = group[group["kind"] == 0]
        if len(fresh_):
            doc, mark, start, size = (np.concatenate([unpack(v) for v in fresh_[name]]) for name in ARRAYS[:4])
            first = np.frombuffer(b"".join(fresh_["first"]), np.uint64)
            offset = np.cumsum(size) - size
            order = np.lexsort((start, mark, doc))  # runs in document order, then their windows
            within = np.arange(len(first)) - np.repeat(np.cumsum(size[order]) - size[order], size[order])
            at = np.repeat(offset[order], size[order]) + within
            first = first[at]
            doc, mark, pos = (np.repeat(v[order], size[order]) for v in (doc, mark, start))
            pos = pos + within
            if wide:
                second = np.frombuffer(b"".join(fresh_["second"]), np.uint8).reshape(-1, wide)[at]
                second = np.pad(second, ((0, 0), (0, 8 - wide))).view(np.uint64).ravel()
                by = np.lexsort((second, first))
                new = (first[by][1:] != first[by][:-1]) | (second[by][1:] != second[by][:-1])
            else:
                by = np.argsort(first, kind="stable")
                new = first[by][1:] != first[by][:-1]
            heads = np.r_[True, new]
            source = np.empty(len(by), np.int64)
            source[by] = by[np.flatnonzero(heads)][np.cumsum(heads) - 1]
            later = doc > doc[source]
            there = source[later]
            spans.append(_compact(doc[later], mark[later], pos[later], doc[there], mark[there], pos[there]))
        names = ("doc", "mark", "pos", "size", "src_doc", "src_mark", "src_pos")
        return pd.concat([pd.DataFrame(dict(zip(names, s))) for s in spans]) if spans else pd.DataFrame({n: [] for n in names})

    return repeated


def _glue(batches):
    """Sorted spans to longer ones where the next goes on in the same source."""
    for batch in batches:
        doc, mark, pos, size, src_doc, src_mark, src_pos = (batch[c].to_numpy(np.int64) for c in batch.columns)
        breaks = np.ones(len(doc), bool)
        same = (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (src_doc[1:] == src_doc[:-1]) & (src_mark[1:] == src_mark[:-1])
        breaks[1:] = ~(same & (pos[1:] == pos[:-1] + size[:-1]) & (src_pos[1:] == src_pos[:-1] + size[:-1]))
        heads = np.flatnonzero(breaks)
        out = batch.iloc[heads].copy()
        out["size"] = np.add.reduceat(size, heads) if len(heads) else size
        yield out


def _digests(k):
    def run(batches):
        for batch in batches:
            out = []
            for doc, mark, text, asked in batch.itertuples(index=False):
                words = text.split()
                for one in asked:
                    pos, size = one["pos"], one["size"]
                    digest = xxhash.xxh3_128_digest(b" ".join(words[pos : pos + size + k - 1]))
                    out.append((doc, mark, pos, size, digest))
            yield pd.DataFrame(out, columns=["doc", "mark", "pos", "size", "digest"])

    return run


def _lists(spans):
    return spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("pos", "size")).alias("spans"))


def repeated_spans(keyed, k=13, seed=42, windows_per_bucket=1_000_000, bits=64):
    """(doc, mark, pos, size, src_doc, src_mark, src_pos): ``size`` windows that start in a smaller document too.

    ``keyed`` has doc, mark and binary text.  Source coordinates are checked
    word for word by 128-bit digests of both texts; should different windows
    have had one hash, the search is run again under another seed and with more
    bits.  ``bits`` are those of the first try.
    """
    spark = keyed.sparkSession
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, size // 6)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), count // windows_per_bucket)
    # so many hash bits that a pair of different windows with one hash is unlikely in the whole corpus
    wide = max(0, -(-(2 * count.bit_length() + 8 - 64) // 8))
    hot = hot_buckets(keyed, k, buckets, seed, windows_per_bucket)  # minimizers do not depend on the seed
    while True:
        spans = (
            keyed.mapInPandas(_mapper(k, (buckets, hot), seed, wide, bits), PACKED)
            .groupBy("bucket").applyInPandas(_reducer(wide), SPANS)
        )
        paths = stage(
            spans.repartition("doc", "mark").sortWithinPartitions("doc", "mark", "pos").mapInPandas(_glue, SPANS), "paths"
        )
        here = paths.select("doc", "mark", "pos", "size")
        there = paths.select(F.col("src_doc").alias("doc"), F.col("src_mark").alias("mark"), F.col("src_pos").alias("pos"), "size")
        asked = keyed.join(_lists(here.union(there)), ["doc", "mark"])
        digests = stage(
            asked.select("doc", "mark", "text", "spans").mapInPandas(_digests(k), "doc long, mark long, pos int, size int, digest binary"),
            "digests",
        ).distinct()
        source = digests.toDF("src_doc", "src_mark", "src_pos", "size", "src_digest")
        checked = paths.join(digests, ["doc", "mark", "pos", "size"], "left").join(source, ["src_doc", "src_mark", "src_pos", "size"], "left")
        wrong = checked.where(~F.coalesce(F.col("digest") == F.col("src_digest"), F.lit(False)))
        if wrong.isEmpty():
            return paths
        seed, wide, bits = seed + 1, min(8, wide + 2), 64


def remove_repeats(docs, id_col="doc_id", text_col="text", k=13, out_col="kept", windows_per_bucket=1_000_000):
    """``docs`` with n_words, n_removed and the kept words, joined by one space.

    A word goes if a window of ``k`` words that covers it also starts in a
    document with a smaller id; windows are judged on the input.

    Null and empty texts have no words.  Rows with a null id lose nothing and
    take nothing from others.  Rows of one id are one document as to order, each
    judged on its own text.  Other columns stay.
    """
    doc, mark, spans, again, n_words, n_removed, out_col = fresh(docs, "_doc", "_mark", "_spans", "_again", "n_words", "n_removed", out_col)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    many = stage(docs.groupBy(F.col(id_col).cast("long").alias(doc)).count().where("count > 1").select(doc), "many")
    base = docs.withColumn(doc, F.col(id_col).cast("long"))
    if many.isEmpty():
        base = base.withColumn(mark, F.lit(0).cast("long"))
    else:
        base = base.join(many.withColumn(again, F.lit(True)), doc, "left")
        base = base.withColumn(mark, F.when(F.col(again), F.xxhash64(raw)).otherwise(F.lit(0))).drop(again)
    keyed = base.select(F.col(doc).alias("doc"), F.col(mark).alias("mark"), raw.alias("text")).where("doc is not null")
    if not many.isEmpty():
        keyed = keyed.distinct()
    paths = repeated_spans(keyed, k, windows_per_bucket=windows_per_bucket)
    lists = stage(_lists(paths.select("doc", "mark", "pos", "size")), "lists")
    joined = base.join(lists.toDF(doc, mark, spans), [doc, mark], "left")

    width, at = len(docs.columns), docs.columns.index(text_col)
    fields = [*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType()), T.StructField(out_col, T.StringType())]

    def cut(part):
        """The columns of the documents, and what is left of their words."""
        totals, removed, left = [], [], []
        for text, found in zip(part.column(at).cast(pa.binary()).to_pylist(), part.column(width).to_pylist()):
            words = text.split() if text else []
            kept = words
            if found:
                gone = np.zeros(len(words) + 1, np.int64)
                for span in found:
                    gone[span["pos"]] += 1
                    gone[span["pos"] + span["size"] + k - 1] -= 1
                kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            totals.append(len(words))
            removed.append(len(words) - len(kept))
            left.append(b" ".join(kept))
        return [
            *part.columns[:width], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string()),
        ]

    return in_slices(joined.select(*(F.col(f"`{c}`") for c in docs.columns), spans), fields, cut)
