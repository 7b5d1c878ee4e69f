"""Quality scores of texts by a generalised additive model with pairwise interactions.

A text becomes a few measured features.  The model is one lookup table per
feature and per chosen pair of features, over bins of their values; a score is a
sum of lookups.  The tables are learned by cyclic boosting: shallow trees on one
feature, or one pair, at a time, each on what the others leave unexplained.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tagloom.staging import stage, stage_sized

FEATURES = (
    "log_chars", "log_words", "word_chars", "upper", "digits", "symbols", "shouts", "stops", "symbol_ends", "capitalised",
    "repeated_neighbours", "distinct_words", "commonest_word", "line_words", "longest_word", "doubled_chars",
)
TEXT_BYTES = 4 << 20
BINS, PAIR_BINS = 64, 16
SHRINK = 5.0
STEEPEST = 4.0


def _class_of_bytes():
    kinds = {name: np.zeros(256, bool) for name in ("blank", "upper", "letter", "digit", "stop", "shout", "symbol", "lead")}
    codes = np.arange(256)
    kinds["blank"][list(b" \t\n\x0b\x0c\r")] = True
    kinds["upper"][65:91] = True
    kinds["letter"][65:91] = kinds["letter"][97:123] = kinds["letter"][0xC0:] = True
    kinds["digit"][48:58] = True
    kinds["stop"][list(b".,;:")] = True
    kinds["shout"][list(b"!?")] = True
    kinds["lead"] = (codes & 0xC0) != 0x80
    kinds["symbol"] = (codes > 32) & (codes < 127) & ~(kinds["letter"] | kinds["digit"] | kinds["stop"] | kinds["shout"])
    return kinds


CLASSES = _class_of_bytes()


def _counts(marked, offsets):
    """How many marked bytes each text has."""
    total = np.r_[0, np.cumsum(marked)]
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _share(part, whole):
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def features(data, offsets):
    """One row of FEATURES for each of the joined byte texts."""
    texts = len(offsets) - 1
    count = {name: _counts(kind[data], offsets) for name, kind in CLASSES.items()}
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    doubled = np.zeros(len(data), bool)
    doubled[1:] = (data[1:] == data[:-1]) & ~edge[1:-1]
    inside = ~CLASSES["blank"][data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(owner, minlength=texts).astype(np.float64)
    bounds = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    kinds, times = np.unique(owner.astype(np.int64) << 32 | codes, return_counts=True)
    distinct = np.bincount(kinds >> 32, minlength=texts)
    commonest, longest = np.zeros(texts), np.zeros(texts)
    np.maximum.at(commonest, kinds >> 32, times)
    np.maximum.at(longest, owner, ends - starts)
    by_word = lambda marked: np.bincount(owner, weights=marked, minlength=texts)
    chars = count["lead"]
    lines = _counts(data == 10, offsets) + 1
    return np.column_stack([
        np.log2(1 + chars), np.log2(1 + words), _share(chars - count["blank"], words), _share(count["upper"], count["letter"]),
        _share(count["digit"], chars), _share(count["symbol"], chars), _share(count["shout"], chars), _share(count["stop"], chars),
        _share(by_word(CLASSES["symbol"][data[ends - 1]] | CLASSES["shout"][data[ends - 1]]), words),
        _share(by_word(CLASSES["upper"][data[starts]]), words), _share(by_word(again), words), _share(distinct, words),
        _share(commonest, words), words / lines, np.log2(1 + longest), _share(_counts(doubled, offsets), chars),
    ])


def measured(column):
    """The features of an Arrow column of byte texts, a bounded stretch of texts at a time."""
    column = column.cast(pa.binary())
    cuts = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64)) // TEXT_BYTES
    edges = np.r_[0, np.flatnonzero(np.diff(cuts)) + 1, len(cuts)]
    out = [np.zeros((0, len(FEATURES)))]
    for low, high in zip(edges[:-1], edges[1:]):
        part = column.slice(low, high - low)
        if not len(part):
            continue
        offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        body = part.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        out.append(features(data, offsets - offsets[0]))
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    """Bin borders by feature, fine and coarse, lookup tables, and the feature pairs with tables of their own."""

    base: float
    cuts: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def score(self, values):
        """Log-odds of rows of features."""
        total = np.full(len(values), self.base)
        for cuts, table, column in zip(self.cuts, self.tables, values.T):
            total += table[np.searchsorted(cuts, column, side="right")]
        if self.pairs:
            bins = binned(values, self.coarse)
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[bins[i], bins[j]]
        return total


def binned(values, cuts):
    """By feature, the bin of each row."""
    return [np.searchsorted(c, column, side="right") for c, column in zip(cuts, values.T)]


def _gain(g, h):
    return g * g / (h + SHRINK)


def _leaf(g, h):
    return np.clip(g / (h + SHRINK), -STEEPEST, STEEPEST)


def _cut(g, h):
    """The best place to cut a row of bins in two, or None."""
    if len(g) < 2:
        return None
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(gains.argmax())
    return at + 1 if gains[at] > 1e-9 else None


def tree(g, h, depth=2):
    """Values of the bins under a tree of cuts, from their gradient and curvature sums."""
    at = _cut(g, h) if depth else None
    if at is None:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.r_[tree(g[:at], h[:at], depth - 1), tree(g[at:], h[at:], depth - 1)]


def pair_tree(g, h):
    """(values, gain) of a tree that cuts one feature, and the other on either side, whichever order is better."""
    best = None
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        if len(a) < 2:
            continue
        up_g, up_h = np.cumsum(a, axis=0)[:-1], np.cumsum(b, axis=0)[:-1]
        total = np.zeros(len(a) - 1)
        for side_g, side_h in ((up_g, up_h), (a.sum(axis=0) - up_g, b.sum(axis=0) - up_h)):
            left_g, left_h = np.cumsum(side_g, axis=1), np.cumsum(side_h, axis=1)
            all_g, all_h = left_g[:, -1:], left_h[:, -1:]
            total += (_gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h)).max(axis=1)
        at = int(total.argmax())
        if best is None or total[at] > best[1] + 1e-9:
            rows = [np.tile(tree(a[s].sum(axis=0), b[s].sum(axis=0), 1), (len(a[s]), 1)) for s in (slice(0, at + 1), slice(at + 1, None))]
            values = np.concatenate(rows)
            best = (values.T if turned else values, float(total[at]))
    if best is None:
        return np.full(g.shape, _leaf(g.sum(), h.sum())), 0.0
    return best[0], best[1] - float(_gain(g.sum(), h.sum()))


def _sums(bins, size, g, h):
    return np.bincount(bins, g, size), np.bincount(bins, h, size)


def boost(values, labels, weights, cuts, coarse, pairs, rounds, rate):
    """(base, tables, pair tables, gains of all pairs on what the tables leave) by cyclic boosting."""
    ones = float((weights * labels).sum())
    base = np.log((ones + 0.5) / (weights.sum() - ones + 0.5))
    sizes, coarse_sizes = [len(c) + 1 for c in cuts], [len(c) + 1 for c in coarse]
    bins, coarse_bins = binned(values, cuts), binned(values, coarse)
    tables = [np.zeros(s) for s in sizes]
    flat = [coarse_bins[i] * coarse_sizes[j] + coarse_bins[j] for i, j in pairs]
    shapes = [(coarse_sizes[i], coarse_sizes[j]) for i, j in pairs]
    pair_tables = [np.zeros(s) for s in shapes]
    score = np.full(len(values), base)

    def slopes():
        p = 1 / (1 + np.exp(-score))
        return weights * (labels - p), weights * p * (1 - p)

    if 0 < ones < weights.sum():
        for _ in range(rounds):
            for at, size in enumerate(sizes):
                step = rate * tree(*_sums(bins[at], size, *slopes()))
                tables[at] += step
                score += step[bins[at]]
        for _ in range(rounds if pairs else 0):
            for at, shape in enumerate(shapes):
                g, h = (s.reshape(shape) for s in _sums(flat[at], shape[0] * shape[1], *slopes()))
                step = rate * pair_tree(g, h)[0]
                pair_tables[at] += step
                score += step.reshape(-1)[flat[at]]
    gains = {}
    g, h = slopes()
    for i in range(len(coarse)):
        for j in range(i + 1, len(coarse)):
            shape = (coarse_sizes[i], coarse_sizes[j])
            sums = _sums(coarse_bins[i] * shape[1] + coarse_bins[j], shape[0] * shape[1], g, h)
            gains[i, j] = pair_tree(*(s.reshape(shape) for s in sums))[1]
    return base, tables, pair_tables, gains


def _rows(group):
    """Rows of a bounded group in an order that does not depend on how they came."""
    group = group.sort_values(["key", "mark", "label"], kind="stable")
    return np.stack(group["values"].to_numpy()), group["label"].to_numpy(np.float64)


def fit(docs, labels, text_col="text", key_col="doc_id", label_col="quality", fit_rows=20_000, bags=8, pairs=6, rounds=120, rate=0.15):
    """Learn from the documents whose key has a label of 0 or 1.

    The model is fitted on a bounded sample of about ``fit_rows`` labelled
    rows, drawn by a hash of the key; repeated rows count once, and a key with
    both labels has both.  ``pairs`` feature pairs are chosen by their gain on
    what all single features leave.  Then ``bags`` models are boosted, each in a
    task of its own on a resample, and their tables averaged.

    Null keys are not learned from, null texts are empty ones.  With a single
    class the model is its smoothed share, without labels every score is 0.5.
    """
    known = labels.select(F.col(key_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isin(0, 1)).distinct()
    draw = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    count = known.count()
    # about fit_rows keys, so the broadcast is bounded
    drawn = stage_sized(known.where(draw("key") < fit_rows / max(count, 1)), "labels").df
    texts = docs.select(F.col(key_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "key").select("key", F.xxhash64("text").alias("mark"), "label", F.col("text").cast("binary").alias("text"))

    def measure(batches):
        for batch in batches:
            values = pa.array(list(measured(batch.column("text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("mark"), batch.column("label"), values], names=["key", "mark", "label", "values"])

    found = stage(rows.mapInArrow(measure, "key long, mark long, label int, values array<double>").dropDuplicates(["key", "mark", "label"]), "measured")
    size = found.count()
    sample = stage(found.where(draw("mark", "key") < fit_rows / max(size, 1)), "sample") if size > fit_rows else found
    shares = lambda n: [i / n for i in range(1, n)]
    borders = sample.agg(
        *(F.percentile(F.col("values")[i], F.array(*(F.lit(s) for s in shares(n)))).alias(f"{kind}{i}")
          for i in range(len(FEATURES)) for kind, n in (("fine", BINS), ("coarse", PAIR_BINS)))
    ).first()
    if not size:
        return Model(0.0)
    cuts = [np.unique(borders[f"fine{i}"]) for i in range(len(FEATURES))]
    coarse = [np.unique(borders[f"coarse{i}"]) for i in range(len(FEATURES))]

    def rank(group):
        values, truth = _rows(group)
        gains = boost(values, truth, np.ones(len(truth)), cuts, coarse, [], rounds, rate)[3]
        best = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
        return pd.DataFrame([(i, j) for i, j in best if gains[i, j] > 0], columns=["i", "j"])

    ranked = sample.withColumn("bag", F.lit(0)).groupBy("bag").applyInPandas(rank, "i int, j int")
    chosen = sorted((r["i"], r["j"]) for r in ranked.collect())

    def learn(group):
        values, truth = _rows(group)
        weights = np.random.default_rng(int(group["bag"].iloc[0])).poisson(1.0, len(truth)).astype(np.float64)
        base, tables, pair_tables, _ = boost(values, truth, weights, cuts, coarse, chosen, rounds, rate)
        flat = [np.array([base]), *tables, *(t.reshape(-1) for t in pair_tables)]
        return pd.DataFrame({
            "term": np.repeat(np.arange(len(flat), dtype=np.int32), [len(t) for t in flat]),
            "place": np.concatenate([np.arange(len(t), dtype=np.int32) for t in flat]), "value": np.concatenate(flat),
        })

    bagged = sample.withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(bags)))).groupBy("bag").applyInPandas(learn, "term int, place int, value double")
    means = bagged.groupBy("term", "place").agg(F.avg("value").alias("value")).orderBy("term", "place").toPandas()
    terms = [group["value"].to_numpy() for _, group in means.groupby("term")]
    shapes = [(len(coarse[i]) + 1, len(coarse[j]) + 1) for i, j in chosen]
    tables = terms[1 : 1 + len(FEATURES)]
    return Model(float(terms[0][0]), cuts, tables, coarse, chosen, [t.reshape(s) for t, s in zip(terms[1 + len(FEATURES) :], shapes)])


def rated(docs, model, id_col="doc_id", text_col="text"):
    """(id, score) of every row: the probability of label 1.

    Null texts count as empty, and empty ones have a score like any other.
    Repeated rows have equal scores; a text has to fit into a task.  Only the id
    and the text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def score(batches):
        for batch in batches:
            odds = shared.value.score(measured(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-odds)))], names=["id", "score"])

    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")
