"""Hard negatives of anchor vectors by angular triangle filtering.

Every row keeps its integer vector, its norm and its angles to a few reference
directions.  The table is written in the order of label, nearest reference and
angle, so neighbouring rows have like angles.  For an anchor and a block of such
rows the triangle inequality of angles gives an interval of cosines; times the
norms, and widened by more than rounding can cost, it bounds all scores of the
block.  Only blocks whose bounds reach into the window asked for are scored, in
whole numbers.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.staging import stage

ROWS_PER_TASK = 65_536
CELLS_AT_ONCE = 1 << 22
ANGLE_SLACK = 1e-6
LEAST = -(1 << 63)
EXACT_DOUBLE = 1 << 53
LARGEST = 1 << 62

LAYOUT = "row long, id long, label long, anchor boolean, dim int, ints binary, norm double, angles binary, cell int, near double"


def whole(doubles, scale):
    """floor(scale * x) as whole numbers."""
    raw = np.floor(doubles * float(scale))
    if raw.size and np.abs(raw).max() >= LARGEST:
        raise OverflowError("components times the scale do not fit into whole numbers of 64 bits")
    return raw.astype(np.int64)


def norms(ints):
    return np.sqrt(np.square(ints.astype(np.float64)).sum(axis=1))


def angles(ints, lengths, references):
    """Angles of integer vectors to unit references; a zero vector stands at a right angle."""
    cosine = ints.astype(np.float64) @ references.T / np.where(lengths > 0, lengths, 1.0)[:, None]
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def spread_out(units, count):
    """Up to ``count`` of the unit rows, each the farthest from those before it."""
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(count, len(units)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, units @ units[at])
    return units[chosen]


def score_bounds(anchor_angles, anchor_norms, low, high, least_norm, most_norm):
    """(lower, upper) bounds of the scores of each anchor with all rows of a block.

    ``low`` and ``high`` hold the block's range of angles to each reference.
    """
    if anchor_angles.shape[1]:
        nearest = np.maximum(low - anchor_angles, anchor_angles - high).max(axis=1) - ANGLE_SLACK
        farthest = np.minimum(anchor_angles + high, 2 * np.pi - anchor_angles - low).min(axis=1) + ANGLE_SLACK
    else:
        nearest, farthest = np.zeros(len(anchor_norms)), np.full(len(anchor_norms), np.pi)
    best, worst = np.cos(np.clip(nearest, 0, np.pi)), np.cos(np.clip(farthest, 0, np.pi))
    slack = 1 + 1e-9 * anchor_norms * most_norm
    upper = anchor_norms * best * np.where(best > 0, most_norm, least_norm) + slack
    lower = anchor_norms * worst * np.where(worst > 0, least_norm, most_norm) - slack
    return lower, upper


def scores(left, right, limit):
    """Integer inner products; ``limit`` bounds their absolute sums."""
    if limit < EXACT_DOUBLE:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if limit >= LARGEST:
        raise OverflowError("scores do not fit into whole numbers of 64 bits")
    return left @ right.T


class Tops:
    """The first ``k`` rows of each query by score, then smaller id; ``cut`` is the score that a row must reach."""

    def __init__(self, queries, k):
        self.k, self.cut = k, np.full(queries, LEAST, np.int64)
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]
        self.waiting, self.size = [], 0

    def add(self, query, score, ids, rows):
        self.waiting.append((query, score, ids, rows))
        self.size += len(query)
        if self.size > max(len(self.kept[0]), 4096):
            self.settle()

    def settle(self):
        query, score, ids, rows = (np.concatenate(c) for c in zip(self.kept, *self.waiting))
        order = np.lexsort((rows, ids, -score, query))
        query, score, ids, rows = (a[order] for a in (query, score, ids, rows))
        heads = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(heads, np.diff(np.r_[heads, len(query)]))
        full = place == self.k - 1
        self.cut[query[full]] = score[full]
        self.kept = [a[place < self.k] for a in (query, score, ids, rows)]
        self.waiting, self.size = [], 0
        return self.kept


def _blocks(batch, rows_per_block):
    """Neighbouring rows of one length, with their arrays."""
    columns = {name: batch.column(name) for name in ("row", "id", "label", "dim", "norm")}
    data = {name: column.to_numpy() for name, column in columns.items()}
    ints, marks = batch.column("ints"), batch.column("angles")
    cuts = np.r_[0, np.flatnonzero(np.diff(data["dim"])) + 1, batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        for low in range(start, end, rows_per_block):
            high = min(low + rows_per_block, end)
            block = {name: values[low:high] for name, values in data.items()}
            block["ints"] = np.frombuffer(b"".join(ints[low:high].to_pylist()), np.int64).reshape(high - low, -1)
            block["angles"] = np.frombuffer(b"".join(marks[low:high].to_pylist()), np.float64).reshape(high - low, -1)
            yield int(data["dim"][low]), block


def _bounded(wave, block):
    low, high = block["angles"].min(axis=0), block["angles"].max(axis=0)
    return score_bounds(wave["angles"], wave["norm"], low, high, block["norm"].min(), block["norm"].max())


def _limit(wave, block):
    return float(wave["norm"].max()) * float(block["norm"].max()) * (1 + 1e-9)


def _partial(tops, wave_ids, names):
    """What a task found, one batch for each length of vectors."""
    for dim, one in tops.items():
        query, score, ids, rows = one.settle()
        key = wave_ids[dim][query]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (key, score, ids, rows)], names=names)


def find_positives(shared, k, rows_per_block):
    """Each task's first ``k`` rows of the anchor's label, for the anchors of a wave."""

    def run(batches):
        waves = shared.value
        tops = {dim: Tops(len(wave["row"]), k) for dim, wave in waves.items()}
        for batch in batches:
            for dim, block in _blocks(batch, rows_per_block):
                if dim not in waves:
                    continue
                wave, top = waves[dim], tops[dim]
                _, upper = _bounded(wave, block)
                chosen = np.flatnonzero(np.isin(wave["label"], block["label"]) & (upper >= top.cut))
                step = max(1, CELLS_AT_ONCE // len(block["row"]))
                for part in (chosen[i : i + step] for i in range(0, len(chosen), step)):
                    found = scores(wave["ints"][part], block["ints"], _limit(wave, block))
                    good = (wave["label"][part][:, None] == block["label"]) & (wave["row"][part][:, None] != block["row"])
                    i, j = np.nonzero(good & (found >= top.cut[part][:, None]))
                    top.add(part[i], found[i, j], block["id"][j], block["row"][j])
        yield from _partial(tops, {dim: wave["row"] for dim, wave in waves.items()}, ["anchor", "score", "id", "row"])

    return run


def find_negatives(shared, k, rows_per_block):
    """Each task's first ``k`` rows of other labels inside the window of each query of a wave."""

    def run(batches):
        waves = shared.value
        tops = {dim: Tops(len(wave["query"]), k) for dim, wave in waves.items()}
        for batch in batches:
            for dim, block in _blocks(batch, rows_per_block):
                if dim not in waves:
                    continue
                wave, top = waves[dim], tops[dim]
                lower, upper = _bounded(wave, block)
                at = wave["anchor_at"]
                floor = np.maximum(wave["low"], top.cut)
                other = np.array([(block["label"] != label).any() for label in wave["labels"]], bool)[wave["label_at"]]
                chosen = np.flatnonzero(other[at] & (upper[at] >= floor) & (lower[at] <= wave["high"]))
                step = max(1, CELLS_AT_ONCE // len(block["row"]))
                for part in (chosen[i : i + step] for i in range(0, len(chosen), step)):
                    anchors, which = np.unique(at[part], return_inverse=True)
                    found = scores(wave["ints"][anchors], block["ints"], _limit(wave, block))
                    apart = wave["label"][anchors][:, None] != block["label"]
                    found, apart = found[which], apart[which]
                    i, j = np.nonzero(apart & (found >= floor[part][:, None]) & (found <= wave["high"][part][:, None]))
                    top.add(part[i], found[i, j], block["id"][j], block["row"][j])
        yield from _partial(tops, {dim: wave["query"] for dim, wave in waves.items()}, ["query", "score", "id", "row"])

    return run


def layout(rows, anchor, id_col, vec_col, label_col, scale, references):
    """The usable rows in angular order, written once."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce((F.size(vec) > 0) & finite, F.lit(False))
    given = rows.where(usable).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vec.alias("vec")
    )
    given = stage(given.withColumn("row", F.monotonically_increasing_id()), "usable")
    # a bounded sample; references only shape the bounds, never the result
    sample = given.select("row", "vec").orderBy(F.xxhash64("row"), "row").limit(32 * references).collect()
    dims = [len(r["vec"]) for r in sample]
    main = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 0
    chosen = [r["vec"] for r in sample if len(r["vec"]) == main]
    ints = whole(np.array(chosen, np.float64).reshape(len(chosen), main), scale)
    lengths = norms(ints)
    units = ints[lengths > 0] / lengths[lengths > 0][:, None]
    directions = spread_out(units, references) if len(units) else np.zeros((0, main))

    def place(batches):
        for batch in batches:
            sizes = np.diff(batch.column("vec").offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                ints = whole(part.column("vec").flatten().to_numpy().reshape(-1, dim), scale)
                lengths = norms(ints)
                known = angles(ints, lengths, directions) if dim == main else np.zeros((len(ints), 0))
                some = known.shape[1] > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("row", "id", "label", "anchor")), pa.array(np.full(len(ints), dim, np.int32)),
                        pa.array([v.tobytes() for v in ints], pa.binary()), pa.array(lengths), pa.array([v.tobytes() for v in known], pa.binary()),
                        pa.array((known.argmin(axis=1) if some else np.zeros(len(ints))).astype(np.int32)),
                        pa.array(known.min(axis=1) if some else np.zeros(len(ints))),
                    ],
                    names=["row", "id", "label", "anchor", "dim", "ints", "norm", "angles", "cell", "near"],
                )

    order = ["dim", "label", "cell", "near", "id", "row"]
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-given.count() // ROWS_PER_TASK))
    return stage(given.mapInArrow(place, LAYOUT).repartitionByRange(tasks, *order).sortWithinPartitions(*order), "angular")


def _by_dim(table):
    """Anchors of a wave as arrays, for each length of vectors."""
    dims = table.column("dim").to_numpy()
    out = {}
    for dim in np.unique(dims).tolist():
        part = table.filter(pa.array(dims == dim))
        wave = {c: part.column(c).to_numpy() for c in ("row", "label", "norm")}
        wave["ints"] = np.frombuffer(b"".join(part.column("ints").to_pylist()), np.int64).reshape(part.num_rows, -1)
        wave["angles"] = np.frombuffer(b"".join(part.column("angles").to_pylist()), np.float64).reshape(part.num_rows, -1)
        out[dim] = wave
    return out


def _windows(waves, positives, low, high):
    """The waves with one query for each anchor and positive, and the scores its negatives may have."""
    anchor, place, score = (positives.column(c).to_numpy() for c in ("anchor", "place", "score"))
    hundreds, rest = np.divmod(score, 100)
    least, most = low * hundreds - (-low * rest // 100), high * hundreds + high * rest // 100  # no product is much over a score
    out = {}
    for dim, wave in waves.items():
        order = np.argsort(wave["row"])
        found = order[np.minimum(np.searchsorted(wave["row"][order], anchor), len(order) - 1)]
        mine = wave["row"][found] == anchor
        labels, label_at = np.unique(wave["label"], return_inverse=True)
        if mine.any():
            out[dim] = {
                **wave, "labels": labels, "label_at": label_at, "anchor_at": found[mine], "query": (anchor[mine] << 8) | place[mine],
                "low": least[mine], "high": most[mine],
            }
    return out


def _first(partial, keys, k, name):
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return partial.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(
    rows, anchor, id_col="vec_id", vec_col="embedding", label_col="label", scale=256, positives=5, negatives=10, low=30, high=90,
    references=16, anchors_at_once=16_384, rows_per_block=256,
):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the integer inner product.
    The positives of an anchor are its first ``positives`` (at most 255) other
    rows of the same label, highest score first, ties by smaller id.  For each,
    the first ``negatives`` rows of other labels with a score of ``low`` to
    ``high`` percent of the positive's are returned in the same order.  ``anchor``
    is a condition on the columns of ``rows``.

    Anchors are taken in waves of about ``anchors_at_once``; a wave is sent to
    the tasks, which read the table where it lies and return a few rows for each
    anchor.  Rows with a null id, label or vector, without components, or with a
    null or non-finite one take no part.  Vectors of different length are never
    compared.  Repeated rows are rows of their own, also as anchors.  A positive
    score below zero leaves an empty window.  Scores have to fit into 64 bits,
    else an error is raised.  Labels are whole numbers.  An empty table gives no
    rows; other columns are not read unless ``anchor`` does.
    """
    spark = rows.sparkSession
    table = layout(rows, anchor, id_col, vec_col, label_col, scale, references)
    anchors = stage(table.where("anchor").select("row", "id", "label", "dim", "ints", "norm", "angles"), "anchors")
    count = max(1, -(-anchors.count() // anchors_at_once))
    out = []
    for wave in range(count):
        taken = anchors.where(F.pmod(F.xxhash64("row"), F.lit(count)) == wave)
        waves = _by_dim(taken.toArrow())
        shared = spark.sparkContext.broadcast(waves)
        partial = table.mapInArrow(find_positives(shared, positives, rows_per_block), "anchor long, score long, id long, row long")
        best = stage(_first(partial, ["anchor"], positives, "place"), "positives")
        queries = spark.sparkContext.broadcast(_windows(waves, best.select("anchor", F.col("place").cast("long").alias("place"), "score").toArrow(), low, high))
        partial = table.mapInArrow(find_negatives(queries, negatives, rows_per_block), "query long, score long, id long, row long")
        found = _first(partial, ["query"], negatives, "rank")
        positive = best.select(
            F.shiftleft("anchor", 8).bitwiseOR(F.col("place").cast("long")).alias("query"), "anchor",
            F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        ).join(taken.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        named = found.select("query", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positive, "query")
        out.append(stage(named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives"))
    result = out[0]
    for one in out[1:]:
        result = result.union(one)
    return result
