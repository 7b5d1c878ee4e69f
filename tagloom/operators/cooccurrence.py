"""Word vectors from co-occurrence counts, with the vocabulary spread over the tasks.

Words within a window of each other are counted inside the tasks first; what is
left is shuffled as packed cells, the pairs of two classes of words, and added
up.  Positive pointwise mutual information is taken cell by cell against the
margins of the two classes.  It is a sparse symmetric matrix, held once for each
pair in tiles of bands of rows, and its leading eigenvectors come from subspace
iteration: in a product a tile gets the rows of the basis that its entries need and
returns sums for the same rows, as floats.  The driver sees only small matrices of
the size of the vectors, never a row per word.
"""

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Sized, discard, lookup_join, number_rows, stage, stage_sized

BLOCK = 2048
BLOCKS_OF_TILE = 32
ENTRIES_OF_TILE = 1 << 22
TILES_TOGETHER = 16
ENTRIES_AT_ONCE = 1 << 10
TOKENS_AT_ONCE = 1 << 18
PAIRS_HELD = 1 << 23
PAIRS_OF_CELL = 1 << 23
ENTRIES_OF_CELL = 1 << 18
ROWS_OUT = 1 << 16
# the helpers below go to the tasks with the functions that call them; executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL = "row_class int, class int, sizes binary, letters binary, pairs binary, n binary"


@dataclass(frozen=True)
class Cells:
    """Counts of unordered pairs, packed by the classes of their two words; a word's class is its hash modulo ``classes``."""

    df: DataFrame
    classes: int


def _classes(words, classes):
    """The class of each word, the same in every task."""
    import pandas as pd

    return (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(classes)).astype(np.int64)


def _summed(keys, counts):
    """Sorted keys, each once, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[heads], np.add.reduceat(counts, heads)


def _squeezed(values):
    """Whole numbers from 0 on, as compressed planes of their bytes."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unsqueezed(packed):
    width, size = packed[0], int.from_bytes(packed[1:9], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[9:], width * size), np.uint8).reshape(width, size)
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<i8")


def _squeezed_words(words):
    """(sizes, letters) of a list of words; a size of 0 is a null."""
    words = pa.concat_arrays([words, pa.array([], pa.string())])  # its own buffers, from 0 on
    sizes = pc.fill_null(pc.add(pc.binary_length(words), 1), 0).to_numpy()
    letters = "".encode().join(pc.drop_null(words).cast(pa.binary()).to_pylist())
    return _squeezed(sizes), _squeezed(np.frombuffer(letters, np.uint8))


def _words(batch, at):
    """The words of a packed row."""
    sizes, letters = (_unsqueezed(batch.column(c)[at].as_py()) for c in ("sizes", "letters"))
    ends = np.r_[0, np.cumsum(np.maximum(sizes - 1, 0))].astype(np.int32)
    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(letters.astype(np.uint8)))
    return words if sizes.all() else pc.if_else(pa.array(sizes > 0), words, pa.scalar(None, pa.string()))


def _cell_batch(row_class, column_class, words, a, b, n):
    """A cell: its words, and its pairs in ascending order as steps from one to the next."""
    pairs = a.astype(np.int64) * len(words) + b
    packed = (*_squeezed_words(words), _squeezed(np.diff(pairs, prepend=0)), _squeezed(n))
    heads = [pa.array([row_class], pa.int32()), pa.array([column_class], pa.int32())]
    return pa.RecordBatch.from_arrays([*heads, *(pa.array([x], pa.binary()) for x in packed)], names=["row_class", "class", "sizes", "letters", "pairs", "n"])


def _opened(batch, at):
    """words, (a, b, n) of a packed cell."""
    words = _words(batch, at)
    steps, n = (_unsqueezed(batch.column(c)[at].as_py()) for c in ("pairs", "n"))
    a, b = np.divmod(np.cumsum(steps), max(len(words), 1))
    return words, (a, b, n)


def packed_counts(rows, tokens="tokens", window=25):
    """How often two words stand within ``window`` words of each other, as ``Cells``; a word that meets itself counts once.

    A task adds up the pairs of its own text before they are shuffled and holds
    ``PAIRS_HELD`` sums at most.  There are as many classes as keep a cell under
    ``PAIRS_OF_CELL`` pairs of words on the average, so that one fits a task.
    """
    size = rows.agg(F.coalesce(F.sum(F.greatest(F.size(tokens), F.lit(0)).cast("long")), F.lit(0)).alias("n")).first()["n"]
    classes = max(1, int(np.ceil(np.sqrt(2 * size * window / PAIRS_OF_CELL))))

    def met(batches):
        numbers, words, held, sums = {}, [], 0, []

        def packed():
            keys, counts = _summed(*map(np.concatenate, zip(*sums)))
            a, b = keys >> 32, keys & 0xFFFFFFFF
            of = _classes(words, classes)
            cell = np.minimum(of[a], of[b]) * classes + np.maximum(of[a], of[b])
            order = np.argsort(cell.astype(np.uint16) if classes < 256 else cell, kind="stable")
            a, b, counts, cell = a[order], b[order], counts[order], cell[order]
            bounds = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
            names, place = pa.array(words, pa.string()), np.zeros(len(words), np.int64)
            for low, high in zip(bounds[:-1], bounds[1:]):
                seen = np.zeros(len(words), bool)
                seen[a[low:high]] = seen[b[low:high]] = True
                known = np.flatnonzero(seen)
                place[known] = np.arange(len(known))
                yield _cell_batch(*divmod(int(cell[low]), classes), names.take(pa.array(known)), place[a[low:high]], place[b[low:high]], counts[low:high])

        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy().astype(np.int64))
            coded = column.flatten().dictionary_encode("encode")
            found = []
            for word in coded.dictionary.to_pylist():
                if word not in numbers:
                    numbers[word] = len(words)
                    words.append(word)
                found.append(numbers[word])
            ids = np.array(found, np.int64)[coded.indices.to_numpy()] if found else np.zeros(0, np.int64)
            document = np.repeat(np.arange(len(sizes)), sizes)
            for low in range(0, len(ids), TOKENS_AT_ONCE):
                keys = []
                for d in range(1, window + 1):
                    y = ids[low + d : low + d + TOKENS_AT_ONCE]
                    x = ids[low : low + len(y)]
                    near = document[low : low + len(y)] == document[low + d : low + d + len(y)]
                    keys.append((np.minimum(x, y) << 32 | np.maximum(x, y))[near])
                keys = np.sort(np.concatenate(keys))
                if not len(keys):
                    continue
                heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                sums.append((keys[heads], np.diff(np.r_[heads, len(keys)])))
                held += len(heads)
                if held > PAIRS_HELD:
                    sums = [_summed(*map(np.concatenate, zip(*sums)))]
                    held = len(sums[0][0])
                    if held > PAIRS_HELD // 2:
                        yield from packed()
                        numbers, words, held, sums = {}, [], 0, []
                        found = [numbers.setdefault(word, len(numbers)) for word in coded.dictionary.to_pylist()]
                        words = list(numbers)
                        ids = np.array(found, np.int64)[coded.indices.to_numpy()]
        if sums:
            yield from packed()

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, a, b, n, at = [], [], [], [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                found, (x, y, count) = _opened(batch, row)
                names.append(found)
                a.append(x + at)
                b.append(y + at)
                n.append(count)
                at += len(names[-1])
        coded = pa.concat_arrays(names).dictionary_encode("encode")
        ids = coded.indices.to_numpy().astype(np.int64)
        a, b = ids[np.concatenate(a)], ids[np.concatenate(b)]
        keys, counts = _summed(np.minimum(a, b) << 32 | np.maximum(a, b), np.concatenate(n))
        for low in range(0, len(keys), ENTRIES_OF_CELL):
            some, place = keys[low : low + ENTRIES_OF_CELL], np.zeros(len(coded.dictionary), np.int64)
            a, b = some >> 32, some & 0xFFFFFFFF
            place[a] = place[b] = 1
            known = np.flatnonzero(place)
            place[known] = np.arange(len(known))
            yield _cell_batch(key[0].as_py(), key[1].as_py(), coded.dictionary.take(pa.array(known)), place[a], place[b], counts[low : low + ENTRIES_OF_CELL])

    texts = rows.where(F.size(tokens) > 1).select(tokens)
    return Cells(texts.mapInArrow(met, CELL).groupBy("row_class", "class").applyInArrow(merged, CELL), classes)


def _both_ways(pairs, value):
    """Each pair of two words in both directions."""
    there, back = F.struct("a", "b", value), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), value)
    once = F.col("a").eqNullSafe(F.col("b"))
    return pairs.select(F.explode(F.when(once, F.array(there)).otherwise(F.array(there, back))).alias("p")).select("p.a", "p.b", f"p.{value}")


def cooccurrence_counts(rows, tokens="tokens", window=25):
    """(a, b, n): how often two words stand within ``window`` words of each other, in both directions.

    A word that meets itself counts twice, once from either place.  Documents
    without tokens, or with null, give nothing.
    """

    def unpacked(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                words, (a, b, n) = _opened(batch, at)
                n = np.where(a == b, 2 * n, n)
                for low in range(0, len(n), ROWS_OUT):
                    part = slice(low, low + ROWS_OUT)
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(a[part])), words.take(pa.array(b[part])), pa.array(n[part])], names=["a", "b", "n"])

    cells = packed_counts(rows, tokens, window)
    return _both_ways(cells.df.mapInArrow(unpacked, "a string, b string, n long"), "n")


def _margins(cells):
    """(row_class, word, n): how often each word meets any, itself twice, as a measured table."""

    classes = cells.classes

    def sums(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                words, (a, b, n) = _opened(batch, at)
                n = np.bincount(a, n, len(words)) + np.bincount(b, n, len(words))
                of = _classes(words.to_pylist(), classes)
                yield pa.RecordBatch.from_arrays([pa.array(of), words, pa.array(n.astype(np.int64))], names=["row_class", "word", "n"])

    found = cells.df.mapInArrow(sums, "row_class long, word string, n long")
    return stage_sized(found.groupBy("row_class", "word").agg(F.sum("n").alias("n")), "margins")


def _told(cells, known, fields):
    """Cells with, for each of their words, the ``fields`` of a measured (row_class, word, ...); -1 for a word that it lacks.

    The cells of a class are read behind the words of that class, for either class
    of a cell in turn, so the words of a class go to one task once.  The table
    between the turns is the second result, which only the first one reads.
    """
    lists = [f"_{f}" for f in fields]
    schema = ", ".join([f"side int, {CELL}", *(f"{c} binary" for c in lists)])

    def listed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        values = [_squeezed(table.column(f).to_numpy() + 1) for f in fields]
        packed = dict(zip(["sizes", "letters", *lists], [*_squeezed_words(table.column("word").combine_chunks()), *values]))
        heads = [pa.array([key[0].as_py()], pa.int32()), *[pa.array([None], pa.int32())] * 2]
        rest = [pa.array([packed.get(c)], pa.binary()) for c in ("sizes", "letters", "pairs", "n", *lists)]
        yield pa.RecordBatch.from_arrays([*heads, *rest], names=["side", "row_class", "class", "sizes", "letters", "pairs", "n", *lists])

    def tell(batches):
        side, words, values = None, None, []
        for batch in batches:
            told = [[] for _ in lists]
            for at in range(batch.num_rows):
                here, cell = batch.column("side")[at].as_py(), batch.column("pairs")[at].is_valid
                if not cell:
                    side, words, values = here, _words(batch, at), [_unsqueezed(batch.column(c)[at].as_py()) for c in lists]
                    continue
                own = _words(batch, at)
                place = pc.index_in(own, value_set=words) if side == here else pa.nulls(len(own), pa.int32())
                hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                place = place.drop_null().to_numpy()
                for k, column in enumerate(lists):
                    before = batch.column(column)[at].as_py()
                    out = np.zeros(len(own), np.int64) if before is None else _unsqueezed(before).copy()
                    if len(hit):
                        out[hit] = values[k][place]
                    told[k].append(_squeezed(out))
            kept = batch.filter(batch.column("pairs").is_valid())
            for k, column in enumerate(lists):
                kept = kept.set_column(kept.schema.get_field_index(column), column, pa.array(told[k], pa.binary()))
            yield kept

    told = cells.df.withColumns({c: F.lit(None).cast("binary") for c in lists})
    heads = known.df.groupBy(F.col("row_class").cast("int").alias("side")).applyInArrow(listed, schema)
    for side in ("row_class", "class"):
        both = heads.unionByName(told.withColumn("side", F.col(side))).repartition("side")
        told = both.sortWithinPartitions("side", F.col("pairs").isNotNull()).mapInArrow(tell, schema)
        if side == "row_class":
            told = between = stage(told, "told")
    return told, between


def _field(batch, at, name):
    """What is told of each word of a cell."""
    return _unsqueezed(batch.column(f"_{name}")[at].as_py()) - 1


def _total(margins):
    return float(margins.df.agg(F.sum("n").alias("n")).first()["n"] or 0)


def _mutual(cells, margins):
    """(a, b, pmi): once for each pair of words."""
    every = _total(margins)

    def valued(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                words, (a, b, n) = _opened(batch, at)
                margin = _field(batch, at, "n").astype(float)
                value = np.log(np.where(a == b, 2 * n, n) * every / (margin[a] * margin[b]))
                kept = value > 0
                a, b, value = a[kept], b[kept], value[kept]
                for low in range(0, len(value), ROWS_OUT):
                    part = slice(low, low + ROWS_OUT)
                    ends = [words.take(pa.array(x[part])) for x in (a, b)]
                    yield pa.RecordBatch.from_arrays([*ends, pa.array(value[part])], names=["a", "b", "pmi"])

    return _told(cells, margins, ("n",))[0].mapInArrow(valued, "a string, b string, pmi double")


def positive_pmi(counts):
    """(a, b, pmi): the pairs that meet more often than by chance, from (a, b, n) rows or from staged ``Cells``.

    ``Cells`` have been read when this returns, so their table may be discarded.
    """
    if isinstance(counts, Cells):
        return _both_ways(_mutual(counts, _margins(counts)), "pmi")
    totals = stage_sized(counts.groupBy("a").agg(F.sum("n").alias("n_a")), "margins")
    every = totals.df.agg(F.sum("n_a").alias("n")).first()["n"] or 0
    other = totals.df.select(F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    found = lookup_join(counts, totals, "a", spread=["b"])
    found = lookup_join(found, type(totals)(other, totals.rows, totals.bytes), "b", spread=["a"])
    value = F.log(F.col("n") * F.lit(float(every)) / (F.col("n_a").cast("double") * F.col("n_b")))
    return found.select("a", "b", value.alias("pmi")).where(F.col("pmi") > 0)


def _ranked(numbers, margins, a, b, n):
    """A packed set of entries: its word numbers in ascending order, their margins, and its pairs, the rarer word first."""
    known = np.unique(np.r_[a, b])
    order = np.argsort(numbers[known], kind="stable")
    known = known[order]
    place = np.zeros(len(numbers), np.int64)
    place[known] = np.arange(len(known))
    a, b = place[a], place[b]
    pairs = np.maximum(a, b) * len(known) + np.minimum(a, b)
    order = np.argsort(pairs, kind="stable")
    return _squeezed(np.diff(numbers[known], prepend=0)), _squeezed(margins[known]), _squeezed(np.diff(pairs[order], prepend=0)), _squeezed(n[order])


def _unranked(batch, at):
    """numbers, margins, (a, b, n) of a packed set of entries."""
    steps, margins, pairs, n = (_unsqueezed(batch.column(c)[at].as_py()) for c in ("numbers", "margins", "pairs", "n"))
    return np.cumsum(steps), margins, (*np.divmod(np.cumsum(pairs), max(len(steps), 1)), n)


def _entries(cells, every, known):
    """(band, size, numbers, margins, pairs, n): the pairs that meet more often than by chance, by the band of their rarer word, staged."""
    wide = BLOCK * BLOCKS_OF_TILE

    def placed(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                _, (a, b, n) = _opened(batch, at)
                margins, numbers = _field(batch, at, "n"), _field(batch, at, "i")
                kept = np.log(np.where(a == b, 2 * n, n) * every / (margins[a].astype(float) * margins[b])) > 0
                a, b, n = a[kept], b[kept], n[kept]
                band = np.maximum(numbers[a], numbers[b]) // wide
                order = np.argsort(band, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(band[order]) != 0])
                for own in np.split(order, heads[1:]) if len(order) else ():
                    packed = _ranked(numbers, margins, a[own], b[own], n[own])
                    values = ([int(band[own[0]])], pa.int64()), ([len(own)], pa.int64()), *(([x], pa.binary()) for x in packed)
                    yield pa.RecordBatch.from_arrays([pa.array(*v) for v in values], names=["band", "size", "numbers", "margins", "pairs", "n"])

    told, between = _told(cells, known, ("n", "i"))
    entries = stage(told.mapInArrow(placed, "band long, size long, numbers binary, margins binary, pairs binary, n binary"), "entries")
    discard(between)
    return entries


def _tiles(entries):
    """(tile, numbers, margins, pairs, n): the entries of a band of rows, packed together.

    A band is ``BLOCKS_OF_TILE`` blocks of the vocabulary.  Bands of frequent words
    hold more than ``ENTRIES_OF_TILE`` and are dealt into several tiles.
    """

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unranked(batch, at) for batch in batches for at in range(batch.num_rows)]
        numbers, first, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        margins = np.concatenate([h[1] for h in held])[first]
        begins = np.cumsum([0, *(len(h[0]) for h in held)])
        a, b = (np.concatenate([at[begin + h[2][k]] for begin, h in zip(begins, held)]) for k in (0, 1))
        packed = _ranked(numbers, margins, a, b, np.concatenate([h[2][2] for h in held]))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), *(pa.array([x], pa.binary()) for x in packed)], names=["tile", "numbers", "margins", "pairs", "n"])

    cut = stage_sized(entries.groupBy("band").agg(F.ceil(F.sum("size") / ENTRIES_OF_TILE).alias("_parts")), "tile-sizes")
    dealt = lookup_join(entries, cut, "band", spread=["pairs"])
    tile = (F.col("band") * (1 << 24) + F.pmod(F.xxhash64("pairs"), "_parts")).alias("tile")
    packed = dealt.select(tile, "numbers", "margins", "pairs", "n").groupBy("tile")
    tiles = stage(packed.applyInArrow(pack, "tile long, numbers binary, margins binary, pairs binary, n binary"), "tiles")
    discard(entries)
    return tiles


def _needs(tiles):
    """(block, tiles, rows): which rows of a block of the vocabulary each tile needs, as a measured table."""
    block = BLOCK

    def listed(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                numbers = _unranked(batch, at)[0]
                heads = np.flatnonzero(np.r_[True, np.diff(numbers // block) != 0])
                rows = [pa.scalar(x.astype(np.int16).tobytes(), pa.binary()) for x in np.split(numbers % block, heads[1:])]
                tile = np.full(len(heads), batch.column("tile")[at].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(numbers[heads] // block), pa.array(tile), pa.array(rows, pa.binary())], names=["block", "tile", "rows"])

    found = tiles.mapInArrow(listed, "block long, tile long, rows binary")
    size = F.sum(F.octet_length("rows") + 24).alias("bytes")
    needs = stage(found.groupBy("block").agg(F.collect_list(F.struct("tile", "rows")).alias("needs"), size), "needs")
    measured = needs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return Sized(needs.drop("bytes"), measured["rows"], measured["bytes"])


def _product(tiles, needs, basis, width, every):
    """The matrix times a basis: every tile gets the rows of the basis that it needs and returns its sums for the same rows."""
    block, together, at_once = BLOCK, TILES_TOGETHER, ENTRIES_AT_ONCE

    def copy(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                q = np.frombuffer(batch.column("q")[at].as_py(), np.float64).reshape(-1, width).astype(np.float32)
                needed, number = batch.column("needs")[at].values, batch.column("block")[at].as_py()
                for low in range(0, len(needed), together):
                    rows = [np.frombuffer(x, np.int16) for x in needed.field("rows")[low : low + together].to_pylist()]
                    values = pa.array([q[r].tobytes() for r in rows], pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())
                    yield pa.RecordBatch.from_arrays([needed.field("tile")[low : low + together], pa.array([number] * len(rows)), *values], names=["tile", "block", "q", "rows"])

    def multiply(copies, tile):
        copies = copies.sort_by("block")
        q = np.concatenate([np.frombuffer(x, np.float32) for x in copies.column("q").to_pylist()]).reshape(-1, width)
        _, margins, (a, b, n) = _unranked(tile.combine_chunks().to_batches()[0], 0)
        value = np.log(np.where(a == b, 2 * n, n) * every / (margins[a].astype(float) * margins[b]))
        out = np.zeros((len(q), width))
        for low in range(0, len(a), at_once):
            part = slice(low, low + at_once)
            x, y, v = a[part], b[part], value[part, None]
            heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            out[x[heads]] += np.add.reduceat(v * q[y], heads, axis=0)
            order = np.argsort(y, kind="stable")
            order = order[x[order] != y[order]]
            if len(order):
                x, y, v = x[order], y[order], v[order]
                heads = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
                out[y[heads]] += np.add.reduceat(v * q[x], heads, axis=0)
        ends = np.cumsum([len(r) // 2 for r in copies.column("rows").to_pylist()])[:-1]
        sums = pa.array([x.tobytes() for x in np.split(out.astype(np.float32), ends)], pa.binary())
        return pa.table({"block": copies.column("block"), "rows": copies.column("rows"), "y": sums})

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((block, width))
        for batch in batches:
            for rows, y in zip(batch.column("rows").to_pylist(), batch.column("y").to_pylist()):
                total[np.frombuffer(rows, np.int16)] += np.frombuffer(y, np.float32).reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["block", "y"])

    met = lookup_join(basis, needs, "block", spread=["block"]).select("block", "q", "needs")
    copies = met.mapInArrow(copy, "tile long, block long, q binary, rows binary")
    made = copies.groupBy("tile").cogroup(tiles.groupBy("tile")).applyInArrow(multiply, "block long, rows binary, y binary")
    return stage(made.groupBy("block").applyInArrow(added, "block long, y array<double>"), "product")


def _small(frame, left, right, width):
    """The product of two tall matrices, transposed left times right, as a small one."""

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(batch.num_rows):
                a, b = (np.asarray(batch.column(c)[at].values).reshape(-1, width) for c in (left, right))
                total += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["m"])

    found = frame.select(left, right) if left != right else frame.select(left)
    summed = found.mapInArrow(partial, "m array<double>").select(array_to_vector("m").alias("m")).agg(Summarizer.sum(F.col("m")).alias("m")).first()["m"]
    return np.zeros((width, width)) if summed is None else summed.toArray().reshape(width, width)


def _times(frame, matrix, source, width, output):
    """Each block times a small matrix, as binary."""

    def apply(batches):
        for batch in batches:
            blocks = [(np.asarray(batch.column(source)[at].values).reshape(-1, width) @ matrix).tobytes() for at in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(blocks, pa.binary())], names=["block", output])

    return frame.select("block", source).mapInArrow(apply, f"block long, {output} binary")


def _orthonormal(product, width):
    """The basis of the columns of a product; directions that have vanished become zero."""
    gram = _small(product, "y", "y", width)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > max(float(values.max(initial=0)), 0) * 1e-14
    return vectors * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1)), 0)


def pmi_vectors(rows, tokens="tokens", vector_size=100, window=25, min_count=1, iterations=6, spare=20, seed=42):
    """(word, vector): words by the leading eigenvectors of their positive mutual information, each scaled by the root of its value.

    Words rarer than ``min_count`` are left out of pairs and vectors.  The basis
    has ``spare`` columns more than asked for and is multiplied ``iterations``
    times.  Eigenvalues that are not positive give zeros.  A vocabulary of any
    size is a table; the driver holds squares of ``vector_size + spare``.
    """
    spark, width = rows.sparkSession, vector_size + spare
    words = rows.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    numbered = stage_sized(number_rows(words, [F.desc("n"), F.asc("word")], "i", start=0).select("word", "i"), "vocabulary")
    cells = packed_counts(rows, tokens, window)
    cells = Cells(stage(_of_vocabulary(cells, numbered) if min_count > 1 else cells.df, "cooccurrences"), cells.classes)
    margins = _margins(cells)
    known = stage_sized(lookup_join(margins.df, numbered, "word", spread=["row_class"]), "numbered-margins")
    every = _total(margins)
    tiles = _tiles(_entries(cells, every, known))
    discard(cells.df, margins.df, known.df)
    needs = _needs(tiles)
    blocks = -(-numbered.rows // BLOCK)

    def start(batches):
        for batch in batches:
            q = [np.random.default_rng((seed, b)).standard_normal((BLOCK, width)).tobytes() for b in batch.column("block").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(q, pa.binary())], names=["block", "q"])

    basis = stage(spark.range(blocks).toDF("block").mapInArrow(start, "block long, q binary"), "basis")
    for _ in range(iterations):
        product, spent = _product(tiles, needs, basis, width, every), basis
        basis = stage(_times(product, _orthonormal(product, width), "y", width, "q"), "basis")
        discard(spent, product)
    product = _product(tiles, needs, basis, width, every)

    def opened(batches):
        for batch in batches:
            q = [np.frombuffer(b, np.float64) for b in batch.column("q").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(q, pa.list_(pa.float64()))], names=["block", "q"])

    spread = basis.mapInArrow(opened, "block long, q array<double>")
    both = stage(spread.join(product, "block"), "last")
    discard(basis, product, tiles)
    found = _small(both, "q", "y", width)
    values, turns = np.linalg.eigh((found + found.T) / 2)
    best = np.argsort(-values)[:vector_size]
    scale = turns[:, best] * np.sqrt(np.maximum(values[best], 0))

    def vectors(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                made = np.asarray(batch.column("q")[at].values).reshape(-1, width) @ scale
                numbers = batch.column("block")[at].as_py() * BLOCK + np.arange(BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(list(made.astype(np.float32)), pa.list_(pa.float32()))], names=["i", "vector"])

    made = both.select("block", "q").mapInArrow(vectors, "i long, vector array<float>")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), vector_size)
    return numbered.df.join(made.hint("merge"), "i", "left").select("word", F.coalesce("vector", zeros).alias("vector"))


def _of_vocabulary(cells, numbered):
    """The cells' pairs of two words of the vocabulary."""
    classes = cells.classes

    def kept(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                words, (a, b, n) = _opened(batch, at)
                known = _field(batch, at, "i") >= 0
                both = known[a] & known[b]
                if both.any():
                    yield _cell_batch(batch.column("row_class")[at].as_py(), batch.column("class")[at].as_py(), words, a[both], b[both], n[both])

    def placed(batches):
        for batch in batches:
            of = _classes(batch.column("word").to_pylist(), classes)
            yield pa.RecordBatch.from_arrays([pa.array(of), batch.column("word"), batch.column("i")], names=["row_class", "word", "i"])

    listed = numbered.df.select("word", "i").mapInArrow(placed, "row_class long, word string, i long")
    known = type(numbered)(listed, numbered.rows, numbered.bytes)
    return _told(cells, known, ("i",))[0].mapInArrow(kept, CELL)
