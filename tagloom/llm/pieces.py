"""Sampled piece segmentation by forward filtering and backward sampling; lossless decoding.

A text is a lattice whose arcs are vocabulary pieces.  The forward pass sums the
weights of all ways to reach each position; the backward pass draws one
segmentation in proportion to its weight.  Draws are a hash of the row's key and
the place in the text, so a retried or moved task gives the same pieces.
"""

import re
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BYTE_SYMBOL = 0xE000  # inside the encoder only: a character outside the vocabulary is its UTF-8 bytes
CHARS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 1024
ARCS_KEPT = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in the order of their scores with ids, the ids of the 256 bytes, and the number of ids."""

    pieces: tuple
    ids: tuple
    byte_ids: tuple
    size: int

    @cached_property
    def single(self):
        return {p for p in self.pieces if len(p) == 1 and p != SPACE}

    @cached_property
    def outside(self):
        """Matches the characters that no piece covers alone; the space marker itself is one."""
        return re.compile("[^ " + "".join(map(re.escape, sorted(self.single - {" "}))) + "]")

    @cached_property
    def unit(self):
        """Matches the stretches of a text that no piece reaches across, so their lattices are independent."""
        pairs = {(a, b) for p in self.pieces for a, b in zip(p, p[1:])}
        byte = f"{chr(BYTE_SYMBOL)}-{chr(BYTE_SYMBOL + 255)}"
        if any(b == SPACE != a for a, b in pairs):
            return re.compile(f"[^{byte}]+|[{byte}]")
        if any(SPACE != a and a.isalpha() != b.isalpha() for a, b in pairs):
            return re.compile(f"{SPACE}*[^{SPACE}{byte}]+|{SPACE}+|[{byte}]")
        letters = "".join(sorted(c for c in self.single if c.isalpha()))
        return re.compile(f"{SPACE}*[{letters}]+|{SPACE}*[^{letters}{SPACE}{byte}]+|{SPACE}+|[{byte}]")

    @cached_property
    def trie(self):
        return Trie(
            [*self.pieces, *(chr(BYTE_SYMBOL + b) for b in range(256))], [*self.ids, *self.byte_ids]
        )

    @cached_property
    def text_of(self):
        """UTF-8 bytes by id; ids without a text, such as control symbols, decode to nothing."""
        out = [b""] * self.size
        for piece, i in zip(self.pieces, self.ids):
            out[i] = piece.replace(SPACE, " ").encode()
        for value, i in enumerate(self.byte_ids):
            out[i] = bytes([value])
        return out

    def log_weights(self, sharpness):
        """By id: merge rank r has weight (r + 2) ** -sharpness, a byte the least one."""
        out = np.full(self.size, -sharpness * np.log(len(self.pieces) + 2.0))
        out[list(self.ids)] = -sharpness * np.log(np.arange(len(self.ids)) + 2.0)
        return out

    def symbols(self, text):
        def spell(match):
            return "".join(chr(BYTE_SYMBOL + b) for b in match[0].encode())

        return self.outside.sub(spell, text).replace(" ", SPACE)


def load(path=MODEL):
    """The vocabulary of a SentencePiece model with a piece for every byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    known = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    known.sort(key=lambda i: (-model.get_score(i), i))
    by_byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in every if model.is_byte(i)}
    if len(by_byte) != 256:
        raise ValueError("lossless encoding needs a piece for each byte")
    return Vocabulary(tuple(model.id_to_piece(i) for i in known), tuple(known), tuple(by_byte[b] for b in range(256)), len(every))


class Trie:
    """Vocabulary strings as exact integer transitions, stepped for many positions at once.

    ``step(state, code)`` looks (state, code) up by open addressing and gives the
    next state or -1; ``piece[state]`` is the id that ends there or -1.
    """

    def __init__(self, strings, ids):
        edges, piece = {}, [-1]
        for string, i in zip(strings, ids):
            state = 0
            for code in map(ord, string):
                key = state << 21 | code
                if key not in edges:
                    edges[key] = len(piece)
                    piece.append(-1)
                state = edges[key]
            piece[state] = i
        self.piece = np.array(piece, np.int32)
        self.bits = max(4, (4 * len(edges)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys = np.fromiter(edges, np.int64, len(edges))
        for key, state, slot in zip(keys.tolist(), edges.values(), self._slot(keys).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.next[slot] = key, state

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state, code):
        keys = state.astype(np.int64) << 21 | code
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        found = self.keys[slot]
        hit = found == keys
        out[hit] = self.next[slot[hit]]
        open_ = np.flatnonzero(~hit & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Lattices:
    """Backward-sampling tables of the distinct units met so far.

    Node j of a unit has arcs from earlier nodes.  ``bound`` holds, for all arcs
    in node order, the node number plus the running share of the arc among its
    node's arcs, so one binary search of ``node + u`` draws an arc for u in [0, 1).
    """

    def __init__(self, vocabulary, sharpness):
        self.trie, self.log_weight = vocabulary.trie, vocabulary.log_weights(sharpness)
        room = ARCS_KEPT + ARCS_KEPT // 4
        self.bound, self.piece, self.origin = np.empty(room), np.empty(room, np.int32), np.empty(room, np.int32)
        self.clear()

    def clear(self):
        """Forget all units; the tables keep their memory."""
        self.last, self.nodes, self.arcs = {}, 0, 0

    def _append(self, **columns):
        """Add arcs to the tables, which are made for the arcs kept and grow only for a larger single addition."""
        arcs = self.arcs + len(columns["bound"])
        if arcs > len(self.bound):
            for name in columns:
                grown = np.empty(arcs, getattr(self, name).dtype)
                grown[: self.arcs] = getattr(self, name)[: self.arcs]
                setattr(self, name, grown)
        for name, values in columns.items():
            getattr(self, name)[self.arcs : arcs] = values
        self.arcs = arcs

    def add(self, units):
        """Forward-filter new units, all together; sums of weights are kept as logs."""
        units = list(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        end_of = np.repeat(ends, sizes)
        # all arcs: walk the trie from every position at once while it leads on
        at, state, length = np.arange(len(codes)), np.zeros(len(codes), np.int32), 0
        starts, stops, ids = [], [], []
        while len(at):
            state = self.trie.step(state, codes[at + length])
            length += 1
            alive = state >= 0
            at, state = at[alive], state[alive]
            found = self.trie.piece[state]
            is_piece = found >= 0
            starts.append(at[is_piece])
            stops.append(at[is_piece] + length)
            ids.append(found[is_piece])
            more = at + length < end_of[at]
            at, state = at[more], state[more]
        start, stop, piece = map(np.concatenate, (starts, stops, ids))
        # arcs by their end's place in the unit, then by unit: a front moves over all units together
        begin_of = end_of - np.repeat(sizes, sizes)
        place = stop - begin_of[stop - 1]
        order = np.lexsort((start, stop, place))
        start, stop, piece, place = start[order], stop[order], piece[order], place[order]
        first = start == begin_of[start]
        reach = np.zeros(len(codes) + 1)  # by end position: log of the summed weight
        weight = self.log_weight[piece]
        fronts = np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), len(place)] if len(place) else [0]
        running = np.empty(len(place))
        for low, high in zip(fronts[:-1], fronts[1:]):
            log = weight[low:high] + np.where(first[low:high], 0.0, reach[start[low:high]])
            node = stop[low:high]
            heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            group = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, high - low]))
            top = np.maximum.reduceat(log, heads)
            share = np.exp(log - top[group])
            total = np.add.reduceat(share, heads)
            reach[node[heads]] = top + np.log(total)
            sums = np.cumsum(share / total[group])
            running[low:high] = sums - np.r_[0.0, sums][heads][group]
            running[low:high][np.r_[heads[1:], high - low] - 1] = 1.0
        order = np.argsort(stop, kind="stable")
        base = self.nodes - 1  # the node of end position p is base + p
        self._append(
            bound=base + stop[order] + np.clip(running[order], 0.0, 1.0), piece=piece[order],
            origin=np.where(first, -1, base + start)[order],
        )
        self.nodes += len(codes)
        self.last.update(zip(units, (base + ends).tolist()))

    def sample(self, units, seeds):
        """(piece ids of all units in order, number of pieces by unit); one seed per unit."""
        missing = set(units).difference(self.last)
        if missing and self.arcs > ARCS_KEPT:
            self.clear()
            missing = set(units)
        if missing:
            self.add(missing)
        state = np.fromiter(map(self.last.__getitem__, units), np.int64, len(units))
        number = np.argsort(state, kind="stable")  # neighbours search the same part of the tables
        state, seeds = state[number], seeds[number]
        counts, drawn = np.zeros(len(units), np.int64), []
        bound = self.bound[: self.arcs]
        step = 0
        while len(state):
            arc = np.searchsorted(bound, state + _uniform(seeds, step), side="right")
            drawn.append((number, self.piece[arc]))
            counts[number] += 1
            state = self.origin[arc]
            left = state >= 0
            state, seeds, number = state[left], seeds[left], number[left]
            step += 1
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for step, (number, found) in enumerate(drawn):
            ids[ends[number] - 1 - step] = found
        return ids, counts


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seeds, step):
    """Doubles in [0, 1 - 2**-30), so that adding a node number cannot round up to the next node."""
    return (_mix(seeds + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(34)) * 2.0**-30


def segment(texts, keys, vocabulary, lattices):
    """Arrow list of piece ids per text; a null text gives null."""
    units, per_text = [], []
    for text in texts:
        found = vocabulary.unit.findall(vocabulary.symbols(text)) if text else []
        units += found
        per_text.append(len(found))
    per_text = np.array(per_text, np.int64)
    ends = np.cumsum(per_text)
    place = np.arange(len(units)) - np.repeat(ends - per_text, per_text)
    seeds = _mix(np.repeat(keys.astype(np.uint64), per_text) ^ _mix(place.astype(np.uint64)))
    ids, counts = lattices.sample(units, seeds)
    bounds = np.r_[0, np.cumsum(counts)][np.r_[0, ends]].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))
    nulls = np.array([t is None for t in texts], bool)
    return pa.ListArray.from_arrays(pa.array(bounds, mask=np.r_[nulls, False]), pa.array(ids)) if nulls.any() else lists


def texts_of(lists, vocabulary):
    """UTF-8 bytes, or None, per list of piece ids."""
    table, values, bounds = vocabulary.text_of, lists.values.to_numpy(), lists.offsets.to_pylist()
    parts = map(table.__getitem__, values[bounds[0] : bounds[-1]].tolist())
    valid = lists.is_valid().to_pylist()
    return [b"".join(islice(parts, b - a)) if ok else None for ok, a, b in zip(valid, bounds, bounds[1:])]


def encode(docs, vocabulary, key_col="doc_id", text_col="text", out_col="pieces", sharpness=1.0, seed=42, lossless_col=None):
    """``docs`` with an added array of sampled piece ids.

    The segmentation depends on the key, the text and ``seed`` alone.  Rows of
    the same key and text get the same pieces; null keys share one key.  A null
    text has null pieces, an empty one an empty array.  With ``lossless_col``
    each row is also decoded in its task and compared with its text.  Narrow: no
    shuffle, and the vocabulary of a model, a bounded size, is all that is
    broadcast.  Added names that are taken get an underscore in front.  A unit
    between blanks is sampled a character at a time, so one of 200,000 letters
    takes about half a minute; a text has to fit into its task.
    """
    out_col, *more = fresh(docs, out_col, *([lossless_col] if lossless_col else []))
    lossless_col = more[0] if more else None
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    at, width = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    if lossless_col:
        schema.add(lossless_col, T.BooleanType())

    def spans(texts):
        start, size = 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text or "") > CHARS_AT_ONCE:
                yield start, i
                start, size = i, 0
            size += len(text or "")
        yield start, len(texts)

    def run(batches):
        vocabulary = shared.value
        lattices = Lattices(vocabulary, sharpness)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(low, ROWS_AT_ONCE)
                texts, keys = rows.column(at).to_pylist(), rows.column(width).to_numpy()
                for start, end in spans(texts):
                    lists = segment(texts[start:end], keys[start:end], vocabulary, lattices)
                    columns = [*rows.slice(start, end - start).columns[:width], lists]
                    if lossless_col:
                        back = texts_of(lists, vocabulary)
                        columns.append(pa.array([b == (t if t is None else t.encode()) for b, t in zip(back, texts[start:end])]))
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    keyed = docs.select("*", F.xxhash64(F.col(key_col), F.lit(seed)).alias(fresh(docs, "_piece_key")[0]))
    return keyed.mapInArrow(run, schema)


def decoder(spark, vocabulary):
    """A column function pieces → text, the inverse of ``encode``."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def decode(pieces: pa.Array) -> pa.Array:
        return pa.array(texts_of(pieces, shared.value), pa.binary()).cast(pa.string())

    return decode
