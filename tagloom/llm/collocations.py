"""Phrase collocations by language, from count streams kept in prefix and in suffix order.

Texts become runs of word codes.  A run sends the keys of its words and word
pairs, sorted and with counts, to ranges of the key space; a range merges the
sorted runs and answers each run with those of its keys that may be frequent.
What is left of a run asks in the same way for its longer phrases.  Answers are
upper bounds, so a run then counts the phrases it has left exactly, as words.  The frequent phrases form two streams: sorted by their words
from the left, a phrase comes right after its own beginnings, and sorted from
the right, after its own ends.  One pass over each, with a stack as deep as a
phrase, gives the counts of all left and right parts and of the best extension
by one word; the two streams meet in a merge join.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.staging import lookup_join, stage, stage_sized

RUN_BYTES = 8 << 20
KEYS_PER_RANGE = 4_000_000
ROWS_PER_TASK = 100_000
KEY_BITS = 40
FEWEST_RANGE_BITS = 10
UNKNOWN = "und"

CODED = ("codes", "words", "word_langs", "counts", "langs")
RUNS = "codes binary, words binary, word_langs binary, counts binary, langs array<string>, totals array<long>"
KEYS = "range int, run long, keys binary, counts binary"
PHRASES = "lang string, phrase binary, n long"
SCANNED = "lang string, words array<string>, own boolean, n long, parts array<long>, extension long"


def _bytes_table(breaks, blanks):
    kind = np.zeros(256, np.uint8)
    kind[list(blanks)] = 1
    kind[list(breaks)] = 2
    return kind


KIND = _bytes_table(b".,;:!?\n\x0b\x0c\r", b" \t")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split_words(data, offsets):
    """(words as one binary array, text number of each, does it open a piece) of joined byte texts."""
    kind = KIND[data]
    inside = kind == 0
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:-1]
    closes[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.cumsum(kind == 2)[starts]
    opening = np.ones(len(starts), bool)
    opening[1:] = (breaks[1:] != breaks[:-1]) | (owner[1:] != owner[:-1])
    bounds = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    letters = LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    return words, owner, opening


def _packed(values):
    """Whole numbers below 2^32, byte by byte, compressed."""
    raw = np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data):
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1).astype(np.int64)


def _row(codes, opening, words, word_langs, counts, langs, totals):
    """One run as a row; words come as a list of byte strings without blanks, frequent ones best first."""
    joined = b" ".join(words)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([_packed(codes << 1 | opening)], pa.binary()),
            pa.array([len(joined).to_bytes(8, "little") + pa.compress(joined, codec="zstd", asbytes=True)], pa.binary()),
            pa.array([_packed(word_langs)], pa.binary()), pa.array([_packed(counts)], pa.binary()),
            pa.array([langs], pa.list_(pa.string())), pa.array([totals], pa.list_(pa.int64())),
        ],
        names=["codes", "words", "word_langs", "counts", "langs", "totals"],
    )


def _run(part):
    """One row of coded words: a code names a word of one language, its lowest bit opens a piece."""
    named = part.column(0).dictionary_encode()
    text = part.column(1).cast(pa.binary())
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    body = text.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    words, owner, opening = split_words(data, offsets - offsets[0])
    coded = words.dictionary_encode()
    langs = len(named.dictionary)
    lang = named.indices.to_numpy()[owner]
    pairs, codes, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * langs + lang, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pairs = pairs[order]
    return _row(
        place[codes], opening, coded.dictionary.take(pa.array(pairs // langs)).to_pylist(), pairs % langs, counts[order],
        named.dictionary.to_pylist(), np.bincount(lang, minlength=langs).tolist(),
    )


def _runs(batches):
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)) // RUN_BYTES
        cuts = np.r_[0, np.flatnonzero(np.diff(sizes)) + 1, len(sizes)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            if high > low:
                yield _run(batch.slice(low, high - low))


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(marks):
    return _mix(marks) >> np.uint64(64 - KEY_BITS)


class _Coded:
    """A run read back."""

    def __init__(self, codes, words, word_langs, counts, langs, *_):
        raw = _unpacked(codes)
        self.codes, self.opening = raw >> 1, (raw & 1).astype(bool)
        size = int.from_bytes(words[:8], "little")
        self.words = pa.decompress(words[8:], decompressed_size=size, codec="zstd", asbytes=True).split(b" ") if size else []
        self.langs, self.word_langs, self.counts = langs, _unpacked(word_langs), _unpacked(counts)
        seeds = [xxhash.xxh64_intdigest(lang.encode()) for lang in langs]
        digest = xxhash.xxh64_intdigest
        self.marks = np.fromiter((digest(w, seeds[g]) for w, g in zip(self.words, self.word_langs)), np.uint64, len(self.words))

    def grams(self, longest, keep=None):
        """For two words and more: (size, beginnings, last words, counts, marks, kept), one entry per distinct phrase.

        A beginning is the number of the phrase without its last word.  Only
        phrases that ``keep`` (size, marks) allows are made longer.
        """
        at = np.flatnonzero(~self.opening[1:])
        linked = np.zeros(len(self.codes) + longest, bool)
        linked[at] = True
        names, marks = self.codes[at], self.marks
        for size in range(2, longest + 1):
            distinct, which, counts = np.unique(names << 32 | self.codes[at + size - 1], return_inverse=True, return_counts=True)
            heads, lasts = distinct >> 32, distinct & 0xFFFFFFFF
            marks = _mix(marks[heads]) * np.uint64(0x9E3779B97F4A7C15) + self.marks[lasts]
            kept = np.ones(len(marks), bool) if keep is None else keep(size, marks)
            yield size, heads, lasts, counts, marks, kept
            on = kept[which] & linked[at + size - 1]
            at, names = at[on], which[on]

    def short(self):
        """(keys, counts) of the words and of the pairs."""
        _, _, _, counts, marks, _ = next(self.grams(2))
        return np.concatenate([_keys(self.marks), _keys(marks)]), np.concatenate([self.counts, counts])

    def long(self, longest):
        """(keys, counts) of the longer phrases."""
        found = [(_keys(marks), counts) for size, _, _, counts, marks, _ in self.grams(longest) if size > 2]
        return tuple(np.concatenate(c) for c in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *found))

    def reduced(self, kept):
        """The run cut to the words and neighbouring pairs whose keys are kept; its words keep their counts."""
        _, heads, lasts, _, marks, _ = next(self.grams(2))
        pairs = (heads << 32 | lasts)[np.isin(_keys(marks), kept)]
        at = np.flatnonzero(~self.opening[1:])
        follows = np.zeros(len(self.codes), bool)
        follows[at] = np.isin(self.codes[at] << 32 | self.codes[at + 1], pairs)
        used = follows.copy()
        used[1:] |= follows[:-1]
        opening = np.ones(len(self.codes), bool)
        opening[1:] = ~follows[:-1]
        words = np.isin(_keys(self.marks), kept)
        words[self.codes[used]] = True
        chosen = np.flatnonzero(words)
        place = np.cumsum(words) - 1
        return _row(
            place[self.codes[used]], opening[used], [self.words[i] for i in chosen], self.word_langs[chosen], self.counts[chosen], self.langs,
            [0] * len(self.langs),
        )

    def phrases(self, kept, longest):
        """(first word, size, phrase, count) of all words and pairs, and of the longer phrases whose keys are kept."""
        words = pa.array(self.words, pa.binary())
        first, text = np.arange(len(words)), words
        yield first, 1, words, self.counts
        for size, heads, lasts, counts, _, good in self.grams(longest, lambda size, marks: np.isin(_keys(marks), kept) if size > 2 else np.ones(len(marks), bool)):
            text = pc.binary_join_element_wise(text.take(pa.array(heads)), words.take(pa.array(lasts)), b" ")
            first = first[heads]
            yield first[good], size, text.filter(pa.array(good)), counts[good]


def _rows(batch, names):
    """The rows of an Arrow batch, one at a time."""
    for row in range(batch.num_rows):
        yield tuple(batch.column(name)[row].as_py() for name in names)


def _ranges(bits, keys_of):
    """Each run's keys in order, with counts up to 255, cut at the ranges of the first ``bits`` bits."""
    rest = KEY_BITS - bits

    def send(batches):
        for batch in batches:
            for run, *columns in _rows(batch, ("run", *CODED)):
                keys, counts = keys_of(_Coded(*columns))
                order = np.argsort(keys)
                keys, counts = keys[order], np.minimum(counts[order], 255).astype(np.uint8)
                parts, starts = np.unique(keys >> np.uint64(rest), return_index=True)
                low = (keys & np.uint64((1 << rest) - 1)).astype(np.uint32)
                cuts = [*starts, len(keys)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), run, np.int64)),
                        pa.array([low[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    names=["range", "run", "keys", "counts"],
                )

    return send


def _merge(least):
    """Merges the sorted runs of a range: each run gets its keys whose counts add up to ``least``."""

    def answer(table):
        lists = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        keys = np.concatenate(lists)
        counts = np.concatenate([np.frombuffer(c, np.uint8) for c in table.column("counts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        enough = np.add.reduceat(counts[order], heads, dtype=np.int64) >= least
        kept = np.zeros(len(keys), bool)
        kept[order] = np.repeat(enough, np.diff(np.r_[heads, len(keys)]))
        ends = np.cumsum([len(one) for one in lists])
        found = [one[kept[end - len(one) : end]].tobytes() for one, end in zip(lists, ends)]
        return pa.table({"range": table.column("range"), "run": table.column("run"), "kept": pa.array(found, pa.binary())})

    return answer


def _answered(bits, function):
    """A function of (run, its kept keys) to Arrow data, for a run with the answers it got."""
    rest = np.uint64(KEY_BITS - bits)

    def apply(runs, answers):
        parts = [
            np.frombuffer(kept, np.uint32).astype(np.uint64) | np.uint64(part) << rest
            for part, kept in zip(answers.column("range").to_pylist(), answers.column("kept").to_pylist())
        ]
        kept = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        [columns] = zip(*(runs.column(c).to_pylist() for c in CODED))
        return function(runs.column("run")[0].as_py(), _Coded(*columns), kept)

    return apply


def _asked(runs, bits, keys_of, least):
    """What the ranges answer to the keys of all runs."""
    sent = runs.mapInArrow(_ranges(bits, keys_of), KEYS).groupBy("range")
    return sent.applyInArrow(_merge(min(least, 255)), "range int, run long, kept binary").where(F.octet_length("kept") > 0)


def phrase_counts(runs, least, longest):
    """(lang, words, n) of all phrases of up to ``longest`` words that occur ``least`` times or more in a language."""
    found = runs.agg(F.coalesce(F.sum(F.aggregate("totals", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)).alias("n")).first()["n"]
    bits = min(max(FEWEST_RANGE_BITS, int(2 * found // KEYS_PER_RANGE).bit_length()), 30)

    def cut(run, coded, kept):
        return pa.Table.from_batches([coded.reduced(kept)]).append_column("run", pa.array([run], pa.int64()))

    def count(_, coded, kept):
        names, out = pa.array(coded.langs, pa.string()), []
        for first, size, phrase, n in coded.phrases(kept, longest):
            lang = names.take(pa.array(coded.word_langs[first]))
            out.append(pa.table([lang, phrase, pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"]))
        return pa.concat_tables(out)

    answers = _asked(runs, bits, _Coded.short, least)
    reduced = stage(runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_answered(bits, cut), f"{RUNS}, run long"), "reduced")
    answers = _asked(reduced, bits, lambda coded: coded.long(longest), least)
    counted = reduced.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_answered(bits, count), PHRASES)
    counted = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return counted.select("lang", F.split(F.col("phrase").cast("string"), " ").alias("words"), "n")


def _scan(table):
    """A sorted stream read with a stack of the phrases that begin the current one.

    Rows that are not ``own`` are beginnings of the first phrase that lie in an
    earlier range.  A phrase is complete when the next one does not begin with
    it; then its best extension by one word is known.
    """
    columns = [table.column(c).to_pylist() for c in ("lang", "words", "own", "n")]
    rows = sorted(zip(*columns), key=lambda r: (r[0], [w.encode() for w in r[1]]))
    stack, done = [], []
    for lang, words, own, n in rows:
        while stack and (stack[-1][0] != lang or words[: len(stack[-1][1])] != stack[-1][1]):
            done.append(stack.pop())
        if stack:
            stack[-1][5] = max(stack[-1][5], n)
        stack.append([lang, words, own, n, [above[3] for above in stack], 0])
    done += stack
    names = ["lang", "words", "own", "n", "parts", "extension"]
    types = [pa.string(), pa.list_(pa.string()), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)


def _in_order(counts, rows, name):
    """The scanned stream of ``counts`` in the order of its words.

    Ranges of the order may begin anywhere; a range is given the beginnings of
    its first phrase, at most one fewer than a phrase has words.
    """
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
    ranged = stage(counts.repartitionByRange(parts, "lang", "words").withColumn("part", F.spark_partition_id()), name)
    heads = ranged.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("head")).where(F.size("head.words") > 1)
    before = heads.select("part", F.col("head.lang").alias("lang"), "head.words", F.explode(F.sequence(F.lit(1), F.size("head.words") - 1)).alias("k"))
    before = before.select("part", "lang", F.slice("words", F.lit(1), F.col("k")).alias("words"))
    seeds = counts.join(F.broadcast(before), ["lang", "words"]).select("part", "lang", "words", F.lit(False).alias("own"), "n")
    rows = ranged.select("part", "lang", "words", F.lit(True).alias("own"), "n").union(seeds)
    return stage(rows.groupBy("part").applyInArrow(_scan, SCANNED), name)


def _best(rows, most, limit):
    """The first ``limit`` of each language with their rank; ever fewer salted groups, so no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = -(-most // ROWS_PER_TASK)
    while salts > 1:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        rows = salted.withColumn("rank", place).where(F.col("rank") <= limit).drop("salt", "rank")
        salts = salts * limit // ROWS_PER_TASK
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= limit)


def mine(docs, text_col="text", lang_col="lang", least=30, longest=4, limit=2000, scale=2_000_000, absorb=(80, 100)):
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that hold together best.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks,
    and into words at spaces and tabs.  ``n`` counts all words of the language.
    Candidates are phrases of two to ``longest`` words that occur ``a`` times,
    ``least`` or more, overlaps included.  A candidate is scored at its weakest
    cut, ``scale * a / (l + r)`` rounded down, ties at the leftmost.  It is
    dropped if a longer candidate that holds it occurs at least
    ``absorb[0]/absorb[1]`` as often; an extension by one word suffices to tell,
    as it occurs as often as any longer one.  Ties go by ``a``, then by phrase in
    byte order.

    A null language is ``und``, a null text empty.  Repeated rows count as often
    as they stand there.  A table without frequent phrases gives no rows.  A text
    has to fit into a task; other columns are not read.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    runs = stage(rows.mapInArrow(_runs, RUNS).withColumn("run", F.monotonically_increasing_id()), "runs")
    totals = runs.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
    counts = stage(phrase_counts(runs, least, longest), "phrases")
    size = counts.count()
    turned = counts.select("lang", F.reverse("words").alias("words"), "n")
    from_left, from_right = _in_order(counts, size, "prefix-order"), _in_order(turned, size, "suffix-order")
    ends = from_right.withColumn("words", F.reverse("words"))
    # at most a few rows for each range
    across = from_left.unionByName(ends).where(~F.col("own") & (F.col("extension") > 0)).groupBy("lang", "words").agg(F.max("extension").alias("beyond"))
    both = (
        from_left.where("own").select("lang", "words", F.col("n").alias("a"), F.col("parts").alias("lefts"), F.col("extension").alias("after"))
        .join(ends.where("own").select("lang", "words", F.col("parts").alias("rights"), F.col("extension").alias("before")).hint("merge"), ["lang", "words"])
        .where(F.size("words") > 1).join(F.broadcast(across), ["lang", "words"], "left")
    )
    exact = "decimal(20,0)"
    longer = F.greatest("after", "before", F.coalesce("beyond", F.lit(0)))
    kept = both.where(longer.cast(exact) * F.lit(absorb[1]).cast("decimal(10,0)") < F.col("a").cast(exact) * F.lit(absorb[0]).cast("decimal(10,0)"))
    # the first k words are the k-th part from the left; the rest is as long as it is from the right
    cuts = F.expr(
        f"transform(sequence(1, size(words) - 1), k -> struct((cast(a as {exact}) * cast({scale} as decimal(10,0))) div "
        "(lefts[k - 1] + rights[size(words) - k - 1]) as score, k as k, lefts[k - 1] as l, rights[size(words) - k - 1] as r))"
    )
    scored = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.array_min(cuts).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    best = _best(scored, size, limit)
    named = lookup_join(best, stage_sized(totals, "totals"), "lang", spread=["phrase"])
    return named.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
