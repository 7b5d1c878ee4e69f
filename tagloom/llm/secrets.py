"""Secret scans over an inverted index of the trigrams that the rules need."""

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import fresh, in_slices
from tagloom.llm.trigrams import EVERYTHING, trigram_query
from tagloom.staging import stage, stage_sized


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches whose ``group`` has at least ``least`` characters; the span begins where group ``begin`` does.

    Rules are ASCII: with ``any_case`` letters match in either case, and letters
    of other scripts that fold to ASCII do not.
    """

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0
    begin: int = 0

    @property
    def flags(self):
        return re.ASCII | (re.IGNORECASE if self.any_case else 0)


# A run of a character class is taken whole, so a lower bound in the pattern keeps the same runs as one after it.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# These begin where a run of their characters does, so a long run is read once, not from each of its letters.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35})"),
    Rule("login", r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+)://[^\s/:@]++:[^\s/@]{3,}+@[A-Za-z0-9.-]+", begin=1),
)
RULES = BASE_RULES + MORE_RULES


@lru_cache(maxsize=1)
def _numbers(names):
    """From 1, the number of each trigram by its three bytes; made once for all tasks of a worker."""
    numbers = np.zeros(1 << 24, np.uint8 if len(names) < 256 else np.uint16)
    for number, name in enumerate(names, 1):
        a, b, c = name.encode()
        numbers[a << 16 | b << 8 | c] = number
    return numbers


def postings(texts, trigrams, text_col="text"):
    """(trigram, key): the index.  ``key`` is a hash of the text, so equal texts share their postings.

    Trigrams are three ASCII bytes of the text with A-Z lower-cased.  All of a
    text are looked up at once in a table of the mandatory ones.
    """
    names = tuple(sorted(trigrams))

    def look_up(part):
        numbers, keys, found = _numbers(names), part.column(0).to_numpy(), []
        for row, text in enumerate(part.column(1).to_pylist()):
            if text and len(text) > 2:
                codes = np.frombuffer(text.lower(), np.uint8).astype(np.int32)
                seen = np.unique(numbers[codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]])
                found += [(names[n - 1], keys[row]) for n in seen.tolist() if n]
        return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())]

    rows = texts.select(F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return in_slices(rows, [T.StructField("trigram", T.StringType()), T.StructField("key", T.LongType())], look_up)


def candidates(index, queries):
    """(key, mask): texts whose postings meet a rule's query; bit i stands for ``queries[i]``."""
    found = index.groupBy("key").agg(F.collect_set("trigram").alias("has"))

    def meets(query):
        every = lambda one: reduce(lambda a, b: a & b, [F.array_contains("has", t) for t in sorted(one)])
        return reduce(lambda a, b: a | b, [every(one) for one in sorted(query, key=sorted)])

    mask = F.lit(0)
    for bit, query in enumerate(queries):
        if query != EVERYTHING:
            mask = mask + F.when(meets(query), F.lit(1 << bit)).otherwise(0)
    return found.select("key", mask.alias("mask")).where("mask > 0")


def _spans_udf(rules):
    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(text: pd.Series, mask: pd.Series) -> pd.Series:
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        out = []
        for one, bits in zip(text, mask):
            found = []
            for order, (rule, pattern) in enumerate(zip(rules, compiled)):
                if one and bits >> order & 1:
                    found += [
                        (m.start(rule.begin), order, m.end()) for m in pattern.finditer(one) if m.end(rule.group) - m.start(rule.group) >= rule.least
                    ]
            found.sort()
            out.append([{"kind": rules[order].kind, "start": start, "end": end} for start, order, end in found])
        return pd.Series(out)

    return spans


def scan(docs, rules=RULES, text_col="text", out_col="spans", limit=32 * 1024 * 1024):
    """``docs`` with an array of (kind, start, end), code points, end exclusive, by start and then rule.

    Each rule's regex gives a Boolean trigram query.  The trigrams of all
    queries are indexed over all texts, each query intersects their postings,
    and the regex verifies the candidates it leaves.  Rules without a mandatory
    trigram scan every text.  The candidate table (a hash and a mask) is
    broadcast if its measured size allows, else both sides are shuffled by hash.

    Null and empty texts have an empty array.  Rows and other columns stay as
    they are; equal texts are judged alike.  A text of any length is read by each
    rule in one pass.  An added name that is taken gets an underscore in front.
    """
    [out_col] = fresh(docs, out_col)
    rules = tuple(rules)
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    everywhere = sum(1 << i for i, q in enumerate(queries) if q == EVERYTHING)
    key, mask = fresh(docs, "_text_key", "_rule_mask")
    trigrams = {t for q in queries for one in q for t in one}
    marked = docs.withColumn(key, F.xxhash64(text_col))
    if trigrams:
        found = stage_sized(candidates(stage(postings(docs, trigrams, text_col), "postings"), queries), "candidates")
        side = found.df.toDF(key, mask)
        side = F.broadcast(side) if found.fits(limit) else side.hint("merge")
        marked = marked.join(side, key, "left")
    else:
        marked = marked.withColumn(mask, F.lit(0))
    bits = F.coalesce(F.col(mask), F.lit(0)).bitwiseOR(F.lit(everywhere))
    return marked.select(*(F.col(f"`{c}`") for c in docs.columns), _spans_udf(rules)(F.col(text_col), bits).alias(out_col))


def listed(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
