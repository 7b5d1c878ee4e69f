"""Document rates that mix a corpus to target domain weights, with soft domain membership.

Everything is a DataFrame or SQL function: a classifier fitted on a labelled
table gives each document a posterior over domains, and projected gradient steps
fit nonnegative rates whose expected token totals per domain match the targets.
"""

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

from tagloom.staging import stage

# A run of characters between words; symbols and capitals whose share of a text is a feature.
BREAK = r"[\x00-/:-@\[-`{-\x7f]+"
NOT_SYMBOL = r"[^!#$%&*|<>{}=+~^@\\]+"
NOT_CAPITAL = r"[^A-Z]+"
ALL, PLAIN = "#doc", "#plain"
MOST_DOMAINS = 500


class NotConverged(RuntimeError):
    """Rates neither meet the targets nor have come to rest within the steps allowed."""


class Unmet(UserWarning):
    """Rates have come to rest, but the targets cannot be met; says by how many tokens each domain misses its own."""


@dataclass(frozen=True)
class Classifier:
    """Domains, their shares among labelled rows, the lexicon, and the table (token, w_0 ... w_K-1)."""

    domains: tuple
    lexicon: tuple
    weights: object


def _share(part, whole, name):
    ratio = part / F.greatest(whole, F.lit(1))
    level = F.when(part == 0, 0).when(ratio < 0.01, 1).when(ratio < 0.05, 2).when(ratio < 0.2, 3).when(ratio < 0.5, 4).otherwise(5)
    return F.concat(F.lit(f"#{name}:"), level.cast("string"))


def described(docs, id_col, text_col):
    """(id, mark, tokens, features): word count, and distinct words plus tokens for the shape of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.length(text).alias("chars"),
        F.length(F.regexp_replace(text, NOT_SYMBOL, "")).alias("symbols"), F.length(F.regexp_replace(text, NOT_CAPITAL, "")).alias("capitals"),
        F.array_remove(F.split(F.lower(text), BREAK), "").alias("words"),
    )
    counted = split.withColumn("tokens", F.size("words")).withColumn("words", F.array_distinct("words"))
    repeats = F.col("tokens") - F.size("words")
    shape = F.array(
        _share(F.col("symbols"), F.col("chars"), "symbols"), _share(F.col("capitals"), F.col("chars"), "capitals"),
        _share(F.when(F.col("tokens") >= 20, F.greatest(repeats - F.col("tokens") / 2, F.lit(0))).otherwise(0), F.col("tokens"), "repeats"),
    )
    return counted.select("id", "mark", F.col("tokens").cast("long").alias("tokens"), F.concat(shape, F.col("words")).alias("features"))


def _known(features, lexicon):
    """The features of a text that have a weight: those of the lexicon, one for any text, one if no word matched."""
    matched = F.array_intersect(features, F.array(*(F.lit(t) for t in lexicon)) if lexicon else F.array().cast("array<string>"))
    words = F.filter(matched, lambda t: ~t.startswith("#"))
    return F.concat(F.array(F.lit(ALL)), F.when(F.size(words) == 0, F.array(F.lit(PLAIN))).otherwise(F.array().cast("array<string>")), matched)


def fit(docs, labels, id_col="doc_id", text_col="text", domain_col="domain", fit_rows=20_000, lexicon_size=512, shrink=30):
    """A naive Bayes classifier of the labelled rows' domains, on presence of telling words and of shapes.

    Fitted on a bounded sample: about ``fit_rows`` labelled rows, drawn by a hash
    of the id, every domain among them, and the ``lexicon_size`` words that tell
    most among those with which some domain is at least twice as likely.  A domain
    is a column of all later tables; over ``MOST_DOMAINS`` of them are an error.  A feature's effect on the odds is shrunk as by
    ``shrink`` further rows of the overall shares, so rare words tell little.
    The sample's ids are the only thing broadcast here.  Rows with a null id or
    domain are not learned from; a labelled id counts once, with the least of its
    domains, and equal texts count once, null ones as empty.  Ties go to the
    smaller name.  Other columns are not read.
    """
    given = labels.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).dropna()
    total = max(given.count(), 1)
    drawn = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < F.lit(int(min(1.0, fit_rows / total) * (1 << 30)))
    sample = stage(given.where(drawn).groupBy("id").agg(F.min("domain").alias("domain")), "labels")
    rows = docs.join(F.broadcast(sample.withColumnRenamed("id", id_col)), id_col, "left_semi")
    texts = described(rows, id_col, text_col).join(F.broadcast(sample), "id")
    learned = stage(texts.groupBy("mark").agg(F.min_by("domain", "id").alias("domain"), F.min_by("features", "id").alias("features")), "learned")
    found = learned.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(MOST_DOMAINS + 1).collect()
    if len(found) > MOST_DOMAINS:
        raise ValueError(f"over {MOST_DOMAINS} domains; merge some of them")
    domains = tuple(r["domain"] for r in found)
    each = [F.sum((F.col("domain") == d).cast("long")).alias(f"n_{k}") for k, d in enumerate(domains)]

    def counted(features):
        exploded = learned.select("domain", F.explode(features).alias("token"))
        return exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *each)

    every = learned.agg(F.count(F.lit(1)).alias("n"), *each).first()
    if not domains:
        return Classifier((), (), None)
    shares = [every[f"n_{k}"] / every["n"] for k in range(len(domains))]
    odds = [F.log((F.col(f"n_{k}") + shrink * p) / (F.col("n") + shrink) / p) for k, p in enumerate(shares)]
    weights = [w.alias(f"w_{k}") for k, w in enumerate(odds)]
    told = reduce(lambda a, b: a + b, [F.col(f"n_{k}") * w for k, w in enumerate(odds)])
    counts = stage(counted(F.col("features")), "tokens").withColumn("told", told).withColumn("most", F.greatest(*odds, F.lit(float("-inf"))))
    word = ~F.col("token").startswith("#")
    telling = counts.where(word & (F.col("most") >= 0.6931)).orderBy(F.desc("told"), "token").limit(lexicon_size)
    chosen = stage(telling.select("token", *weights).union(counts.where(~word).select("token", *weights)), "lexicon")
    lexicon = tuple(sorted(r["token"] for r in chosen.select("token").collect()))
    plain = counted(_known(F.col("features"), lexicon)).where(F.col("token") == PLAIN).select("token", *weights)
    prior = learned.agg(F.count(F.lit(1)).alias("n"), *each).select(
        F.lit(ALL).alias("token"), *(F.log((F.col(f"n_{k}") + 0.5) / (F.col("n") + 0.5 * len(domains))).alias(f"w_{k}") for k in range(len(domains)))
    )
    return Classifier(domains, lexicon, stage(chosen.union(plain).union(prior), "weights"))


def memberships(docs, classifier, id_col="doc_id", text_col="text"):
    """(id, mark, tokens, rows, p_0 ... p_K-1): posterior over domains per distinct (id, text).

    ``mark`` is a hash of the text, ``rows`` how often the pair occurs.  Matched
    features are weighed by a broadcast of the bounded lexicon and summed with
    map-side combine, so one short row per document is shuffled.  Without any
    labelled row there are no domains and no result rows.
    """
    if classifier.weights is None:
        nothing = F.lit(0).cast("long")
        return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), nothing.alias("tokens"), nothing.alias("rows")).limit(0)
    domains = range(len(classifier.domains))
    known = F.explode(_known(F.col("features"), classifier.lexicon)).alias("token")
    matched = described(docs, id_col, text_col).select("id", "mark", "tokens", known)
    summed = (
        matched.join(F.broadcast(classifier.weights), "token").groupBy("id", "mark")
        .agg(
            F.min("tokens").alias("tokens"), F.sum((F.col("token") == ALL).cast("long")).alias("rows"), *(F.sum(f"w_{k}").alias(f"s_{k}") for k in domains),
        )
    )
    scores = [F.col(f"s_{k}") / F.col("rows") for k in domains]
    top = F.array_max(F.array(*scores))
    raised = summed.select("id", "mark", "tokens", "rows", *(F.exp(s - top).alias(f"e_{k}") for k, s in enumerate(scores)))
    whole = reduce(lambda a, b: a + b, [F.col(f"e_{k}") for k in domains])
    return raised.select("id", "mark", "tokens", "rows", *((F.col(f"e_{k}") / whole).alias(f"p_{k}") for k in domains))


def fit_rates(members, domains, targets, max_rate=None, goal=None, anchor=None, tolerance=1e-3, rest=0.01, most_steps=500, steps_per_table=8):
    """``members`` with a rate per row: expected domain totals of tokens as near to the targets as they get.

    ``targets`` maps domains to weights, which are normalised; a domain without
    one has weight 0.  The targets are these shares of ``goal`` tokens: all
    tokens, or with ``max_rate`` no more than every domain can give.  With
    ``max_rate`` and an ``anchor``, all that this domain can give is its share of
    the goal, and a domain that cannot reach its own share only has it as an
    upper bound: it falls short and has no part in the sum below, so its
    scarcity lowers no rate.  An anchor that no labelled row has is an error.

    From rate 1, each step lowers the sum over domains of (total - target)^2 / current
    total along its gradient and clips at 0 and ``max_rate``.  That scaling makes
    a length of 1 safe and treats large and small domains alike; later lengths
    follow the curvature that the last step met.  The steps end when every
    total is within ``tolerance`` of its target, or when the projected gradient
    vanishes: a step moves the rates by no more than ``rest`` squared in the
    weighted mean square, or the last 24 have lowered that sum by no more than the
    share ``rest``; an ``Unmet`` warning then names the tokens that each domain
    misses.  ``most_steps`` without either raise ``NotConverged``.  A
    step is one aggregate of a few numbers; the rates between written tables are an
    expression, so a lost task recomputes them.
    """
    count = range(len(domains))
    weight = F.col("tokens") * F.col("rows")
    state = stage(members.withColumn("rate", F.lit(1.0)), "rates")
    if not len(domains):
        return state
    totals = state.agg(*(F.sum(weight * F.col(f"p_{k}")).alias(f"t_{k}") for k in count)).first()
    now = [totals[f"t_{k}"] or 0.0 for k in count]
    asked = [max(0.0, targets.get(d, 0.0)) for d in domains]
    share = [a / (sum(asked) or 1.0) for a in asked]
    scarce = [False] * len(domains)
    if anchor is not None:
        if max_rate is None or goal is not None:
            raise ValueError("an anchor sets the goal of rates with a bound")
        if anchor not in domains or not share[domains.index(anchor)]:
            raise ValueError(f"no labelled row or no target for the anchor {anchor!r}")
        goal = max_rate * now[domains.index(anchor)] / share[domains.index(anchor)]
        scarce = [d != anchor and max_rate * t <= goal * s for d, t, s in zip(domains, now, share)]
    if goal is None:
        goal = sum(now)
        if max_rate is not None:
            goal = min([goal, *(max_rate * t / s for t, s in zip(now, share) if s and t)])
    wanted = [goal * s for s in share]
    rate, before, last, taken, length = F.col("rate"), F.lit(1.0), None, 0, 1.0
    heights, volume = [], max(sum(now), 1.0)
    while True:
        moved = F.sum(weight * (rate - before) * (rate - before)).alias("moved")
        got = state.agg(moved, *(F.sum(weight * rate * F.col(f"p_{k}")).alias(f"t_{k}") for k in count)).first()
        off = [0.0 if scarce[k] else (got[f"t_{k}"] or 0.0) - w for k, w in zip(count, wanted)]
        if all(abs(o) <= tolerance * max(w, goal / len(domains) * tolerance) for o, w in zip(off, wanted)):
            break
        heights.append(sum(o * o / t for o, t in zip(off, now) if t))
        best = min(heights)
        still = taken >= 24 and heights[-1] <= (1 + rest) * best and best >= (1 - rest) * min(heights[:-24])
        if still or taken and (got["moved"] or 0.0) <= (rest * rest) ** 2 * volume:
            warnings.warn(Unmet({d: round(o) for d, o in zip(domains, off)}), stacklevel=2)
            break
        if taken >= most_steps:
            raise NotConverged(f"after {taken} steps domains miss their targets by {dict(zip(domains, off))} tokens")
        if last:
            bent = sum((o - q) ** 2 / t for o, q, t in zip(off, last, now) if t)
            length = min(20.0, max(1.0, (got["moved"] or 0.0) / bent)) if bent else 1.0
        slope = reduce(lambda a, b: a + b, [F.col(f"p_{k}") * (length * o / t if t else 0.0) for k, o, t in zip(count, off, now)])
        before, rate, last = rate, F.greatest(rate - slope, F.lit(0.0)), off
        if max_rate is not None:
            rate = F.least(rate, F.lit(float(max_rate)))
        taken += 1
        if taken % steps_per_table == 0:
            state = stage(state.select(*members.columns, before.alias("before"), rate.alias("rate")), "rates")
            rate, before = F.col("rate"), F.col("before")
    return state.select(*members.columns, rate.alias("rate"))


def take(rate, *key, seed=99):
    """Whole copies with the rate as their expectation: the fraction is drawn by a hash of the key."""
    drawn = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")
