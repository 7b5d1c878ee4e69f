"""Distinguishing tokens and rule-based refinement of predictions.

Counts are kept wide: one row per (field, token) with a count per label.  One
shuffle with map-side sums builds them, and "the highest frequency among the
other labels" is then an expression over the row instead of a window or self-join.
Rules travel as two label masks per token.
"""

from pyspark.sql import functions as F

from ..constants import FIELDS, LABELS, LEGACY_RULE_LABELS
from ..functions.elements import calls, controls, identifiers, node_tokens, parse_cell, pseudo_cell
from ..staging import BROADCAST_BYTES, lookup_join, number_within, stage, stage_sized
from .metrics import stack

# Ratio when nothing is left to divide by, and the cap of the lowest other frequency.
LEGACY_RATIO = 1000.0
LEGACY_CAP = 10000.0
NOTEBOOK_CAPS = {"ids": 10000.0, "calls": 1000.0, "controls": 1000.0}


def build_elements(rows, text="text"):
    """Adds the token sets ``ids``, ``calls`` and ``controls``."""
    column = F.col(text)
    return rows.withColumns(
        {"ids": identifiers(column), "calls": calls(column), "controls": controls(column)}
    )


def elements_from_cells(rows, min_chars=100, legacy=False, text="text"):
    """Token sets from the ``cpg`` cell, which is made from the text where the column is absent."""
    if "cpg" not in rows.columns:
        rows = rows.withColumn("cpg", pseudo_cell(text))
    parsed = rows.withColumn("_nodes", parse_cell("cpg", min_chars))
    ids, call_set, control_set = node_tokens("_nodes", legacy)
    return parsed.withColumns({"ids": ids, "calls": call_set, "controls": control_set}).drop("_nodes")


def select_label_columns(rows, labels=LEGACY_RULE_LABELS, text="text"):
    """Code, label columns and parsed nodes only."""
    return rows.select(F.col(text).alias("code"), *labels, parse_cell("cpg").alias("elements"))


def field_tokens(elements, keep=("sample_id",), fields=FIELDS):
    """(keys, field, token) rows; one scan for all fields."""
    sets = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("tokens")) for f in fields])
    return (
        elements.select(*keep, F.explode(sets).alias("_s"))
        .select(*keep, "_s.field", F.explode("_s.tokens").alias("token"))
    )


def token_universe(elements, fields=FIELDS):
    return field_tokens(elements, (), fields).distinct()


def token_counts(elements, labels=LABELS):
    """Documents per (field, token) and label, wide; every token of the table has a row."""
    sums = [F.expr(f"sum(cast({l} AS bigint)) AS n_{l}") for l in labels]
    return field_tokens(elements, labels).groupBy("field", "token").agg(*sums)


def label_sizes(elements, labels=LABELS):
    """One struct of documents per label, as a scalar subquery."""
    sums = F.expr("named_struct(" + ", ".join(f"'{l}', sum(cast({l} AS bigint))" for l in labels) + ")")
    return elements.agg(sums.alias("sizes")).scalar()


def universe_sizes(counts):
    """Map field → number of distinct tokens (three entries), as a scalar subquery."""
    sizes = counts.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.map_from_entries(F.collect_list(F.struct("field", "n"))).alias("m")).scalar()


def prevalence(counts, labels=LABELS, sizes=None, universe=None):
    """Percent frequencies ``f_<label>``: by documents of the label, or by universe size."""
    if universe is not None:
        sized = counts.withColumn("_d", F.element_at(universe, F.col("field")))
        below = dict.fromkeys(labels, "greatest(_d, 1)")
    else:
        sized = counts.withColumn("_d", sizes)
        below = {l: f"greatest(coalesce(_d.{l}, 0), 1)" for l in labels}
    return sized.selectExpr("field", "token", *[f"(n_{l} * 100.0D) / {below[l]} AS f_{l}" for l in labels])


def prevalence_by_label(elements, labels=LABELS):
    return prevalence(token_counts(elements, labels), labels, sizes=label_sizes(elements, labels))


def prevalence_by_universe(elements, labels=LEGACY_RULE_LABELS):
    counts = token_counts(elements, labels)
    return prevalence(counts, labels, universe=universe_sizes(counts))


def long_prevalence(wide, labels):
    return wide.selectExpr("field", "token", stack(("label", "freq"), *[(f"'{l}'", f"f_{l}") for l in labels]))


def _others(label, labels, fold):
    values = [f"f_{l}" for l in labels if l != label]
    return f"{fold}({', '.join(values)})" if len(values) > 1 else values[0]


def max_other(label, labels):
    return _others(label, labels, "greatest")


def min_other(label, labels):
    return _others(label, labels, "least")


def other_frequencies(freqs, labels):
    """Highest and lowest frequency among the other labels, per token and label."""
    rows = [(f"'{l}'", f"f_{l}", max_other(l, labels), min_other(l, labels)) for l in labels]
    return freqs.selectExpr("field", "token", stack(("label", "freq", "max_other", "min_other"), *rows))


def _positive(label, labels, threshold):
    own, other = f"f_{label}", max_other(label, labels)
    return f"if({other} > 0, {own} / {other} > {threshold}D, {own} > 0)", f"if({other} > 0, {own} / {other}, NULL)"


def _negative(label, labels, threshold):
    own, other = f"f_{label}", min_other(label, labels)
    return f"if({own} > 0, {other} / {own} > {threshold}D, {other} > 0)", f"if({own} > 0, {other} / {own}, NULL)"


def _positive_legacy(label, labels, threshold):
    own, other = f"f_{label}", max_other(label, labels)
    ratio = f"CASE WHEN {other} <> 0 THEN {own} / {other} WHEN {own} <> 0 THEN {LEGACY_RATIO}D ELSE 0D END"
    return f"({ratio}) > {threshold}D", ratio


def _negative_legacy(label, labels, threshold, caps):
    cap = f"{LEGACY_CAP}D"
    if caps:
        cap = "CASE field " + " ".join(f"WHEN '{f}' THEN {float(c)}D" for f, c in caps.items()) + " END"
    own, other = f"f_{label}", f"least({cap}, {min_other(label, labels)})"
    ratio = f"CASE WHEN {other} <> 0 AND {own} <> 0 THEN {other} / {own} WHEN {other} <> 0 THEN {LEGACY_RATIO}D ELSE 0D END"
    return f"({ratio}) > {threshold}D", ratio


def rule_columns(labels, threshold, legacy=False, caps=None):
    """[(label, polarity, keep, ratio)] as SQL over a row of frequencies."""
    out = []
    for label in labels:
        if legacy:
            pos, neg = _positive_legacy(label, labels, threshold), _negative_legacy(label, labels, threshold, caps)
        else:
            pos, neg = _positive(label, labels, threshold), _negative(label, labels, threshold)
        out += [(label, "pos", *pos), (label, "neg", *neg)]
    return out


def build_rule_table(freqs, labels=LABELS, threshold=1.5, legacy=False, caps=None):
    """Long rule table (label, field, polarity, token, ratio).

    A null ratio means that the token does not occur on the other side at all.
    """
    rows = [(f"'{l}'", f"'{p}'", k, f"cast({r} AS double)") for l, p, k, r in rule_columns(labels, threshold, legacy, caps)]
    rules = freqs.selectExpr("field", "token", stack(("label", "polarity", "keep", "ratio"), *rows))
    return rules.where("keep").select("label", "field", "polarity", "token", "ratio")


def rule_masks(freqs, labels=LABELS, threshold=1.5, legacy=False, caps=None):
    """Rules packed per token: bit k of ``pos_mask``/``neg_mask`` stands for label k."""
    columns = rule_columns(labels, threshold, legacy, caps)

    def mask(polarity):
        bits = [f"if({k}, {1 << labels.index(l)}, 0)" for l, p, k, _ in columns if p == polarity]
        return f"{' | '.join(bits)} AS {polarity}_mask"

    return freqs.selectExpr("field", "token", mask("pos"), mask("neg")).where("pos_mask <> 0 OR neg_mask <> 0")


def learn_rules(train_elements, labels=LABELS, threshold=1.5, legacy=False, caps=None):
    """Frequencies of the training table, staged, and its measured rule masks."""
    if legacy:
        freqs = prevalence_by_universe(train_elements, labels)
    else:
        freqs = prevalence_by_label(train_elements, labels)
    freqs = stage(freqs, "frequencies")
    return freqs, stage_sized(rule_masks(freqs, labels, threshold, legacy, caps), "rules")


def rank_ratio(rules):
    """Rank of each rule token by ratio inside its (label, field, polarity); ties by token."""
    return number_within(rules, ["label", "field", "polarity"], [F.desc("ratio"), F.col("token")], "rank")


def distinguishing_set(rules, label, field, polarity="pos"):
    return rules.where(
        (F.col("label") == label) & (F.col("field") == field) & (F.col("polarity") == polarity)
    ).select("token")


HIT_COLUMNS = tuple(f"{polarity}_{field}" for polarity in ("pos", "neg") for field in FIELDS)


def rule_hits(elements, rules, key="sample_id", limit=BROADCAST_BYTES):
    """Per sample and (polarity, field): the labels whose token set it meets, as masks.

    The join is on the token; partial bit-ors leave one row per sample to shuffle.
    Rules over ``limit`` bytes are joined by a shuffle of those tokens only that a
    Bloom filter of the rules lets pass.
    """
    matched = lookup_join(field_tokens(elements, (key,)), rules, ["field", "token"], spread=[key], limit=limit, selective=True)
    hits = [
        F.bit_or(F.when(F.col("field") == field, F.col(f"{polarity}_mask")).otherwise(F.lit(0))).alias(f"{polarity}_{field}")
        for polarity in ("pos", "neg")
        for field in FIELDS
    ]
    return matched.groupBy(key).agg(*hits)


def _combined(polarity, fields, every):
    return "(" + (" & " if every else " | ").join(f"coalesce({polarity}_{f}, 0)" for f in fields) + ")"


def refine(
    scored, hits, labels=LABELS, rule_labels=None, threshold=0.5, sequential=False,
    positive_needs_both=True, negative_needs_all=True, key="sample_id", how="left",
):
    """Flip thresholded predictions by rule hits.

    0 becomes 1 on positive hits; otherwise 1 becomes 0 on negative hits.  With
    ``sequential`` the second test also sees a cell just raised.  Result:
    ``pred_<label>`` after, ``before_<label>``, and per row the number of flips
    (``affected``) and of right flips (``correct``).
    """
    rule_labels = rule_labels or labels
    positive = _combined("pos", ("ids", "calls") if positive_needs_both else FIELDS, positive_needs_both)
    negative = _combined("neg", FIELDS, negative_needs_all)
    kept = [c for c in scored.columns if not c.startswith("pred_")]
    bit = {l: f"shiftright({{}}, {i}) & 1" for i, l in enumerate(rule_labels)}
    before = scored.join(hits, key, how).selectExpr(
        *kept, f"{positive} AS _pos", f"{negative} AS _neg",
        *[f"cast(score_{l} >= {float(threshold)}D AS int) AS before_{l}" for l in labels],
    )
    raised = before.selectExpr(
        "*", *[f"(1 - before_{l}) * ({bit[l].format('_pos')}) AS _up_{l}" for l in rule_labels]
    )
    standing = {l: f"(before_{l} + _up_{l})" if sequential else f"before_{l}" for l in rule_labels}
    flipped = raised.selectExpr(
        "*", *[f"{standing[l]} * ({bit[l].format('_neg')}) AS _down_{l}" for l in rule_labels]
    )
    after = {l: f"before_{l} + _up_{l} - _down_{l}" if l in rule_labels else f"before_{l}" for l in labels}
    counters = [" + ".join(f"_up_{l} + _down_{l}" for l in rule_labels) + " AS affected"]
    if f"true_{labels[0]}" in scored.columns:
        right = " + ".join(f"_up_{l} * true_{l} + _down_{l} * (1 - true_{l})" for l in rule_labels)
        counters.append(f"{right} AS correct")
    return flipped.selectExpr(
        *kept, *[f"before_{l}" for l in labels], *[f"{after[l]} AS pred_{l}" for l in labels], *counters
    )


def refinement_stats(refined):
    """Flips, right flips and their share (0 when nothing flipped)."""
    sums = refined.agg(
        F.coalesce(F.sum(F.col("affected").cast("long")), F.lit(0)).alias("affected"),
        F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("correct"),
    )
    rate = F.when(F.col("affected") > 0, F.col("correct") / F.col("affected")).otherwise(F.lit(0.0))
    return sums.withColumn("correction_rate", rate)


def rule_coverage(elements, hits, labels=LEGACY_RULE_LABELS, key="sample_id"):
    """Share of a label's positives that a positive rule meets: in any field, and in ids alone."""
    joined = elements.select(key, *labels).join(hits, key, "left")
    sums = []
    for i, l in enumerate(labels):
        for name, fields in (("any", FIELDS), ("ids", ("ids",))):
            sums.append(F.expr(f"sum({l} * (shiftright({_combined('pos', fields, False)}, {i}) & 1)) AS {name}_{l}"))
        sums.append(F.expr(f"coalesce(sum({l}), 0) AS n_{l}"))
    rows = [
        (f"'{l}'", f"n_{l}", *[f"if(n_{l} > 0, {name}_{l} / n_{l}, 0D)" for name in ("any", "ids")]) for l in labels
    ]
    return joined.agg(*sums).selectExpr(stack(("label", "positives", "any_share", "ids_share"), *rows))
