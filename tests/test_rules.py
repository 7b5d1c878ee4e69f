"""Rules and refinement against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.constants import FIELDS, LABELS, LEGACY_RULE_LABELS
from tagloom.operators import rules as R
from tagloom.operators.alignment import aggregate_nodes_by_file, dump_nodes, file_elements, with_file_elements
from tagloom.plans.refinement import AlignmentError, check_alignment
from tagloom.sources import views
from tagloom.staging import stage, stage_sized

SCHEMA = "sample_id long, " + ", ".join(f"{l} int" for l in LABELS) + ", " + ", ".join(f"{f} array<string>" for f in FIELDS)


def make_rows(seed, n=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(n):
        labels = [int(rng.random() < 0.25) for _ in LABELS[:-1]] + [0]  # the last label has no positives
        sets = [sorted({rng.choice(words) for _ in range(rng.randint(0, size))}) for size in (9, 5, 3)]
        rows.append((i, *labels, *sets))
    return rows


def spec_rules(rows, labels, threshold, legacy, caps=None):
    out = set()
    for f, field in enumerate(FIELDS):
        sets = [set(r[1 + len(LABELS) + f]) for r in rows]
        universe = set().union(*sets)
        freq = {}
        for l in labels:
            own = [s for r, s in zip(rows, sets) if r[1 + LABELS.index(l)]]
            below = max(len(universe), 1) if legacy else max(len(own), 1)
            freq[l] = {t: 100.0 * sum(t in s for s in own) / below for t in universe}
        for l in labels:
            for t in universe:
                own = freq[l][t]
                high = max(freq[o][t] for o in labels if o != l)
                low = min(freq[o][t] for o in labels if o != l)
                if legacy:
                    low = min(low, (caps or {}).get(field, 10000))
                    pos = own / high if high else (1000 if own else 0)
                    neg = low / own if low and own else (1000 if low else 0)
                else:
                    pos = own / high if high else (float("inf") if own else 0)
                    neg = low / own if own else (float("inf") if low else 0)
                out |= {(l, field, p, t) for p, v in (("pos", pos), ("neg", neg)) if v > threshold}
    return out


@pytest.mark.parametrize("legacy, caps", [(False, None), (True, None), (True, {"ids": 40.0, "calls": 20.0, "controls": 10.0})])
def test_rules(spark, legacy, caps):
    rows = make_rows(4)
    labels = LEGACY_RULE_LABELS if legacy else LABELS
    elements = spark.createDataFrame(rows, SCHEMA)
    freqs = R.prevalence_by_universe(elements, labels) if legacy else R.prevalence_by_label(elements, labels)
    table = R.build_rule_table(freqs, labels, 1.2, legacy, caps)
    got = {(r.label, r.field, r.polarity, r.token) for r in table.collect()}
    assert got == spec_rules(rows, labels, 1.2, legacy, caps)


@pytest.mark.parametrize("legacy", [False, True])
@pytest.mark.parametrize("limit", [None, -1])
@pytest.mark.parametrize("strict", [True, False])
def test_refinement(spark, monkeypatch, legacy, limit, strict):
    """Also with a broadcast limit below every size, so that the salted join is taken."""
    if limit is not None:
        import tagloom.staging as staging

        monkeypatch.setattr(staging.Sized, "fits", lambda self, limit=0: False)
    train, test = make_rows(4), make_rows(9)
    labels = LEGACY_RULE_LABELS if legacy else LABELS
    rules = spec_rules(train, labels, 1.2, legacy)
    rng = random.Random(1)
    scores = {r[0]: [rng.random() for _ in LABELS] for r in test}
    expected, flips, right = {}, 0, 0
    for r in test:
        sets = dict(zip(FIELDS, map(set, r[1 + len(LABELS):])))
        row = []
        for k, l in enumerate(LABELS):
            value = int(scores[r[0]][k] >= 0.5)
            hit = {(p, f): any((l, f, p, t) in rules for t in sets[f]) for p in ("pos", "neg") for f in FIELDS}
            if strict:
                up, down = hit["pos", "ids"] and hit["pos", "calls"], all(hit["neg", f] for f in FIELDS)
            else:
                up, down = any(hit["pos", f] for f in FIELDS), any(hit["neg", f] for f in FIELDS)
            start = value
            if value == 0 and up:
                value, flips, right = 1, flips + 1, right + r[1 + k]
            if (value if legacy else start) == 1 and down:
                value, flips, right = 0, flips + 1, right + (1 - r[1 + k])
            row.append(value)
        expected[r[0]] = row
    elements = spark.createDataFrame(test, SCHEMA)
    _, masks = R.learn_rules(spark.createDataFrame(train, SCHEMA), labels, 1.2, legacy)
    hits = R.rule_hits(elements, masks)
    scored = spark.createDataFrame(
        [(r[0], *scores[r[0]], *r[1 : 1 + len(LABELS)]) for r in test],
        "sample_id long, " + ", ".join(f"score_{l} double" for l in LABELS) + ", " + ", ".join(f"true_{l} int" for l in LABELS),
    )
    refined = R.refine(
        scored, hits, LABELS, labels, 0.5, sequential=legacy, positive_needs_both=strict, negative_needs_all=strict
    )
    assert {r.sample_id: [r[f"pred_{l}"] for l in LABELS] for r in refined.collect()} == expected
    stats = R.refinement_stats(refined).first()
    assert (stats.affected, stats.correct) == (flips, right)


def test_node_rows_give_the_sets_of_their_cells(spark, sf_dir):
    """Short files included: the rule on the length of a cell holds for the whole file."""
    rows = stage(views.samples(spark, sf_dir).where("sample_id < 60"))
    short = [("a/1.cpp", i, "IDENTIFIER", f"x{i}", "") for i in range(1)] + [("a/2.cpp", i, "IDENTIFIER", f"longName{i}", "") for i in range(50)]
    short += [("a/2.cpp", 60, "CALL", "goTo", ""), ("a/2.cpp", 61, "CONTROL_STRUCTURE", "", "while")]
    nodes = stage(dump_nodes(rows).unionByName(spark.createDataFrame(short, "filename string, line_no long, label string, value string, code string")))
    cells = aggregate_nodes_by_file(nodes)
    assert cells.count() == nodes.select("filename").distinct().count()
    tidy = lambda frame: {(r.filename, *[tuple(sorted(r[f])) for f in FIELDS]) for r in frame.collect()}
    sets = tidy(file_elements(nodes))
    assert sets == tidy(R.elements_from_cells(cells))
    assert ("a/1.cpp", (), (), ()) in sets and any(s[0] == "a/2.cpp" and s[2:] == (("go", "to"), ("while",)) for s in sets)
    joined = with_file_elements(rows, file_elements(nodes))
    assert joined.count() == rows.count() and joined.where(F.size("ids") > 0).count() == rows.count()


def test_alignment_gate(spark):
    rows = spark.createDataFrame([r[: 1 + len(LABELS)] for r in make_rows(4)], SCHEMA.split(", ids")[0])
    assert check_alignment(rows, rows).labels_match == 1
    with pytest.raises(AlignmentError):
        check_alignment(rows, rows.where("sample_id > 0"))
    with pytest.raises(AlignmentError):  # as long, with one id twice in place of another
        check_alignment(rows, rows.where("sample_id > 0").unionByName(rows.where("sample_id = 1")))
    with pytest.raises(AlignmentError):
        check_alignment(rows.unionByName(rows), rows.unionByName(rows))
    with pytest.raises(AlignmentError):
        check_alignment(rows, rows.withColumn("dos", 1 - F.col("dos")))


def test_rank_and_measure(spark):
    table = spark.createDataFrame(
        [("dos", "ids", "pos", t, r) for t, r in (("b", 2.0), ("a", 2.0), ("c", 9.0))],
        "label string, field string, polarity string, token string, ratio double",
    )
    assert {r.token: r["rank"] for r in R.rank_ratio(table).collect()} == {"c": 1, "a": 2, "b": 3}
    sized = stage_sized(table)
    assert sized.rows == 3 and sized.fits() and not sized.fits(10)
