"""Token prevalence, rules, refinement and the flows built on them."""

from pyspark.sql import functions as F

from ..constants import FIELDS, LABELS, LEGACY_RULE_LABELS
from ..operators import rules as R
from ..operators.alignment import dump_nodes, split_prediction_table
from ..plans.refinement import LEGACY_CONFIG, RefinementConfig, run_aligned_refinement, run_refinement
from ..sources import views, writers
from ..staging import scratch_path, stage
from .evaluation import metric_ctes, metric_rows
from .registry import query
from .views import call_names, calls, split_identifier, with_views


def _elements(spark, sf_dir, labels=LABELS):
    rows = R.build_elements(views.samples(spark, sf_dir))
    return stage(rows.select("sample_id", "split", *labels, *FIELDS), "elements")


def _train(spark, sf_dir):
    return _elements(spark, sf_dir).where("split = 'train'")


def _round(rows, *columns):
    return rows.withColumns({c: F.round(c, 6) for c in columns})


@query("a7_prevalence_by_label", with_views("SELECT label, field, token, round(freq, 6) AS freq FROM lib_freq", "lib"))
def prevalence_by_label(spark, sf_dir):
    return _round(R.long_prevalence(R.prevalence_by_label(_train(spark, sf_dir)), LABELS), "freq")


@query("a8_prevalence_by_universe", with_views("SELECT label, field, token, round(freq, 6) AS freq FROM leg_freq", "leg"))
def prevalence_by_universe(spark, sf_dir):
    return _round(R.long_prevalence(R.prevalence_by_universe(_train(spark, sf_dir)), LEGACY_RULE_LABELS), "freq")


@query(
    "w2_max_min_other_freq",
    with_views(
        "SELECT label, field, token, round(freq, 6) AS freq, round(max_other, 6) AS max_other, round(min_other, 6) AS min_other FROM lib_other",
        "lib",
    ),
)
def other_frequencies(spark, sf_dir):
    freqs = R.prevalence_by_label(_train(spark, sf_dir))
    return _round(R.other_frequencies(freqs, LABELS), "freq", "max_other", "min_other")


def _rule_query(name, legacy, polarity=None):
    prefix = "leg" if legacy else "lib"
    where = f" WHERE polarity = '{polarity}'" if polarity else ""

    def run(spark, sf_dir):
        table = _rules(_train(spark, sf_dir), legacy)
        if polarity:
            table = table.where(F.col("polarity") == polarity)
        return _round(table, "ratio")

    query(name, with_views(f"SELECT label, field, polarity, token, round(ratio, 6) AS ratio FROM {prefix}_rules{where}", prefix))(run)


def _rules(train, legacy):
    labels = LEGACY_RULE_LABELS if legacy else LABELS
    freqs = R.prevalence_by_universe(train, labels) if legacy else R.prevalence_by_label(train, labels)
    return R.build_rule_table(freqs, labels, legacy=legacy)


_rule_query("r1_positive_tokens", False, "pos")
_rule_query("r2_negative_tokens", False, "neg")
_rule_query("r3_freq_stat", True, "pos")
_rule_query("r4_infreq_stat", True, "neg")
_rule_query("r5_build_rule_table", False)
_rule_query("r5_build_rule_table_legacy", True)


@query(
    "r4_infreq_stat_by_field",
    with_views("SELECT label, field, polarity, token, round(ratio, 6) AS ratio FROM notebook_rules", "notebook"),
)
def capped_rules(spark, sf_dir):
    """With the cap of each field that the interactive version of the rules has."""
    freqs = R.prevalence_by_universe(_train(spark, sf_dir), LEGACY_RULE_LABELS)
    return _round(R.build_rule_table(freqs, LEGACY_RULE_LABELS, legacy=True, caps=R.NOTEBOOK_CAPS), "ratio")


@query(
    "k3_write_rule_table",
    with_views(
        "SELECT '{\"field\":\"' || field || '\",\"label\":\"' || label || '\",\"polarity\":\"' || polarity || '\",\"token\":\"' || token || '\"}' AS value FROM lib_rules",
        "lib",
    ),
)
def write_rule_table(spark, sf_dir):
    table = _rules(_train(spark, sf_dir), False).select("label", "field", "polarity", "token")
    return spark.read.text(writers.write_rule_table(table, scratch_path(spark, "rule-table")))


@query(
    "w3_rank_ratio",
    with_views(
        "SELECT label, field, polarity, token, row_number() OVER (PARTITION BY label, field, polarity ORDER BY ratio DESC, token) AS rank FROM leg_rules",
        "leg",
    ),
)
def rank_ratio(spark, sf_dir):
    return R.rank_ratio(_rules(_train(spark, sf_dir), True)).select("label", "field", "polarity", "token", "rank")


@query(
    "r10_distinguishing_set",
    with_views("SELECT token FROM leg_rules WHERE label = 'exec' AND field = 'ids' AND polarity = 'pos'", "leg"),
)
def distinguishing_set(spark, sf_dir):
    return R.distinguishing_set(_rules(_train(spark, sf_dir), True), "exec", "ids")


def _hits_cte(prefix, labels):
    """Hit masks of the test split: bit k stands for label k."""
    bit = "CASE label " + " ".join(f"WHEN '{l}' THEN {1 << i}" for i, l in enumerate(labels)) + " END"
    columns = ", ".join(
        f"bit_or(CASE WHEN field = '{f}' AND polarity = '{p}' THEN {bit} ELSE 0 END)::INTEGER AS {p}_{f}"
        for p in ("pos", "neg") for f in FIELDS
    )
    return (
        f"hits AS MATERIALIZED (SELECT sample_id, {columns} FROM element_tokens JOIN {prefix}_rules USING (field, token) "
        "WHERE split = 'test' GROUP BY sample_id)"
    )


def with_hits(select, prefix, labels, extra="", needs=()):
    base = with_views("", prefix, *needs).rstrip()
    tail = f",\n{extra}" if extra else ""
    return f"{base},\n{_hits_cte(prefix, labels)}{tail}\n{select}"


_HIT_COLUMNS = ", ".join(R.HIT_COLUMNS)


def _masks(elements, legacy):
    """Measured rule masks of the train split."""
    return R.learn_rules(elements.where("split = 'train'"), LEGACY_RULE_LABELS if legacy else LABELS, legacy=legacy)[1]


def _learned(spark, sf_dir, legacy):
    elements = _elements(spark, sf_dir)
    masks = _masks(elements, legacy)
    test = elements.where("split = 'test'")
    return test, R.rule_hits(test, masks)


@query("j7_rule_match", with_hits(f"SELECT sample_id, {_HIT_COLUMNS} FROM hits", "lib", LABELS))
def rule_match(spark, sf_dir):
    return _learned(spark, sf_dir, False)[1]


@query("j7_rule_match_filtered", with_hits(f"SELECT sample_id, {_HIT_COLUMNS} FROM hits", "lib", LABELS))
def rule_match_filtered(spark, sf_dir):
    """The way of rules too many to broadcast: a Bloom filter of them before the shuffle of tokens."""
    elements = _elements(spark, sf_dir)
    return R.rule_hits(elements.where("split = 'test'"), _masks(elements, False), limit=0)


@query("j7_rule_match_legacy", with_hits(f"SELECT sample_id, {_HIT_COLUMNS} FROM hits", "leg", LEGACY_RULE_LABELS))
def rule_match_legacy(spark, sf_dir):
    return _learned(spark, sf_dir, True)[1]


def refined_cte(prefix, labels, threshold, sequential, relaxed=False):
    """cells of the test split after refinement: before, up, down, p."""
    def bit(columns, op, label):
        masks = [f"coalesce({c}, 0)" for c in columns]
        return f"((({f' {op} '.join(masks)}) >> {labels.index(label)}) & 1)"

    op = "|" if relaxed else "&"
    pos_columns = R.HIT_COLUMNS[:3] if relaxed else ("pos_ids", "pos_calls")
    parts = []
    for k, l in enumerate(LABELS):
        pos = bit(pos_columns, op, l) if l in labels else "0"
        neg = bit(R.HIT_COLUMNS[3:], op, l) if l in labels else "0"
        parts.append(
            f"SELECT sample_id, {k} AS k, '{l}' AS label, true_{l} AS y, (score_{l} >= {threshold})::INT AS b, {pos} AS pos, {neg} AS neg "
            "FROM scored LEFT JOIN hits USING (sample_id) WHERE split = 'test'"
        )
    down = "CASE WHEN (b = 1 OR up = 1) AND neg = 1 THEN 1 ELSE 0 END" if sequential else "CASE WHEN b = 1 AND neg = 1 THEN 1 ELSE 0 END"
    return (
        "flags AS MATERIALIZED (" + " UNION ALL ".join(parts) + "),\n"
        "raised AS MATERIALIZED (SELECT *, CASE WHEN b = 0 AND pos = 1 THEN 1 ELSE 0 END AS up FROM flags),\n"
        f"refined AS MATERIALIZED (SELECT sample_id, k, label, y, b, up, {down} AS down, b + up - ({down}) AS p FROM raised)"
    )


def _with_refined(select, legacy=False, threshold=0.5, relaxed=False, extra=""):
    labels, prefix = (LEGACY_RULE_LABELS, "leg") if legacy else (LABELS, "lib")
    more = refined_cte(prefix, labels, threshold, legacy, relaxed) + (f",\n{extra}" if extra else "")
    return with_hits(select, prefix, labels, more, ("scored",))


def _scored_test(spark, sf_dir):
    return views.predictions(spark, sf_dir).where("split = 'test'").drop("split", "raw_classification")


_REFINED_SELECT = "SELECT sample_id, label, b::INTEGER AS before, p::INTEGER AS pred FROM refined"


def _long_refined(refined):
    pairs = F.array(
        *[F.struct(F.lit(l).alias("label"), F.col(f"before_{l}").alias("before"), F.col(f"pred_{l}").alias("pred")) for l in LABELS]
    )
    return refined.select("sample_id", F.explode(pairs).alias("p")).select("sample_id", "p.*")


def _refine(spark, sf_dir, legacy=False, threshold=0.5, **options):
    _, hits = _learned(spark, sf_dir, legacy)
    return R.refine(
        _scored_test(spark, sf_dir), hits, LABELS, LEGACY_RULE_LABELS if legacy else LABELS, threshold, sequential=legacy, **options
    )


@query("r6_refine_predictions", _with_refined(_REFINED_SELECT))
def refine_predictions(spark, sf_dir):
    return _long_refined(_refine(spark, sf_dir))


@query("r6_refine_predictions_relaxed", _with_refined(_REFINED_SELECT, relaxed=True))
def refine_relaxed(spark, sf_dir):
    return _long_refined(_refine(spark, sf_dir, positive_needs_both=False, negative_needs_all=False))


@query("r7_refine_legacy", _with_refined(_REFINED_SELECT, legacy=True, threshold=0.3))
def refine_legacy(spark, sf_dir):
    return _long_refined(_refine(spark, sf_dir, True, 0.3))


_STATS = (
    "SELECT sum(up + down)::BIGINT AS affected, sum(up * y + down * (1 - y))::BIGINT AS correct, "
    "round(CASE WHEN sum(up + down) > 0 THEN sum(up * y + down * (1 - y)) / sum(up + down) ELSE 0 END, 6) AS correction_rate FROM refined"
)


@query("r8_refinement_stats", _with_refined(_STATS))
def refinement_stats(spark, sf_dir):
    return _round(R.refinement_stats(_refine(spark, sf_dir)), "correction_rate")


@query("r8_refinement_stats_legacy", _with_refined(_STATS, legacy=True, threshold=0.3))
def refinement_stats_legacy(spark, sf_dir):
    return _round(R.refinement_stats(_refine(spark, sf_dir, True, 0.3)), "correction_rate")


_COVERAGE = " UNION ALL ".join(
    f"SELECT '{l}' AS label, coalesce(sum({l}), 0)::BIGINT AS positives, round(coalesce(avg(CASE WHEN {l} = 1 THEN "
    f"((coalesce(pos_ids, 0) | coalesce(pos_calls, 0) | coalesce(pos_controls, 0)) >> {i}) & 1 END), 0), 6) AS any_share, "
    f"round(coalesce(avg(CASE WHEN {l} = 1 THEN (coalesce(pos_ids, 0) >> {i}) & 1 END), 0), 6) AS ids_share "
    "FROM samples LEFT JOIN hits USING (sample_id) WHERE split = 'test'"
    for i, l in enumerate(LEGACY_RULE_LABELS)
)


@query("r9_rule_coverage", with_hits(_COVERAGE, "leg", LEGACY_RULE_LABELS))
def rule_coverage(spark, sf_dir):
    test, hits = _learned(spark, sf_dir, True)
    return _round(R.rule_coverage(test, hits), "any_share", "ids_share")


_SPLIT_TABLE = " UNION ALL ".join(
    "SELECT sample_id, '" + kind + "' AS kind, " + ", ".join(f"{x.format(l=l)}::INTEGER AS {l}" for l in LABELS) + " FROM scored"
    for kind, x in (("scores", "(score_{l} >= 0.5)"), ("labels", "true_{l}"))
)


@query("r11_split_prediction_table", with_views(_SPLIT_TABLE, "scored"))
def split_table(spark, sf_dir):
    scores, truth = split_prediction_table(views.predictions(spark, sf_dir))
    tagged = [t.select("sample_id", F.lit(k).alias("kind"), *LABELS) for k, t in (("scores", scores), ("labels", truth))]
    return tagged[0].unionByName(tagged[1])


_RUNS = "runs AS MATERIALIZED (SELECT 'before' AS run, sample_id, k, label, y, b AS p FROM refined UNION ALL SELECT 'after', sample_id, k, label, y, p FROM refined)"
_RUN_METRICS = _RUNS + ",\n" + metric_ctes("runs", "run") + ",\nmetrics AS MATERIALIZED (" + metric_rows("run") + ")"
_GAIN = (
    "SELECT b.metric, round(b.value, 6) AS before, round(a.value, 6) AS after, round(a.value - b.value, 6) AS gain "
    "FROM metrics b JOIN metrics a USING (metric) WHERE b.run = 'before' AND a.run = 'after'"
)


def _gain(out):
    return _round(out["gain"].select("metric", "before", "after", "gain"), "before", "after", "gain")


@query("r12_run_enhanced", _with_refined(_GAIN, extra=_RUN_METRICS))
def run_enhanced(spark, sf_dir):
    rows = views.samples(spark, sf_dir)
    out = run_refinement(
        rows.where("split = 'train'"), rows.where("split = 'test'"), _scored_test(spark, sf_dir), RefinementConfig()
    )
    return _gain(out)


def _of_cells(sql):
    """The same over token sets from node cells, in which keywords before a bracket are calls too."""
    every = "list_distinct(" + split_identifier("array_to_string(" + call_names("text") + ", ' ')") + ")"
    assert calls("text") in sql
    return sql.replace(calls("text"), every)


@query("r12_run_enhanced_legacy", _of_cells(_with_refined(_GAIN, legacy=True, threshold=0.3, extra=_RUN_METRICS)))
def run_enhanced_legacy(spark, sf_dir):
    rows = views.samples(spark, sf_dir)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    return _gain(run_refinement(train, test, _scored_test(spark, sf_dir), LEGACY_CONFIG))


@query("r13_run_aligned_enhanced", _of_cells(_with_refined(_GAIN, legacy=True, threshold=0.3, extra=_RUN_METRICS)))
def run_aligned(spark, sf_dir):
    rows = views.samples(spark, sf_dir)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    scores = views.with_scores(test).select("sample_id", *[f"score_{l}" for l in LABELS])
    out = run_aligned_refinement(train, test, dump_nodes(rows), scores, test.select("sample_id", *LABELS))
    return _gain(out)


