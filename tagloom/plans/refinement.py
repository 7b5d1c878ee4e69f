"""Code elements, rules learned on train, refined predictions, metrics before and after."""

from dataclasses import dataclass

from ..constants import FIELDS, LABELS, LEGACY_RULE_LABELS
from ..operators.alignment import align_predictions, file_elements, validate_alignment, with_file_elements
from ..operators.metrics import classification_report, compute_metrics, metric_delta_report
from ..operators.prep import sample_subset
from ..operators.rules import (
    build_elements,
    build_rule_table,
    elements_from_cells,
    learn_rules,
    refine,
    refinement_stats,
    rule_hits,
)
from ..staging import stage


@dataclass(frozen=True)
class RefinementConfig:
    prediction_threshold: float = 0.5
    ratio_threshold: float = 1.5
    positive_needs_both: bool = True
    negative_needs_all: bool = True
    legacy: bool = False
    labels: tuple = LABELS

    @property
    def rule_labels(self):
        return LEGACY_RULE_LABELS if self.legacy else self.labels


LEGACY_CONFIG = RefinementConfig(prediction_threshold=0.3, legacy=True)


def refine_with_elements(train_elements, test_elements, scored, config):
    """``scored`` holds the key, ``score_*`` and ``true_*`` of the test rows."""
    labels = config.rule_labels
    freqs, rules = learn_rules(train_elements, labels, config.ratio_threshold, config.legacy)
    hits = rule_hits(test_elements, rules)
    refined = stage(
        refine(
            scored, hits, config.labels, labels, config.prediction_threshold, sequential=config.legacy,
            positive_needs_both=config.positive_needs_both, negative_needs_all=config.negative_needs_all,
        ),
        "refined",
    )
    before = compute_metrics(refined, config.labels, pred="before_")
    after = compute_metrics(refined, config.labels)
    return {
        "rules": build_rule_table(freqs, labels, config.ratio_threshold, config.legacy),
        "predictions": refined,
        "before": before,
        "after": after,
        "gain": metric_delta_report(before, after),
        "stats": refinement_stats(refined),
        "report": classification_report(refined, config.labels),
    }


def run_refinement(train, test, scored, config=None):
    """Elements straight from text, or from cells in legacy mode."""
    config = config or RefinementConfig()
    attach = elements_from_cells if config.legacy else build_elements
    labels = config.rule_labels
    train_elements = stage(attach(train).select("sample_id", *labels, "ids", "calls", "controls"), "train-elements")
    test_elements = attach(test).select("sample_id", "ids", "calls", "controls")
    return refine_with_elements(train_elements, test_elements, scored, config)


class AlignmentError(ValueError):
    pass


def check_alignment(test, truth, labels=LABELS):
    """Raises unless both tables have the same rows with the same labels."""
    report = validate_alignment(test, truth, labels=labels).first()
    if report["test_rows"] != report["label_rows"]:
        raise AlignmentError(f"row counts differ: {report.asDict()}")
    if report["repeated_keys"]:
        raise AlignmentError(f"keys repeat: {report.asDict()}")
    if not report["labels_match"]:
        raise AlignmentError(f"labels differ: {report.asDict()}")
    return report


def run_aligned_refinement(train, test, nodes, scores, truth, config=LEGACY_CONFIG, train_limit=None, test_limit=None, seed=42):
    """Views, alignment gate, token sets of the files' nodes, then the refinement.

    ``scores`` holds ``score_*`` columns and ``truth`` the label columns of the
    test view, both by ``sample_id``.
    """
    train = sample_subset(train, train_limit, seed)
    test = sample_subset(test, test_limit, seed)
    report = check_alignment(test, truth, config.labels)
    scored = align_predictions(scores, truth, labels=config.labels)
    elements = stage(file_elements(nodes), "file-elements")
    labels = config.rule_labels
    sets = [with_file_elements(rows, elements).select("sample_id", *labels, *FIELDS) for rows in (train, test)]
    out = refine_with_elements(stage(sets[0], "train-elements"), sets[1], scored, config)
    return {**out, "alignment": report}
