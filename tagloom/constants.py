"""Label order, grids and published comparison numbers."""

# The eight labels in their fixed order.
LABELS = ("info", "priv", "bypass", "dos", "exec", "mem", "overflow", "other")

# The seven labels the legacy rule stage works on, in its own order.
LEGACY_RULE_LABELS = ("dos", "info", "overflow", "priv", "mem", "exec", "bypass")

# The three code-element fields.
FIELDS = ("ids", "calls", "controls")

# Search grids.
P_VALUE_GRID = (0.5, 0.25, 0.1, 0.05, 0.01, 0.005, 0.001)
SCORE_GRID = (0.3, 0.4, 0.5, 0.6)

# Published numbers that results are compared with.
PUBLISHED_METRICS = {
    "micro_precision": 0.71,
    "micro_recall": 0.69,
    "micro_f1": 0.70,
    "macro_precision": 0.65,
    "macro_recall": 0.60,
    "macro_f1": 0.62,
    "weighted_precision": 0.71,
    "weighted_recall": 0.69,
    "weighted_f1": 0.70,
    "samples_precision": 0.65,
    "samples_recall": 0.68,
    "samples_f1": 0.65,
    "exact_match_ratio": 0.54,
    "hamming_score": 0.62,
    "accuracy": 0.89,
    "f1_info": 0.41,
    "f1_priv": 0.63,
    "f1_bypass": 0.42,
    "f1_dos": 0.81,
    "f1_exec": 0.64,
    "f1_mem": 0.70,
    "f1_overflow": 0.67,
    "f1_other": 0.69,
}

# Column names of the raw CSV and what they are called here.
RAW_CSV_COLUMNS = {
    "Vulnerability Classification": "raw_classification",
    "func_before": "text",
    "CVE ID": "cve_id",
    "CWE ID": "cwe_id",
    "project": "project",
    "commit_id": "commit_id",
    "vul": "vul",
}

# Metadata columns carried through preparation.
METADATA_COLUMNS = ("cve_id", "cwe_id", "project", "commit_id", "vul")

# Fixed value: ends a node-array cell.
CELL_TERMINATOR = "--====--"
