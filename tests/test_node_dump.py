"""Node dumps: lines are split once, and counts keep values and codes apart."""

from collections import Counter

from tagloom.operators.alignment import count_nodes
from tagloom.sources import readers

KINDS = ("IDENTIFIER", "CALL", "CONTROL_STRUCTURE")


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_split_once(spark):
    lines = spark.createDataFrame(
        [(i, v) for i, v in enumerate(("a\tCALL\tf\tf(x)\ty", "executing a\tCALL\tf\tf", "a\tCALL\tf", "a\tBLOCK\tb\tb", "a\tCALL\t\t", "no tab", None))],
        "line_no long, value string",
    )
    rows = readers.parse_node_lines(lines)
    assert plan(rows).count("split(") == 1
    assert [tuple(r) for r in rows.collect()] == [(0, "a", "CALL", "f", "f(x)\ty"), (4, "a", "CALL", "", "")]


def test_counts_of_nodes(spark):
    values = [(v, c) for v in ("x", "", None, "y\tz") for c in ("x", "", None, "y\tz")]
    rows = [(f, k, v, c) for f in ("a", "b", None) for k in KINDS for v, c in values for _ in range(1 + (v == c) + (f == "a"))]
    nodes = spark.createDataFrame(rows, "filename string, label string, value string, code string")
    counts = count_nodes(nodes)
    assert counts.columns == ["filename", "label", "value", "code", "n"]
    assert {tuple(r)[:4]: r.n for r in counts.collect()} == Counter(rows) and counts.count() == len(set(rows))
    keys = plan(counts).split("Aggregate [", 1)[1].split("]", 1)[0]
    assert "label#" not in keys and "code#" not in keys  # a number and the differing codes go in their place
