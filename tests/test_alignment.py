"""Alignment by checksums against a comparison key by key."""

from collections import defaultdict

import pytest

from tagloom.operators.alignment import validate_alignment

LABELS = ("a", "b")
SCHEMA = "sample_id long, a int, b int"


def by_hand(left, right):
    seen = defaultdict(lambda: ([], []))
    for side, rows in enumerate((left, right)):
        for key, *values in rows:
            seen[key][side].append(tuple(values))
    order = lambda v: tuple((x is not None, x or 0) for x in v)
    most = lambda rows: max(rows, key=order)
    wrong = {k for k, (l, r) in seen.items() if not l or not r or most(l) != most(r)}
    repeated = {k for k, (l, r) in seen.items() if len(l) > 1 or len(r) > 1}
    return len(left), len(right), len(repeated), len(wrong), int(not wrong | repeated)


ROWS = [(i, i % 2, i % 3 == 0) for i in range(200)]
ROWS = [(i, a, int(b)) for i, a, b in ROWS]
CASES = {
    "equal": (ROWS, ROWS[::-1]),
    "one label": (ROWS, [(5, 0, 0), *(r for r in ROWS if r[0] != 5)]),
    "missing and more": (ROWS[:-3], [*ROWS[3:], (999, 1, 1)]),
    "repeated alike": ([*ROWS, ROWS[7], ROWS[7]], [*ROWS, ROWS[7], ROWS[7]]),
    "repeated on one side": (ROWS, [*ROWS, ROWS[7]]),
    "swapped": ([(1, 0, 1), (2, 1, 0)], [(1, 1, 0), (2, 0, 1)]),
    "nulls": ([(1, None, 1), (None, 1, 1)], [(1, 1, None), (None, 1, 1)]),
    "null keys": ([(None, 1, 1), (3, 0, None)], [(3, 0, None), (None, 1, 1)]),
    "empty": ([], []),
    "one empty": ([], [(1, 1, 1)]),
}


@pytest.mark.parametrize("name", list(CASES))
@pytest.mark.parametrize("buckets", [1, 1 << 16])
def test_validate(spark, name, buckets):
    left, right = CASES[name]
    tables = (spark.createDataFrame(rows, SCHEMA) for rows in (left, right))
    assert tuple(validate_alignment(*tables, labels=LABELS, buckets=buckets).first()) == by_hand(left, right)
