"""Costly columns of the cell queries are made once a row."""

from tagloom.catalog import QUERIES


def test_cells_are_built_and_parsed_once(spark, sf_dir):
    plan = QUERIES["c6_parse_cpg"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count('"_label": "IDENTIFIER"') == 1 and plan.count("from_json") == 1
