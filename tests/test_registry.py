"""The registry itself, and a sample of registered queries against their SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from modelgauge.plans.registry import QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
SAMPLE = ("rule_composite", "run_metrics", "dup_element_ids", "coverage_groups", "parse_spec_json", "review_history", "classify_lines", "normalize_rows")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    ok, note = check.compare(spark, check.connect(DATA), name, DATA)
    assert ok, note


PRODUCTS = ("BroadcastNestedLoopJoin", "CartesianProduct")


def test_no_nested_loops(spark):
    """Plans of all batch queries; those of the optional subpackage are tested with it."""
    found = {}
    for name, build in QUERIES.items():
        if not name.startswith("stream_"):
            plan = build(spark, DATA)._jdf.queryExecution().executedPlan().toString()
            found[name] = [p for p in PRODUCTS if p in plan]
    assert len(found) > 140 and not {n: p for n, p in found.items() if p}
