from collections import Counter

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from modelgauge.functions.columns import fmt_num, percent
from modelgauge.operators import compare, gate, metrics, rules


def evaluate(spark, rooms, doors, reqs):
    r, d = fx.models(spark, rooms, doors)
    q = fx.requirements(spark, reqs)
    return q, rules.evaluate(r, d, q)


def test_sample_model(spark):
    q, f = evaluate(spark, fx.SAMPLE_ROOMS, fx.SAMPLE_DOORS, fx.four())
    assert Counter(r.status for r in f.collect()) == {"pass": 6, "fail": 2, "unknown": 3}
    out = metrics.outcomes(q, f)
    assert {r.requirement_id: r.outcome for r in out.collect()} == {
        "A-STOCK": "unknown", "A-OFFICE": "violation", "W-STOCK": "violation", "HAS": "unknown",
    }
    m = metrics.metrics(out).first()
    assert (m.pass_rate, m.coverage, m.critical_failures) == (0, 50, 1)


def test_demo_model_and_revision(spark):
    q, f = evaluate(spark, fx.DEMO_ROOMS, fx.DEMO_DOORS, fx.demo())
    assert Counter(r.status for r in f.collect()) == {"pass": 7, "fail": 5, "unknown": 1, "not_applicable": 1}
    m = metrics.metrics(metrics.outcomes(q, f)).first()
    assert (m.violated, m.unknown, m.not_applicable, m.pass_rate, m.coverage, m.critical_failures) == (4, 1, 1, 0, 80, 2)

    q2, f2 = evaluate(spark, fx.DEMO_ROOMS, fx.DEMO_DOORS, fx.demo(10.0, "B"))
    pair = lambda df: df.withColumn("pair_id", F.lit("p"))
    deltas = compare.compare_findings(pair(f), pair(f2))
    assert Counter(r.kind for r in deltas.collect()) == {"changed": 2, "unchanged": 12}
    specs = compare.compare_specs(pair(q), pair(q2))
    assert Counter(r.kind for r in specs.collect()) == {"changed": 6}

    pairs = spark.createDataFrame([("p", "prj", "b", "run")], "pair_id string, project_id string, before_run_id string, after_run_id string")
    both = pair(metrics.metrics(metrics.outcomes(q, f))), pair(metrics.metrics(metrics.outcomes(q2, f2)))
    inputs = gate.gate_inputs(pairs, deltas, pair(f2), compare.metric_deltas(*both))
    policies = spark.createDataFrame([], "project_id string, block_on_new_critical boolean, block_on_decreased_coverage boolean, warn_on_new_unknown boolean, allow_waived_critical boolean, max_high_findings long, max_medium_findings long")
    assert gate.release_gate(inputs, policies).first().gate_status == "pass"


AREA = {"type": "room_area_range", "min": 10.0, "max": None, "quantifier": None}
WIDTH = {"type": "connected_door_width_range", "min": 0.85, "max": None, "quantifier": None}


@pytest.mark.parametrize("operator,area,width,expected", [("and", None, 0.8, "fail"), ("or", None, 0.9, "pass"), ("and", 12.0, 0.9, "pass"), ("or", None, 0.8, "unknown")])
def test_composites(spark, operator, area, width, expected):
    _, f = evaluate(
        spark, [("r", "l", "office", area, ["d"])], [("d", width)],
        [fx.req(1, "C", "composite_room_rule", room_type="office", operator=operator, conditions=[AREA, WIDTH])],
    )
    row = f.first()
    assert row.status == expected
    assert row.evidence[0].message.startswith("Condition 1 (")
    assert list(row.affected_element_ids) == ["r", "d"]


def test_any_with_failing_and_unknown_width(spark):
    _, f = evaluate(
        spark, [("r", "l", "office", 9.0, ["a", "b"])], [("a", 0.7), ("b", None)],
        [fx.req(1, "W", "minimum_door_width_for_room_type", room_type="office", min_value=0.8, quantifier="any")],
    )
    row = f.first()
    assert row.status == "unknown"
    assert list(row.affected_element_ids) == ["r", "b"]


def test_null_empty_and_dangling_lists(spark):
    rooms = [("null", "l", "office", 1.0, None), ("empty", "l", "office", 1.0, []), ("gone", "l", "office", 1.0, ["a", "x"]), ("dup", "l", "office", 1.0, ["a", "a"])]
    _, f = evaluate(spark, rooms, [("a", 0.9)], [fx.req(1, "W", "minimum_door_width_for_room_type", room_type="office", min_value=0.8)])
    got = {r.affected_element_ids[0]: r for r in f.collect()}
    assert {k: v.status for k, v in got.items()} == {"null": "unknown", "empty": "fail", "gone": "unknown", "dup": "pass"}
    assert list(got["gone"].affected_element_ids) == ["gone", "x"]
    assert got["dup"].evidence[0].observed == "a:0.9, a:0.9"


def test_no_rooms(spark):
    q, f = evaluate(spark, [], [], fx.four())
    assert sorted(r.status for r in f.collect()) == ["not_applicable"] * 3
    out = {r.requirement_id: r.outcome for r in metrics.outcomes(q, f).collect()}
    assert out["HAS"] == "unknown" and out["A-STOCK"] == "not_applicable"


def test_number_text(spark):
    values = [15.0, 18.2, 0.61, 12345678.5, 1e7, 0.0005, None, 1e-13, 0.00012345678901234, 1e-7, 1e21, 123456789.123456789, -2.5e-9, 1e-6]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(fmt_num("x").alias("t"))
    assert [r.t for r in df.collect()] == ["15", "18.2", "0.61", "12345678.5", "10000000", "0.0005", None, "1e-13", "0.00012345678901234", "1e-7", "1e+21", "123456789.12345679", "-2.5e-9", "0.000001"]


def test_percent(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (0, 0), (1, 200)], "n long, d long").select(percent(F.col("n"), F.col("d")).alias("p"))
    assert [r.p for r in df.collect()] == [50, 67, 33, None, 1]


def test_finding_delta_kinds(spark):
    def rows(items):
        base = [("p", k, "R", k, s, "warning", s, ["e"], 1, n) for n, (k, s) in enumerate(items)]
        return spark.createDataFrame(base, "pair_id string, requirement_id string, rule_id string, requirement_title string, status string, severity string, summary string, affected_element_ids array<string>, req_pos long, element_pos long")

    before = rows([("a", "fail"), ("b", "pass"), ("c", "unknown"), ("d", "pass"), ("f", "unknown"), ("g", "pass")])
    after = rows([("a", "pass"), ("b", "fail"), ("d", "unknown"), ("e", "pass"), ("f", "fail"), ("g", "pass")])
    got = {r.requirement_id: r.kind for r in compare.compare_findings(before, after).collect()}
    assert got == {"a": "resolved", "b": "reopened", "c": "resolved", "d": "changed", "e": "new", "f": "reopened", "g": "unchanged"}


def test_repeated_key_keeps_last_row(spark):
    cols = "pair_id string, requirement_id string, rule_id string, requirement_title string, status string, severity string, summary string, affected_element_ids array<string>, req_pos long, element_pos long"
    before = spark.createDataFrame([("p", "a", "R", "t", "pass", "info", "x", ["2", "1"], 1, 0), ("p", "a", "R", "t", "fail", "info", "y", ["1", "2"], 1, 1)], cols)
    got = compare.compare_findings(before, before.limit(0)).collect()
    assert [(r.finding_key, r.before_status, r.kind) for r in got] == [("a|R|1,2", "fail", "resolved")]


def test_policy_normalising(spark):
    docs = ['{"maxHighFindings": "3", "maxMediumFindings": -1, "warnOnNewUnknown": "false", "allowWaivedCritical": 1}', '{"blockOnNewCritical": false, "maxHighFindings": ""}', "oops", None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, policy_json string")
    got = [tuple(r)[1:] for r in gate.normalize_policy(df).orderBy("i").collect()]
    assert got == [(True, True, True, False, 3, None), (False, True, True, False, None, None), (True, True, True, False, None, None), (True, True, True, False, None, None)]


def test_element_status_order(spark):
    rows = [("r", "pass", "info", ["e"], 1, 0), ("r", "unknown", "warning", ["e"], 2, 0), ("r", "unknown", "critical", ["e"], 3, 0), ("r", "pass", "critical", ["p"], 1, 1), ("r", "pass", "info", ["p"], 2, 1)]
    f = spark.createDataFrame(rows, "run_id string, status string, severity string, affected_element_ids array<string>, req_pos long, element_pos long")
    assert {r.element_id: (r.status, r.severity) for r in rules.element_status(f).collect()} == {"e": ("unknown", "warning"), "p": ("pass", "info")}


def test_counts_of_deltas_need_no_names(spark):
    rows = [("p", "R", "rule", "Title", "fail", "critical", "text", ["b", "a"], 1, 2), ("p", "R", "rule", "Later", "pass", "critical", "text", ["a", "b"], 1, 3), ("q", "S", "rule", None, "unknown", "info", None, [], 1, 1)]
    names = "pair_id string, requirement_id string, rule_id string, requirement_title string, status string, severity string, summary string, affected_element_ids array<string>, req_pos int, element_pos long"
    before = spark.createDataFrame(rows, names)
    deltas = compare.compare_findings(before, before.where("pair_id = 'p' and element_pos = 2"))
    assert [(r.finding_key, r.title, r.affected_element_ids, r.kind, r.before_status, r.after_status) for r in deltas.orderBy("pair_id").collect()] == [
        ("R|rule|a,b", "Title", ["a", "b"], "reopened", "pass", "fail"), ("S|rule|", None, [], "resolved", "unknown", None),
    ]
    plan = compare.delta_counts(deltas, compare.FINDING_KINDS)._jdf.queryExecution().optimizedPlan().toString()
    assert "requirement_title" not in plan.split("Aggregate [pair_id")[2].split("\n")[0] and "'ids" not in plan
    assert plan.count("max_by") < deltas._jdf.queryExecution().optimizedPlan().toString().count("max_by")
