"""What the evaluation shuffles: links without room columns, texts made after the joins, shuffle files gone with their step."""

import os
import time

from pyspark.sql.readwriter import DataFrameWriter

from __spark_entry__ import queries
from modelgauge.functions.ordered import passing, stored
from modelgauge.operators import rules as R
from modelgauge.plans.rulebook import requirements
from modelgauge.plans.session import save
from modelgauge.sources import testbed as tb


def tables(spark, folder):
    orders = [(1, 7, 50000.0, "F", "1-URGENT", "1996-01-01"), (2, 7, 100.0, "O", "2-HIGH", "1996-03-01"), (3, None, 5.0, None, None, None), (None, 7, 1.0, "F", "2-HIGH", None)]
    lines = [(1, 5, 2), (1, 5, 1), (1, 4, 1), (1, None, 3), (9, 5, 1), (None, 5, 1), (3, 4, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string, o_orderdate string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_rooms_and_bridge_read_one_written_table(spark, tmp_path):
    d = tables(spark, tmp_path)
    rooms, bridge = tb.rooms(spark, d), tb.bridge(spark, d)
    for df in (rooms, bridge):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.room_id or "-", r.door_ids) for r in rooms.collect()) == [
        ("-", None), ("rm-1", ["dr-4", "dr-5", None]), ("rm-2", []), ("rm-3", ["dr-4"]),
    ]
    assert sorted((str(r.model_id), r.room_id, str(r.door_id)) for r in bridge.collect()) == [
        ("None", "rm-3", "dr-4"), ("mdl-7", "rm-1", "None"), ("mdl-7", "rm-1", "dr-4"), ("mdl-7", "rm-1", "dr-5"),
    ]
    assert [r.room_id for r in tb.rooms(spark, d, "b").collect()] == ["rm-1"]


def test_conditions_are_rendered_on_the_package(spark):
    runs = spark.createDataFrame([("r", "m", "spec-a"), ("s", "n", "spec-a")], "run_id string, model_id string, spec_id string")
    req = R.run_requirements(runs, requirements(spark))
    top = R._as_conditions(req)._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "regexp_extract" not in top
    plain = R._as_conditions(req.drop("rendered"))
    assert sorted(map(str, R._as_conditions(req).collect())) == sorted(map(str, plain.collect()))


def test_links_carry_keys_only(spark):
    rooms = spark.createDataFrame(
        [("m", "r1", "A", "office", 20.5, ["d2", "d1", "d2", None], 1), ("m", "r2", "B", "office", None, None, 2), ("m", "r3", "C", "office", 1.0, [], 3), ("m", "r4", "D", "office", 1.0, ["d9"], 4)],
        "model_id string, room_id string, name string, room_type string, area_sqm double, door_ids array<string>, pos long",
    )
    doors = spark.createDataFrame([("m", "d1", 0.9), ("m", "d2", None), ("n", "d9", 1.0)], "model_id string, door_id string, width_m double")
    out = R.resolve_doors(rooms, doors)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan[plan.index("SortMergeJoin"):]
    got = {r.room_id: r for r in out.collect()}
    assert [(k.width_m, k.label) for k in got["r1"].known] == [(0.9, "d1:0.9")]
    assert (got["r1"].link_ids, got["r1"].unmeasured_ids, got["r1"].unresolved_id) == (["d2", "d1", "d2", None], ["d2", "d2", None], None)
    assert [(k, got[k].name, got[k].has_list, got[k].n_links, got[k].unresolved_id) for k in ("r2", "r3", "r4")] == [
        ("r2", "B", False, 0, None), ("r3", "C", True, 0, None), ("r4", "D", True, 1, "d9"),
    ]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = stored(spark.range(1000).selectExpr("id % 7 as k").repartition(3, "k").groupBy("k").count())
    for _ in range(20):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.5)
    assert not left and out.count() == 7


def test_partitioned_tables_are_not_sorted(spark, tmp_path, monkeypatch):
    seen, plain, key = [], DataFrameWriter.parquet, "spark.sql.maxConcurrentOutputFileWriters"

    def watched(self, path, *more, **other):
        seen.append(spark.conf.get(key))
        return plain(self, path, *more, **other)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    old = spark.conf.get(key)
    save(spark.range(1000).selectExpr("id", "concat('t', id % 70) as kind"), f"{tmp_path}/many", "kind")
    save(spark.range(1000).selectExpr("id", "concat('t', id % 5) as kind"), f"{tmp_path}/few", "kind")
    assert seen == ["64", "64"] and spark.conf.get(key) == old
    for name, n in (("many", 70), ("few", 5)):
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert back.where(f"kind = concat('t', id % {n})").count() == back.select("id").distinct().count() == 1000


def composite_case(spark):
    rooms = spark.createDataFrame(
        [("m", "r1", "A", "l", "office", 25.5, ["d2", "d1", "d1"], 1), ("m", "r2", "B", "l", "office", None, None, 2), ("m", "r3", "C", "l", "corridor", 70.0, [], 3),
         ("m", "r1", "A", "l", "office", 25.5, ["d2", "d1", "d1"], 1), ("m", "r4", "D", "l", "corridor", 1.0, ["d9", None], 4), (None, "r5", "E", "l", "office", 1.0, ["d1"], 5)],
        "model_id string, room_id string, name string, level_id string, room_type string, area_sqm double, door_ids array<string>, pos long",
    )
    doors = spark.createDataFrame([("m", "d1", 0.9), ("m", "d2", None), ("n", "d9", 1.0)], "model_id string, door_id string, width_m double")
    runs = spark.createDataFrame([("r", "m", "spec-a"), ("s", "m", "spec-b")], "run_id string, model_id string, spec_id string")
    return rooms, doors, R.run_requirements(runs, requirements(spark))


def test_links_are_resolved_in_steps_of_their_own(spark):
    case, seen = composite_case(spark), []

    def step(df):
        seen.append(df.columns)
        return stored(df)

    found = R.rule_composite(*case, step)
    assert seen and "level_id" not in seen[0]
    joins = [f._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin [") for f in (found, R.rule_composite(*case))]
    assert joins[0] == joins[1] - 1
    assert sorted(map(str, R.evaluate(*case, step).collect())) == sorted(map(str, R.evaluate(*case).collect()))


def test_tables_of_a_step_go_with_it(spark):
    with passing(spark) as step:
        df = step(spark.range(10))
        path = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and df.count() == 10
    assert not os.path.exists(os.path.dirname(path))


def test_queries_without_texts_write_no_texts(spark, tmp_path, monkeypatch):
    d = tables(spark, tmp_path)
    spark.createDataFrame([(7, "C7"), (8, "C8")], "c_custkey long, c_name string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(5, 30), (4, 40)], "p_partkey long, p_size long").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(0, "a\nb"), (2, None)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 7, "view", None), (2, None, None, None)], "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{d}/events.parquet")
    written, plain = [], DataFrameWriter.parquet

    def watched(self, path, *more, **other):
        written.append(self._df.columns)
        return plain(self, path, *more, **other)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    for name in ("traceability_rows", "element_issues", "finding_keys", "combine_statuses"):
        assert queries()[name](spark, d).count() > 0
    assert written and not [c for c in written if "summary" in c or "evidence" in c]
    seen = len(written)
    everything = queries()["evaluate_all_rules"](spark, d)
    assert "summary" in written[-1] and everything.count() > 0
    again = len(written)
    assert again > seen and queries()["element_issues"](spark, d).count() > 0 and len(written) == again
