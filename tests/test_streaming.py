import json
import os
import random
import shutil
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from modelgauge import schemas
from modelgauge.operators import access
from modelgauge.streaming import jobs, merge
from test_ordered import fold_quota, quota_rows


def test_validate_arrivals_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    (tmp_path / "src").mkdir()
    rooms = [{"room_id": i, "name": i, "level_id": lvl, "room_type": t, "area_sqm": a, "door_ids": d} for i, lvl, t, a, d in fx.SAMPLE_ROOMS]
    doors = [{"door_id": i, "name": i, "level_id": "l", "width_m": w} for i, w in fx.SAMPLE_DOORS]
    doc = {"project_id": "p", "idempotency_key": "k1", "input_fingerprint": "f", "model_id": "x", "arrived_at": "2024-01-01T00:00:00", "rooms": rooms, "doors": doors}
    reqs = spark.createDataFrame(fx.four(), schemas.REQUIREMENTS)
    assigned = spark.createDataFrame([("p", "s")], "project_id string, spec_id string")

    def run(name, docs):
        (tmp_path / "src" / name).write_text("\n".join(json.dumps(x) for x in docs))
        jobs.stream_validate(jobs.read_arrivals(spark, src), reqs, assigned, out, ckpt).start().awaitTermination()

    run("1.json", [doc, doc])
    run("2.json", [doc, {**doc, "idempotency_key": "k2", "arrived_at": "2024-01-02T00:00:00"}])
    run("3.json", [{**doc, "arrived_at": "2024-01-03T00:00:00"}])
    m = {r.run_id: (r.pass_rate, r.coverage) for r in spark.read.parquet(out + "/metrics").collect()}
    assert m == {"run-p/k1": (0, 50), "run-p/k2": (0, 50)}
    assert spark.read.parquet(out + "/findings").count() == 22
    late = {**doc, "idempotency_key": "k4", "project_id": "q"}
    bad = {**doc, "idempotency_key": "k5", "rooms": [rooms[0], rooms[0], {**rooms[1], "door_ids": ["gone"], "room_type": "attic"}]}
    run("4.json", [{**doc, "input_fingerprint": "g"}, late, bad, bad])
    seen = {(r.idempotency_key, r.intake) for r in spark.read.parquet(out + "/intake").where("batch = 3").collect()}
    assert seen == {("k1", "conflict"), ("k4", "unassigned"), ("k5", "new"), ("k5", "replay")}
    faults = {r.message for r in spark.read.parquet(out + "/violations").where("model_id = 'p/k5'").collect()}
    assert faults == {"Duplicate model element id: rm-stock-01", "Unknown door id: gone", "Unknown room type: attic"}
    assert spark.read.parquet(out + "/findings").count() == 22
    # once the project has packages, the same arrival is taken; a project with two packages gets two runs
    assigned = assigned.union(spark.createDataFrame([("q", "s"), ("q", "s")], assigned.schema).distinct())
    run("5.json", [late, bad])
    assert {(r.idempotency_key, r.intake) for r in spark.read.parquet(out + "/intake").where("batch = 4").collect()} == {("k4", "new"), ("k5", "replay")}
    assert {r.run_id for r in spark.read.parquet(out + "/metrics").collect()} == {"run-p/k1", "run-p/k2", "run-q/k4"}


def quota_stream(spark, folder, schema, state, delay):
    out = jobs.stream_quota(spark.readStream.schema(schema).parquet(folder), 60, 2, delay)
    return out.writeStream.format("parquet").option("path", state + "/out").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()


@pytest.fixture
def timers(spark):
    spark.conf.set(*jobs.STATE_STORE)
    yield
    spark.conf.unset(jobs.STATE_STORE[0])


def test_quota_stream_matches_fold(spark, tmp_path, timers):
    """Two batches, split in the middle of windows; after the watermark has passed, idle keys hold no state."""
    rows = sorted(quota_rows(), key=lambda r: r[2])
    want = fold_quota(rows, pd.Timedelta(seconds=60), 2)
    schema = "key string, event_id long, ts timestamp"
    src, state = str(tmp_path / "src"), str(tmp_path / "state")

    def run(some):
        spark.createDataFrame([(str(k), e, t.to_pydatetime()) for k, e, t in some], schema).coalesce(1).write.mode("append").parquet(src)
        quota_stream(spark, src, schema, state, "10 seconds").awaitTermination()

    run(rows[:100])
    run(rows[100:])
    got = {r.event_id: (pd.Timestamp(r.window_start), r.position, r.allowed, r.retry_after) for r in spark.read.parquet(state + "/out").collect()}
    assert got == want
    far = rows[-1][2] + pd.Timedelta(days=1)
    run([(99, 1, far)])
    run([(99, 2, far)])
    left = spark.read.format("statestore").option("path", state).option("stateVarName", "window").load()
    assert [r.key[0] for r in left.select("key").collect()] == ["99"]


def test_hot_key_in_one_batch_is_answered_in_pieces():
    n = 1_000_000
    rng = np.random.default_rng(3)
    us, ids = rng.integers(0, 10_000_000_000, n), np.arange(n)
    tracemalloc.start()
    most, last, seen = 0, (-1, -1), 0
    for event_id, at, begins, position in jobs.window_flags(us, ids, None, 0, 60_000_000):
        most, seen = max(most, len(at)), seen + len(at)
        assert (np.diff(at) >= 0).all() and at[0] >= last[0] and (at - begins < 60_000_000).all() and (position > 0).all()
        last = (int(at[-1]), int(event_id[-1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and most <= 10_000 and peak < 48 * n


def usage_rows(rng, n):
    return [(f"u{rng.randrange(5)}", f"2024-0{rng.randrange(1, 5)}-1{rng.randrange(9)} 00:00:00", rng.choice(["run", "export", "bytes", "other"]), rng.randrange(9)) for _ in range(n)]


def test_usage_is_merged_once_however_late(spark, tmp_path):
    rng = random.Random(4)
    batches = [usage_rows(rng, 40) for _ in range(3)]  # months in any order: late rows count
    path = str(tmp_path / "usage")
    frames = [spark.createDataFrame(b, "user_id string, t string, kind string, amount long").withColumn("ts", F.to_timestamp("t")).drop("t") for b in batches]

    def total(upto):
        out = {}
        for u, t, kind, amount in (r for b in batches[:upto] for r in b):
            row = out.setdefault((u, t[:7]), {"run": 0, "export": 0, "bytes": 0, "other": 0})
            row[kind] += amount
        return {k: (v["run"], v["export"], v["bytes"]) for k, v in out.items()}

    def table():
        return {(r.user_id, r.month): (r.validation_runs, r.audit_exports, r.storage_bytes) for r in merge.read(spark, path, jobs.USAGE).collect()}

    assert table() == {}
    for n, frame in enumerate(frames):
        merge.merge(frame, n, path, ("user_id",), jobs.added_usage, jobs.USAGE, buckets=3)
        assert table() == total(n + 1)
        merge.merge(frame, n, path, ("user_id",), jobs.added_usage, jobs.USAGE, buckets=3)  # the batch runs again
        assert table() == total(n + 1)
    assert len(os.listdir(path + "/ledger")) == 2
    # a batch that dies before its ledger entry leaves the table as it was
    shutil.rmtree(path + "/ledger/batch=2")
    assert table() == total(2)
    merge.merge(frames[2], 2, path, ("user_id",), jobs.added_usage, jobs.USAGE, buckets=3)
    assert table() == total(3)


def test_merge_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    events = lambda keys: spark.createDataFrame([(k, "2024-01-05 00:00:00", "run", 1) for k in keys], "user_id string, t string, kind string, amount long").withColumn("ts", F.to_timestamp("t")).drop("t")
    merge.merge(events([f"u{i}" for i in range(50)]), 0, path, ("user_id",), jobs.added_usage, jobs.USAGE, buckets=8)
    merge.merge(events(["u7"]), 1, path, ("user_id",), jobs.added_usage, jobs.USAGE, buckets=8)
    assert len([f for f in os.listdir(path + "/data/batch=1") if f.startswith("bucket=")]) == 1
    assert {r.user_id: r.validation_runs for r in merge.read(spark, path, jobs.USAGE).collect()} == {**{f"u{i}": 1 for i in range(50)}, "u7": 2}


def test_job_state_stream(spark, tmp_path):
    schema = "job_id string, phase string, status string, attempts int, t string"
    out, state, src = (str(tmp_path / n) for n in ("out", "state", "jobs"))

    def run(rows):
        spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.mode("append").parquet(src)
        jobs.stream_job_state(spark.readStream.schema("job_id string, phase string, status string, attempts int, ts timestamp").parquet(src), out, state).start().awaitTermination()
        return sorted((r.job_id, r.phase, r.progress_percent, r.attempts) for r in merge.read(spark, out, jobs.JOB_STATE).collect())

    assert run([("j", "parsing", "processing", 1, "2024-01-01 00:00:02"), ("j", "queued", "queued", 0, "2024-01-01 00:00:01")]) == [("j", "parsing", 40, 1)]
    assert run([("j", "queued", "queued", 0, "2024-01-01 00:00:00"), ("k", "odd", "x", None, "2024-01-01 00:00:00")]) == [("j", "parsing", 40, 1), ("k", "odd", None, None)]
    assert run([("j", "completed", "done", 2, "2024-01-02 00:00:00")]) == [("j", "completed", 100, 2), ("k", "odd", None, None)]


def test_review_intervals_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    log = [("r", rng.choice("ab"), f"d{i:02d}", rng.choice(["open", "resolved"]), f"2024-01-{rng.randrange(1, 9):02d} 0{rng.randrange(3)}:00:00") for i in range(40)]
    log += [("s", "a", "d98", "open", "2024-01-01 00:00:00")]
    schema = "run_id string, requirement_id string, decision_id string, status string, t string"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("decided_at", F.to_timestamp("t")).drop("t")
    want = sorted(map(str, access.review_history(frame(log)).collect()))
    order = rng.sample(log, len(log))
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for a, b in ((0, 13), (13, 30), (30, 99)):
        again = order[: 5 if a else 0]  # some decisions arrive twice
        frame(order[a:b] + again).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(frame(log).schema).parquet(src)
        jobs.stream_reviews(stream, out, state).start().awaitTermination()
    current, history = jobs.review_tables(spark, out, jobs.history_schema(frame(log)))
    assert sorted(map(str, history.collect())) == want
    assert sorted(r.decision_id for r in current.collect()) == sorted(r.decision_id for r in access.current_reviews(frame(log)).collect())
