"""Structured Streaming jobs. Late data: O2 and O3 drop rows behind the watermark; the merged tables order by event time per key, however late."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from modelgauge.operators import access, checks, metrics, rules
from modelgauge.streaming import merge
from modelgauge.streaming.merge import merged_into

ARRIVALS = (
    "project_id string, idempotency_key string, input_fingerprint string, model_id string, arrived_at timestamp,"
    " rooms array<struct<room_id:string,name:string,level_id:string,room_type:string,area_sqm:double,door_ids:array<string>>>,"
    " doors array<struct<door_id:string,name:string,level_id:string,width_m:double>>"
)


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Stream of model documents (JSON lines) from a landing folder."""
    return spark.readStream.schema(ARRIVALS).json(path)


KEYS = ("project_id", "idempotency_key")
KEY_BUCKETS = 256
_STORED = "project_id string, idempotency_key string, input_fingerprint string, batch bigint, bucket int"


def drop_repeats(arrivals: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Arrivals without exact repeats (key and fingerprint) inside the watermark; the same key with another fingerprint stays."""
    return arrivals.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark([*KEYS, "input_fingerprint"])


def classify_arrivals(arrived: DataFrame, known: DataFrame, assignments: DataFrame) -> DataFrame:
    """project_id, idempotency_key, input_fingerprint, arrived_at, intake of a batch's arrivals.

    new: first arrival of a key that is not stored; replay: same fingerprint as the stored or first one; conflict: another
    fingerprint; unassigned: would be new, but its project has no package (its key is not taken, so it can come again).
    """
    stored = known.groupBy(*KEYS).agg(F.min("input_fingerprint").alias("_known"))
    order = Window.partitionBy(*KEYS).orderBy("arrived_at", "input_fingerprint")
    slim = arrived.select(*KEYS, "input_fingerprint", "arrived_at").withColumns({"_n": F.row_number().over(order), "_first": F.first("input_fingerprint").over(order)})
    packages = assignments.select("project_id", F.lit(True).alias("_assigned")).distinct()
    joined = slim.join(stored, list(KEYS), "left").join(packages, "project_id", "left")
    intake = F.expr(
        """case when input_fingerprint <> coalesce(_known, _first) then 'conflict' when _known is not null or _n > 1 then 'replay'
            when _assigned is null then 'unassigned' else 'new' end"""
    )
    return joined.withColumn("intake", intake).drop("_known", "_n", "_first", "_assigned")


def stream_validate(arrivals: DataFrame, requirements: DataFrame, assignments: DataFrame, out_path: str, checkpoint: str) -> DataStreamWriter:
    """Validate models as they arrive; every (project, idempotency key) is evaluated once.

    Tables under `out_path`, a folder for each batch: arrivals, intake (what became of each arrival), violations of models that are
    not evaluated, findings, metrics, keys. `assignments`: project_id, spec_id; a project with several packages gets a run for each.
    Replayed micro-batches overwrite their own folders, so a restart neither loses nor doubles results. The batch is written first
    and read back, stored keys are read from the buckets of the batch's own keys only.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def put(df: DataFrame, name: str) -> DataFrame:
            path = f"{out_path}/{name}/batch={batch_id}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        arrived = put(batch, "arrivals")
        intake = put(classify_arrivals(arrived, _stored_keys(spark, out_path, batch_id, arrived), assignments), "intake")
        fresh = intake.where("intake = 'new'").select(*KEYS, "input_fingerprint", "arrived_at")
        docs = arrived.join(fresh, [*KEYS, "input_fingerprint", "arrived_at"]).dropDuplicates(list(KEYS)).withColumn("model_id", F.concat_ws("/", *KEYS))
        rooms = docs.selectExpr("model_id", "posexplode(rooms) as (pos, r)").selectExpr("model_id", "r.*", "cast(pos as bigint) as pos")
        doors = docs.selectExpr("model_id", "posexplode(doors) as (pos, x)").selectExpr("model_id", "x.*", "cast(pos as bigint) as pos")
        faults = put(_model_faults(spark, rooms, doors), "violations")
        bad = faults.select("model_id").distinct()
        sound = lambda df: df.join(bad, "model_id", "left_anti")
        several = assignments.groupBy("project_id").agg(F.count("*").alias("_of"))
        runs = sound(docs).select("project_id", "model_id").join(assignments, "project_id").join(several, "project_id")
        runs = runs.selectExpr("concat('run-', model_id, if(_of > 1, concat('@', spec_id), '')) as run_id", "model_id", "spec_id")
        req = put(rules.run_requirements(runs, requirements), "run_requirements")
        found = put(rules.evaluate(sound(rooms), sound(doors), req), "findings")
        put(metrics.metrics(metrics.outcomes(req, found)), "metrics")
        fresh.select(*KEYS, "input_fingerprint", _bucket().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{out_path}/keys/batch={batch_id}")

    return arrivals_writer(arrivals, run, checkpoint)


def _model_faults(spark: SparkSession, rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """Repeated ids, unknown doors in room lists, and field violations of arrived models (model_id, element_id, message)."""
    no_levels = spark.createDataFrame([], "model_id string, level_id string, name string, pos bigint")
    none = spark.createDataFrame([], "model_id string")
    columns = ("model_id", "element_id", "message")
    listed = rooms.selectExpr("model_id", "room_id", "explode(door_ids) as door_id")
    unknown = listed.join(doors.select("model_id", "door_id"), ["model_id", "door_id"], "left_anti").selectExpr("model_id", "room_id as element_id", "concat('Unknown door id: ', door_id) as message")
    fields = checks.model_field_violations(none, no_levels, rooms, doors).select(*columns)
    return checks.dup_element_ids(no_levels, rooms, doors).select(*columns).unionByName(unknown).unionByName(fields)


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(KEY_BUCKETS)).cast("int")


def _stored_keys(spark: SparkSession, out_path: str, batch_id: int, arrived: DataFrame) -> DataFrame:
    """Keys written by earlier batches (not by a previous try of this one), from the buckets of this batch's keys."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{out_path}/keys")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _STORED)
    used = [r[0] for r in arrived.select(_bucket()).distinct().collect()]  # at most KEY_BUCKETS numbers
    return spark.read.schema(_STORED).parquet(f"{out_path}/keys").where((F.col("batch") < batch_id) & F.col("bucket").isin(used))


def arrivals_writer(df: DataFrame, run, checkpoint: str) -> DataStreamWriter:
    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)


REVIEW_KEYS = ("run_id", "requirement_id")


def stream_reviews(decisions: DataFrame, out_path: str, checkpoint: str) -> DataStreamWriter:
    """Keeps every decision with the moment and the decision that superseded it in a merged table (`review_tables` reads it).

    Every interval ends where the next decision of its requirement begins. A new decision closes its predecessor's interval, a late
    one splits the interval it falls into; a decision that arrives again changes nothing. A batch reads and writes only the buckets
    of its own (run, requirement) pairs, and orders only the pairs it names.
    """

    def place(kept: DataFrame, new: DataFrame) -> DataFrame:
        columns = decisions.columns
        named = new.select(*REVIEW_KEYS).distinct()
        open_ = kept.join(named, list(REVIEW_KEYS), "left_semi").select(*columns)
        fresh = new.select(*columns).dropDuplicates([*REVIEW_KEYS, "decision_id"]).join(open_, [*REVIEW_KEYS, "decision_id"], "left_anti").select(*columns)
        return kept.join(named, list(REVIEW_KEYS), "left_anti").unionByName(access.review_history(open_.unionByName(fresh)))

    return merged_into(decisions, out_path, REVIEW_KEYS, place, history_schema(decisions), checkpoint)


def history_schema(decisions: DataFrame) -> str:
    types = ", ".join(f"`{name}` {kind}" for name, kind in decisions.dtypes)
    return f"{types}, superseded_at {dict(decisions.dtypes)['decided_at']}, superseded_by {dict(decisions.dtypes)['decision_id']}"


def review_tables(spark: SparkSession, out_path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(current, history) as the last batch left them, whatever order the decisions arrived in."""
    history = merge.read(spark, out_path, schema)
    return history.where("superseded_by IS NULL").drop("superseded_at", "superseded_by"), history


JOB_STATE = "job_id string, phase string, status string, attempts bigint, updated_at timestamp, progress_percent int"
USAGE = "user_id string, month string, validation_runs bigint, audit_exports bigint, storage_bytes bigint"


def latest_job_state(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Phase, status and attempts of every job at its last event time, whichever arrived last; events of one moment by attempts, status, phase."""
    progress = " ".join(f"when '{p}' then {v}" for p, v in {"queued": 5, "parsing": 40, "validating": 70, "persisting": 90, "completed": 100}.items())
    order = F.struct("updated_at", "attempts", "status", "phase")
    both = kept.drop("progress_percent").unionByName(new.selectExpr("job_id", "phase", "status", "cast(attempts as bigint) as attempts", "ts as updated_at"))
    return both.groupBy("job_id").agg(F.max(order).alias("s")).selectExpr("job_id", "s.phase", "s.status", "s.attempts", "s.updated_at", f"case s.phase {progress} end as progress_percent")


def stream_job_state(events: DataFrame, out_path: str, checkpoint: str) -> DataStreamWriter:
    """Keeps the latest state of every job (JOB_STATE) in a merged table; late events never replace newer ones."""
    return merged_into(events, out_path, ("job_id",), latest_job_state, JOB_STATE, checkpoint)


def added_usage(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Usage per (user, month) with the batch's events added."""
    on = lambda k: F.sum(F.when(F.col("kind") == k, F.col("amount")).otherwise(0)).cast("bigint")
    month = F.date_format(F.date_trunc("month", "ts"), "yyyy-MM").alias("month")
    part = new.groupBy("user_id", month).agg(on("run").alias("validation_runs"), on("export").alias("audit_exports"), on("bytes").alias("storage_bytes"))
    return kept.unionByName(part).groupBy("user_id", "month").agg(*(F.sum(c).alias(c) for c in ("validation_runs", "audit_exports", "storage_bytes")))


def stream_usage(events: DataFrame, out_path: str, checkpoint: str) -> DataStreamWriter:
    """Keeps usage per (user, month) (USAGE) in a merged table. Nothing is too late; a batch that runs again is not added twice."""
    return merged_into(events, out_path, ("user_id",), added_usage, USAGE, checkpoint)


_FLAG_SCHEMA = "key string, event_id long, ts timestamp, window_start timestamp, position long, allowed boolean, retry_after long"
_FLAG_ROWS = 10_000


def window_flags(us: np.ndarray, event_id: np.ndarray, start: int | None, count: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(event_id, us, window start, position) of one key's events in order, in pieces; `start` and `count` are the open window's."""
    order = np.lexsort((event_id, us))
    us, event_id = us[order], event_id[order]
    at = 0 if start is None else int(np.searchsorted(us, start + width, side="left"))
    opens = []
    while at < len(us):
        opens.append(at)
        at = int(np.searchsorted(us, us[at] + width, side="left"))
    edge = np.array(opens, np.int64)
    for a in range(0, len(us), _FLAG_ROWS):
        here = np.arange(a, min(a + _FLAG_ROWS, len(us)))
        of = np.searchsorted(edge, here, side="right") - 1
        carried = of < 0
        begins = np.where(carried, start if start is not None else 0, us[edge[of]] if len(edge) else 0)
        position = np.where(carried, here + count + 1, here - (edge[of] if len(edge) else 0) + 1)
        yield event_id[here], us[here], begins, position


class QuotaWindows(StatefulProcessor):
    """Open window of each key as state: start and number of events. A timer at the window's end removes the state, so idle keys leave none.

    A key's rows of a micro-batch are read piece by piece into two numbers an event, put in event-time order and answered in pieces.
    """

    def __init__(self, window_seconds: int, limit: int):
        self.width, self.limit = window_seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start_us long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(p["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), p["event_id"].to_numpy()) for p in rows]
        us, event_id = (np.concatenate(x) for x in zip(*parts, strict=True))
        start, count = self.window.get() if self.window.exists() else (None, 0)
        before = start
        for ids, at, begins, position in window_flags(us, event_id, start, count, self.width):
            start, count = int(begins[-1]), int(position[-1])
            late = position > self.limit
            wait = np.where(late, np.maximum(1, -((at - begins - self.width) // 1_000_000)), 0)
            stamp = lambda x: pd.to_datetime(x, unit="us")
            yield pd.DataFrame({"key": key[0], "event_id": ids, "ts": stamp(at), "window_start": stamp(begins), "position": position, "allowed": ~late, "retry_after": wait})
        if start != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(start))
        self.window.update((start, count))

    def _end(self, start: int) -> int:
        return -(-(start + self.width) // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists() and self._end(self.window.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


#: The state store that keeps timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_quota(events: DataFrame, window_seconds: int, limit: int, delay: str = "1 hour") -> DataFrame:
    """Fixed-window quota flags per key (key, event_id, ts): a window opens at the first event after the last one expired.

    Events are taken batch by batch, in event-time order inside one; those behind the watermark are dropped. Needs STATE_STORE.
    """
    return (
        events.select("key", "event_id", "ts").withWatermark("ts", delay).groupBy("key")
        .transformWithStateInPandas(QuotaWindows(window_seconds, limit), _FLAG_SCHEMA, "Append", "EventTime")
    )
