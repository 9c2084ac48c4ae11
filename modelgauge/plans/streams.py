"""Registered queries: the streaming jobs run to the end over the events table, results read from their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from modelgauge.plans import operations  # noqa: F401  (defines the SQL counterparts used here)
from modelgauge.plans.registry import ORACLE, query
from modelgauge.plans.rulebook import requirements
from modelgauge.plans.session import new_folder, written
from modelgauge.sources import testbed as tb
from modelgauge.streaming import jobs, merge


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = tb.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _appended(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run an appending stream over what is there now into a parquet sink."""
    root = new_folder(spark)
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _merged(spark: SparkSession, start: Callable[[str, str], DataStreamWriter], schema: str) -> DataFrame:
    """Run a stream into its merged table over what is there now."""
    root = new_folder(spark)
    start(f"{root}/out", f"{root}/state").start().awaitTermination()
    return merge.read(spark, f"{root}/out", schema)


@query("stream_usage", "SELECT user_id, month, validation_runs, audit_exports, storage_bytes FROM x_usage")
def _usage(spark, d):
    e = _events(spark, d).selectExpr(
        "concat('usr-', user_id) as user_id", "ts", "case when event_type in ('view', 'click') then 'run' when event_type = 'signup' then 'export' else 'bytes' end as kind",
        "if(event_type in ('purchase', 'error'), floor(value * 1000), 1) as amount",
    )
    return _merged(spark, lambda out, state: jobs.stream_usage(e, out, state), jobs.USAGE)


@query(
    "stream_job_state",
    """SELECT user_id AS job_id, ['queued', 'parsing', 'validating', 'persisting', 'completed'][event_id % 5 + 1] AS phase, event_type AS status, event_id % 4 AS attempts,
  [5, 40, 70, 90, 100][event_id % 5 + 1] AS progress_percent FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""",
)
def _state(spark, d):
    e = _events(spark, d).selectExpr(
        "cast(user_id as string) as job_id", "element_at(array('queued', 'parsing', 'validating', 'persisting', 'completed'), cast(event_id % 5 + 1 as int)) as phase", "event_type as status",
        "event_id % 4 as attempts", "ts",
    )
    found = _merged(spark, lambda out, state: jobs.stream_job_state(e, out, state), jobs.JOB_STATE)
    return found.drop("updated_at").withColumn("job_id", F.col("job_id").cast("bigint"))


@query("stream_quota", ORACLE["quota_flags"])
def _quota(spark, d):
    e = _events(spark, d).selectExpr("cast(user_id as string) as key", "event_id", "ts")
    name, provider = jobs.STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        flags = _appended(spark, jobs.stream_quota(e, 43_200, 2))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return flags.selectExpr("event_id", "cast(key as bigint) as user_id", "unix_micros(window_start) as window_us", "position", "allowed", "retry_after")


def _review_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    root = new_folder(spark)
    log = _events(spark, d).selectExpr(
        "cast(user_id as string) as run_id", "cast(event_id % 5 as string) as requirement_id", "lpad(cast(event_id as string), 20, '0') as decision_id", "event_type as status", "ts as decided_at"
    )
    jobs.stream_reviews(log, f"{root}/out", f"{root}/state").start().awaitTermination()
    return jobs.review_tables(spark, f"{root}/out", jobs.history_schema(log))


@query("stream_reviews_current", "SELECT user_id AS run, event_id % 5 AS requirement, event_id AS decision FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts DESC, event_id DESC) = 1")
def _reviews(spark, d):
    current, _ = _review_tables(spark, d)
    return current.selectExpr("cast(run_id as bigint) as run", "cast(requirement_id as bigint) as requirement", "cast(decision_id as bigint) as decision")


@query(
    "stream_review_history",
    """SELECT user_id AS run, event_id % 5 AS requirement, event_id AS decision, event_type AS status, lead(event_id) OVER w AS superseded_by, epoch_us(lead(ts) OVER w) AS superseded_us
  FROM events WINDOW w AS (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id)""",
)
def _history(spark, d):
    _, history = _review_tables(spark, d)
    return history.selectExpr(
        "cast(run_id as bigint) as run", "cast(requirement_id as bigint) as requirement", "cast(decision_id as bigint) as decision", "status",
        "cast(superseded_by as bigint) as superseded_by", "unix_micros(superseded_at) as superseded_us",
    )


_INTAKE = """SELECT 'prj-' || (c_custkey % 50) AS project_id, 'key-' || c_custkey AS idempotency_key, 'fp-' || c_custkey AS input_fingerprint, CASE WHEN c_custkey % 50 % 9 = 0 THEN 'unassigned' ELSE 'new' END AS intake, 1 AS n FROM customer
UNION ALL SELECT 'prj-' || (c_custkey % 50), 'key-' || c_custkey, 'fp-' || c_custkey, 'replay', 1 FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'prj-' || (c_custkey % 50), 'key-' || c_custkey, 'other-' || c_custkey, 'conflict', 1 FROM customer WHERE c_custkey % 7 = 0"""


def model_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """One model document per customer, every fifth sent again, every seventh again with another fingerprint, every fourth invalid."""
    room = "struct(concat('rm-', c_custkey) as room_id, 'Room' as name, 'lvl' as level_id, if(c_custkey % 4 = 0, 'attic', 'office') as room_type, cast(20 + c_custkey % 80 as double) as area_sqm, cast(array() as array<string>) as door_ids)"
    base = tb.table(spark, d, "customer").selectExpr(
        "c_custkey", "concat('prj-', c_custkey % 50) as project_id", "concat('key-', c_custkey) as idempotency_key", "concat('fp-', c_custkey) as input_fingerprint",
        "concat('m-', c_custkey) as model_id", "timestamp'2024-01-01 00:00:00' as arrived_at", f"array({room}) as rooms",
        "cast(array() as array<struct<door_id:string,name:string,level_id:string,width_m:double>>) as doors",
    )
    later = lambda df, minutes: df.withColumn("arrived_at", F.expr(f"arrived_at + interval {minutes} minutes"))
    again = later(base.where("c_custkey % 5 = 0"), 10)
    other = later(base.where("c_custkey % 7 = 0"), 20).withColumn("input_fingerprint", F.concat(F.lit("other-"), F.col("c_custkey").cast("string")))
    return base.unionByName(again).unionByName(other).drop("c_custkey")


def _validated(spark: SparkSession, d: str) -> str:
    """Arrivals stream in and are validated to the end; the folder of the result tables."""
    root = new_folder(spark)
    model_arrivals(spark, d).write.parquet(f"{root}/landing")
    assigned = tb.table(spark, d, "customer").selectExpr("c_custkey % 50 as p").distinct().where("p % 9 <> 0").selectExpr("concat('prj-', p) as project_id", "'spec-a' as spec_id")
    assigned.write.parquet(f"{root}/assignments")
    arrivals = spark.readStream.schema(jobs.ARRIVALS).parquet(f"{root}/landing")
    packages = written(spark, "packages", lambda: requirements(spark))
    jobs.stream_validate(arrivals, packages, spark.read.parquet(f"{root}/assignments"), f"{root}/out", f"{root}/state").start().awaitTermination()
    return f"{root}/out"


@query("stream_intake", _INTAKE)
def _intake(spark, d):
    found = spark.read.parquet(f"{_validated(spark, d)}/intake")
    return found.groupBy("project_id", "idempotency_key", "input_fingerprint", "intake").agg(F.count("*").cast("int").alias("n"))


@query(
    "stream_validate",
    """SELECT 'run-prj-' || (c_custkey % 50) || '/key-' || c_custkey AS run_id, CASE WHEN 20 + c_custkey % 80 BETWEEN 30 AND 80.5 THEN 'pass' ELSE 'fail' END AS office_area,
  10 AS n_findings FROM customer WHERE c_custkey % 50 % 9 <> 0 AND c_custkey % 4 <> 0""",
)
def _stream_validate(spark, d):
    """Runs of valid models in assigned projects, each once: status of the office-area rule and number of findings (one
    for each of the package's ten requirements, as a model has one room)."""
    found = spark.read.parquet(f"{_validated(spark, d)}/findings")
    return found.groupBy("run_id").agg(
        F.max(F.when((F.col("requirement_id") == "REQ-AREA-OFFICE"), F.col("status"))).alias("office_area"), F.count("*").cast("int").alias("n_findings")
    )


@query("stream_drop_repeats", "SELECT project_id, idempotency_key, input_fingerprint FROM (" + _INTAKE + ") WHERE intake <> 'replay'")
def _drop(spark, d):
    root = new_folder(spark)
    model_arrivals(spark, d).write.parquet(f"{root}/landing")
    kept = jobs.drop_repeats(spark.readStream.schema(jobs.ARRIVALS).parquet(f"{root}/landing"))
    return _appended(spark, kept.select("project_id", "idempotency_key", "input_fingerprint"))
