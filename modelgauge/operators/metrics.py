"""Requirement outcomes and run metrics. Metrics count requirements, never finding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.functions.columns import STATUSES, outcome, percent


def outcomes(req: DataFrame, findings: DataFrame) -> DataFrame:
    """One outcome per (run, requirement); a requirement without findings is unknown.

    `req` has one row per (run, requirement). Findings are pre-aggregated map-side before the shuffle.
    """
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = findings.groupBy("run_id", "requirement_id").agg(
        F.count(F.lit(1)).alias("n_results"),
        is_("pass").alias("n_pass"),
        is_("fail").alias("n_fail"),
        is_("unknown").alias("n_unknown"),
        is_("not_applicable").alias("n_na"),
    )
    joined = req.select(
        "run_id", "requirement_id", "title", "severity", "type", F.col("pos").alias("req_pos")
    ).join(counts, ["run_id", "requirement_id"], "left")
    filled = joined.fillna(0, ["n_results", "n_pass", "n_fail", "n_unknown", "n_na"])
    return filled.withColumn(
        "outcome",
        outcome(F.col("n_results"), F.col("n_pass"), F.col("n_fail"), F.col("n_unknown"), F.col("n_na")),
    )


def metrics(outcome_rows: DataFrame) -> DataFrame:
    """Outcome counts, pass rate, coverage and critical failures of every run."""
    is_ = lambda s: F.count_if(F.col("outcome") == s)
    base = outcome_rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("requirement_count"),
        is_("compliant").alias("compliant"),
        is_("violation").alias("violated"),
        is_("unknown").alias("unknown"),
        is_("not_applicable").alias("not_applicable"),
        F.count_if((F.col("outcome") == "violation") & (F.col("severity") == "critical")).alias("critical_failures"),
    )
    base = base.withColumn("applicable", F.col("requirement_count") - F.col("not_applicable")).withColumn(
        "determined", F.col("compliant") + F.col("violated")
    )
    return base.withColumn("pass_rate", percent(F.col("compliant"), F.col("determined"))).withColumn(
        "coverage", percent(F.col("determined"), F.col("applicable"))
    )


def result_counts(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Finding rows per status, zero-filled for every run."""
    counts = findings.groupBy("run_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    )
    return runs.select("run_id").join(counts, "run_id", "left").fillna(0)


def inventory(models: DataFrame, levels: DataFrame, rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """Levels, rooms and doors per model; one aggregate over the three tagged tables."""
    tagged = (
        levels.select("model_id", F.lit("level").alias("kind"))
        .unionByName(rooms.select("model_id", F.lit("room").alias("kind")))
        .unionByName(doors.select("model_id", F.lit("door").alias("kind")))
    )
    counts = tagged.groupBy("model_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("level", "room", "door")]
    )
    return models.select("model_id").join(counts, "model_id", "left").fillna(0)
