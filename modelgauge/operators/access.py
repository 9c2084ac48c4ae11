"""Review log, idempotent intake, access and keyed-table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelgauge.functions.skew import latest, top_per_key

# Fixed value: text written into waived decisions that predate the reason field.
LEGACY_WAIVER = "Legacy waiver — reason not recorded"


def current_reviews(log: DataFrame) -> DataFrame:
    """Latest decision per (run, requirement); ties by decision id."""
    return latest(log, ["run_id", "requirement_id"], [F.col("decided_at"), F.col("decision_id")])


def review_history(log: DataFrame) -> DataFrame:
    """Every decision with the moment and the decision that superseded it (NULL = still current).

    The look-ahead runs inside (run, requirement, day); the day's last row takes the first decision of
    the next day that has one. So a requirement with a very long history is split by day.
    """
    keys = ["run_id", "requirement_id"]
    day = log.withColumn("_day", F.to_date("decided_at"))
    order = [F.col("decided_at"), F.col("decision_id")]
    following = F.struct("decided_at", "decision_id")
    firsts = day.groupBy(*keys, "_day").agg(F.min(following).alias("_first"))
    next_day = firsts.select(
        *keys, "_day", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_day")).alias("_next_day")
    )
    inside = Window.partitionBy(*keys, "_day").orderBy(*order)
    out = day.withColumn("_next", F.lead(following).over(inside)).join(next_day, [*keys, "_day"])
    nxt = F.coalesce("_next", "_next_day")
    return out.withColumn("superseded_at", nxt["decided_at"]).withColumn("superseded_by", nxt["decision_id"]).drop(
        "_day", "_next", "_next_day"
    )


def normalize_waivers(reviews: DataFrame) -> DataFrame:
    """Waived rows without a reason get the legacy text; other rows lose their waiver fields."""
    waived = F.col("status") == "waived"
    empty = F.coalesce(F.trim("waiver_reason"), F.lit("")) == ""
    return reviews.withColumns(
        {
            "waiver_reason": F.when(waived & empty, LEGACY_WAIVER).when(waived, F.col("waiver_reason")),
            "waiver_expires_at": F.when(waived, F.col("waiver_expires_at")),
        }
    )


def classify_intake(new: DataFrame, existing: DataFrame) -> DataFrame:
    """replay / conflict / new by (project, idempotency key) and fingerprint."""
    known = existing.groupBy("project_id", "idempotency_key").agg(F.min("input_fingerprint").alias("_known"))
    return (
        new.join(known, ["project_id", "idempotency_key"], "left")
        .withColumn(
            "intake",
            F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("input_fingerprint"), "replay").otherwise("conflict"),
        )
        .drop("_known")
    )


def append_idempotent(df: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of `df` still to be appended: keys not stored yet, first arrival per key."""
    fresh = df.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return latest(fresh, list(keys), [F.col(c) for c in order], keep="first")


def visible_projects(projects: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, project_id, role) of live projects: the owner, else the membership role."""
    live = projects.where(F.col("deleted_at").isNull()).select("project_id", "owner_id")
    owners = live.select(F.col("owner_id").alias("user_id"), "project_id", F.lit(0).alias("_rank"), F.lit("owner").alias("role"))
    granted = members.join(live, "project_id").select("user_id", "project_id", F.lit(1).alias("_rank"), "role")
    return (
        owners.unionByName(granted)
        .groupBy("user_id", "project_id")
        .agg(F.min_by("role", F.struct("_rank", "role")).alias("role"))
    )


project_roles = visible_projects


def editable_projects(projects: DataFrame, members: DataFrame) -> DataFrame:
    return visible_projects(projects, members).where(F.col("role").isin("owner", "editor"))


def purge_candidates(projects: DataFrame, days: int, now: Column) -> DataFrame:
    """Projects soft-deleted more than `days` days ago; children follow by semi-join on project_id."""
    return projects.where(F.col("deleted_at") < F.timestamp_add("DAY", F.lit(-days), now))


def purge_children(children: DataFrame, purged: DataFrame) -> DataFrame:
    return children.join(purged.select("project_id"), "project_id", "left_semi")


def latest_per_project(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Newest n rows of every project; two rounds, so a huge project is not sorted in one task."""
    return top_per_key(df, ["project_id"], order, n)


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Merge by key, incoming wins; among incoming rows of one key the last in `order` wins."""
    newest = latest(incoming, list(keys), [F.col(order)]).drop(order)
    kept = target.join(newest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(newest)


def insert_missing(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Merge by key, existing wins; among incoming rows of one key the first in `order` is inserted."""
    first = latest(incoming, list(keys), [F.col(order)], keep="first").drop(order)
    return target.unionByName(first.join(target.select(*keys), list(keys), "left_anti"))
