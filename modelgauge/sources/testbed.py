"""Domain tables derived from TPC-H-like parquet tables, row by row, over the whole input.

One customer is one building model: its orders are rooms, the parts on the order lines are doors.
Model, room and door counts therefore grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.plans.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_id(custkey: Column) -> Column:
    return F.concat(F.lit("mdl-"), custkey.cast("string"))


def _id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def project_id(custkey: Column) -> Column:
    return _id("prj-", F.floor(custkey / 10))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        model_id(F.col("c_custkey")).alias("model_id"),
        project_id(F.col("c_custkey")).alias("project_id"),
        F.col("c_name").alias("name"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return c.select(
        model_id(F.col("c_custkey")).alias("model_id"),
        _id("lvl-", F.col("i")).alias("level_id"),
        _id("Level ", F.col("i")).alias("name"),
        F.col("i").cast("bigint").alias("pos"),
    )


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the distinct parts of their lines, `_l`, by the first line they occur on (NULL for orders without lines).

    Lines are dealt by order once, which serves the pairs, the lists and the orders alike; the rows are written once per application, as
    rooms, bridge and doors are all made from them.
    """

    def build() -> DataFrame:
        pairs = (
            table(spark, sf_dir, "lineitem")
            .select("l_orderkey", "l_partkey", "l_linenumber")
            .repartition("l_orderkey")
            .groupBy("l_orderkey", "l_partkey")
            .agg(F.min("l_linenumber").alias("first_line"))
        )
        lists = pairs.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("first_line", "l_partkey"))).alias("_l"))
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")
        return o.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")

    return written(spark, f"order-parts:{sf_dir}", build)


ROOM_TYPES = {
    "1-URGENT": "stockroom",
    "2-HIGH": "office",
    "3-MEDIUM": "meeting_room",
    "4-NOT SPECIFIED": "corridor",
}


def room_facts(spark: SparkSession, sf_dir: str, variant: str = "a") -> DataFrame:
    """Room attributes without door lists. Variant `b` is a later state of the same models."""
    return _facts(table(spark, sf_dir, "orders"), variant)


def _facts(o: DataFrame, variant: str, *more: str) -> DataFrame:
    if variant == "b":
        o = o.where(F.month("o_orderdate") != 3)
    area = F.floor(F.col("o_totalprice") / 500) / 10
    if variant == "b":
        area = F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") / 500 + 120) / 10).otherwise(area)
    kind = F.lit("unknown")
    for priority, room_type in ROOM_TYPES.items():
        kind = F.when(F.col("o_orderpriority") == priority, room_type).otherwise(kind)
    k = F.col("o_orderkey")
    return o.select(
        k.alias("o_orderkey"),
        F.col("o_custkey"),
        model_id(F.col("o_custkey")).alias("model_id"),
        _id("rm-", k).alias("room_id"),
        _id("Room ", k).alias("name"),
        F.when(k % 19 == 0, "lvl-x").otherwise(_id("lvl-", k % 3)).alias("level_id"),
        kind.alias("room_type"),
        F.when(k % 11 != 0, area).alias("area_sqm"),
        k.cast("bigint").alias("pos"),
        *more,
    )


def rooms(spark: SparkSession, sf_dir: str, variant: str = "a") -> DataFrame:
    """Rooms with their ordered door list: NULL for every 13th order, empty when it has no lines."""
    facts = _facts(order_parts(spark, sf_dir), variant, "_l")
    doors = F.transform("_l", lambda x: F.concat(F.lit("dr-"), x["l_partkey"].cast("string")))
    listed = F.coalesce(doors, F.array().cast("array<string>"))
    return facts.select(
        "model_id", "room_id", "name", "level_id", "room_type", "area_sqm",
        F.when(F.col("o_orderkey") % 13 != 0, listed).alias("door_ids"),
        "pos",
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room -> door entries (model_id, room_id, door_id), door keys included, from the order lines."""
    keys = order_parts(spark, sf_dir).select("o_custkey", "o_orderkey", F.explode("_l.l_partkey").alias("l_partkey"))
    return keys.select(
        "o_custkey", "o_orderkey", "l_partkey",
        model_id(F.col("o_custkey")).alias("model_id"),
        _id("rm-", F.col("o_orderkey")).alias("room_id"),
        _id("dr-", F.col("l_partkey")).alias("door_id"),
    )


DOOR_ROWS = 250_000


def doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doors of each model: the parts on its order lines; every 97th part is missing (dangling ids).

    Pairs are nearly all different, so they are dealt before repeats go, about `DOOR_ROWS` lines to a task: what a task keeps in memory,
    here and in what follows in the same stage, depends neither on the size of a file's splits nor on how many shuffle blocks are put together.
    """
    parts = table(spark, sf_dir, "lineitem").count() // DOOR_ROWS + 1
    used = bridge(spark, sf_dir).select("o_custkey", "l_partkey").repartition(parts, "o_custkey", "l_partkey").distinct()
    part = table(spark, sf_dir, "part").where(F.col("p_partkey") % 97 != 0).select("p_partkey", "p_size")
    k = F.col("p_partkey")
    return used.join(part, F.col("l_partkey") == k).select(
        model_id(F.col("o_custkey")).alias("model_id"),
        _id("dr-", k).alias("door_id"),
        _id("Door ", k).alias("name"),
        F.when(k % 29 == 0, "lvl-y").otherwise(_id("lvl-", k % 3)).alias("level_id"),
        F.when(k % 17 != 0, (F.col("p_size") + 60) / 100).alias("width_m"),
        k.cast("bigint").alias("pos"),
    )


def door_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Door -> room entries: the reverse bridge with every 31st entry lost and some unknown rooms added."""
    real = bridge(spark, sf_dir).where(F.col("l_partkey") % 97 != 0)
    kept = real.where((F.col("o_orderkey") + F.col("l_partkey")) % 31 != 0).select("model_id", "door_id", "room_id")
    ghosts = (
        real.where(F.col("l_partkey") % 53 == 0)
        .select("model_id", "door_id", F.concat(F.lit("rm-ghost-"), F.col("l_partkey").cast("string")).alias("room_id"))
        .distinct()
    )
    return kept.unionByName(ghosts)


def runs(spark: SparkSession, sf_dir: str, variant: str = "a") -> DataFrame:
    """One run per model and variant; variant a uses package A, variant b package B."""
    return models(spark, sf_dir).select(
        F.concat(F.lit(f"run-{variant}-"), F.col("model_id")).alias("run_id"),
        "project_id",
        "model_id",
        F.lit(f"spec-{variant}").alias("spec_id"),
    )


def reviews_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only decision log: every event is one decision on a requirement of some run."""
    e = table(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "view", "open")
        .when(F.col("event_type") == "click", "acknowledged")
        .when(F.col("event_type") == "purchase", "waived")
        .when(F.col("event_type") == "error", "resolved")
        .otherwise("resolved")
    )
    req = F.element_at(
        F.array(*[F.lit(r) for r in ("REQ-AREA-STOCK", "REQ-DOOR-ALL", "REQ-DOOR-ANY", "REQ-COMP-AND", "REQ-TEXT-CFG")]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    return e.select(
        F.concat(F.lit("run-a-mdl-"), F.col("user_id").cast("string")).alias("run_id"),
        req.alias("requirement_id"),
        _id("dec-", F.col("event_id")).alias("decision_id"),
        status.alias("status"),
        F.concat(F.lit("Decision "), F.col("event_id").cast("string")).alias("comment"),
        F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 != 0), "Agreed deviation")
        .when(F.col("event_id") % 50 == 1, "Left over")
        .alias("waiver_reason"),
        F.when(F.col("event_id") % 7 == 0, F.col("ts").cast("timestamp")).alias("waiver_expires_at"),
        _id("usr-", F.col("event_id") % 9).alias("reviewer_id"),
        F.col("ts").cast("timestamp").alias("decided_at"),
    )


def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline run (variant a) against candidate run (variant b) of every model."""
    return models(spark, sf_dir).selectExpr(
        "model_id as pair_id", "project_id", "concat('run-a-', model_id) as before_run_id", "concat('run-b-', model_id) as after_run_id"
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of ten models each; some have no baseline, some point at a run that is gone."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.expr("floor(c_custkey / 10)").alias("n"))
        .agg(F.min("c_custkey").alias("first"))
        .selectExpr(
            "concat('prj-', n) as project_id", "n", "concat('usr-', n % 150) as owner_id",
            "case when n % 7 = 0 then null when n % 11 = 0 then 'run-a-gone' else concat('run-a-mdl-', first) end as baseline_run_id",
            "if(n % 5 = 0, timestampadd(DAY, cast(-(n % 60) as int), timestamp'2024-01-31 00:00:00'), null) as deleted_at",
        )
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loose policy document per project, chosen by project number."""
    from modelgauge.plans.rulebook import POLICIES

    cases = " ".join(f"when {k} then '{v}'" for k, v in POLICIES.items())
    return projects(spark, sf_dir).where("n % 6 <> 5").selectExpr("project_id", f"case n % 6 {cases} end as policy_json")
