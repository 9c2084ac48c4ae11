"""Relations between rooms and doors: entries are dealt by (model, door) once."""

import re

from modelgauge.operators import checks as C


def test_pairs_are_not_dealt_on_their_own(spark):
    rooms = spark.createDataFrame([("m", "r1"), ("m", "r2"), ("m", "r2")], "model_id string, room_id string")
    doors = spark.createDataFrame([("m", "d1"), ("m", "d1"), ("m", "d2")], "model_id string, door_id string")
    names = "model_id string, room_id string, door_id string"
    forward = spark.createDataFrame([("m", "r1", "d1"), ("m", "r1", "d1"), ("m", "r2", "d9"), ("m", "r2", "d2")], names)
    reverse = spark.createDataFrame([("m", "r1", "d2"), ("m", "r8", "d1"), ("m", "r2", "d2"), ("m", None, "d1")], names)
    out = C.relation_violations(rooms, doors, forward, reverse)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(model_id#\d+, door_id#\d+", plan) and not re.search(r"hashpartitioning\(model_id#\d+, room_id#\d+, door_id", plan)
    assert sorted((r.owner_type, r.owner_id, r.target_id or "-", r.code, r.entries) for r in out.collect()) == [
        ("door", "d1", "-", "dangling", 1), ("door", "d1", "r8", "dangling", 1), ("door", "d2", "r1", "not_reciprocal", 1),
        ("room", "r1", "d1", "not_reciprocal", 2), ("room", "r2", "d9", "dangling", 1),
    ]
