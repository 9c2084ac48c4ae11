"""Small hand-made models and packages with known results."""

from modelgauge import schemas


def models(spark, rooms, doors, model="m"):
    r = [(model, i, i, lvl, t, a, d, n) for n, (i, lvl, t, a, d) in enumerate(rooms)]
    x = [(model, i, i, "l", w, None, n) for n, (i, w) in enumerate(doors)]
    return spark.createDataFrame(r, schemas.ROOMS), spark.createDataFrame(x, schemas.DOORS)


SAMPLE_ROOMS = [
    ("rm-stock-01", "l", "stockroom", 18.2, ["dr-01", "dr-05"]), ("rm-office-01", "l", "office", 9.4, ["dr-02"]),
    ("rm-office-02", "l", "office", 6.1, ["dr-03"]), ("rm-meet-01", "l", "meeting_room", None, ["dr-04"]), ("rm-stock-02", "l", "stockroom", None, None),
]
SAMPLE_DOORS = [("dr-01", 0.9), ("dr-02", 0.88), ("dr-03", 0.8), ("dr-04", 0.95), ("dr-05", 0.8)]
DEMO_ROOMS = [
    ("rm-stock-a", "l", "stockroom", 18.4, ["dr-stock-a", "dr-stock-a-egress"]), ("rm-stock-b", "l", "stockroom", 11.2, []),
    ("rm-office-101", "l", "office", 12.5, ["dr-office-101"]), ("rm-office-102", "l", "office", 6.8, ["dr-office-102"]),
    ("rm-meet-a", "l", "meeting_room", 22.0, ["dr-meet-a"]), ("rm-corridor", "l", "corridor", 28.0, ["dr-stock-a", "dr-office-101", "dr-office-102", "dr-meet-a"]),
]
DEMO_DOORS = [("dr-stock-a", 0.92), ("dr-stock-a-egress", 0.78), ("dr-office-101", 0.9), ("dr-office-102", 0.82), ("dr-meet-a", 0.95)]


def req(pos, rid, rtype, severity="warning", **extra):
    row = dict.fromkeys(schemas.names(schemas.REQUIREMENTS))
    row.update(spec_id="s", pos=pos, requirement_id=rid, title=rid, type=rtype, severity=severity, **extra)
    return row


def four(office_min=8.0):
    return [
        req(1, "A-STOCK", "minimum_room_area", "critical", room_type="stockroom", min_value=15.0),
        req(2, "A-OFFICE", "minimum_room_area", "critical", room_type="office", min_value=office_min),
        req(3, "W-STOCK", "minimum_door_width_for_room_type", room_type="stockroom", min_value=0.85),
        req(4, "HAS", "room_has_connected_door"),
    ]


def demo(office_min=8.0, revision="A"):
    rows = four(office_min) + [
        req(5, "INFO", "textual_requirement", "info", automation_status="informational"),
        req(6, "TODO", "textual_requirement", "critical", automation_status="requires_rule_configuration"),
    ]
    for r in rows:
        r["source"] = {"document": "Brief", "section": "1", "revision": revision}
    return rows


def requirements(spark, rows, run="run", model="m"):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schemas.REQUIREMENTS).withColumns({"run_id": F.lit(run), "model_id": F.lit(model)})
