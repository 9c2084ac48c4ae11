"""The two requirement packages the registered queries evaluate (revision A and B), as plain rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modelgauge import schemas


def _row(pos, rid, title, rtype, severity, **extra):
    row = dict.fromkeys(schemas.names(schemas.REQUIREMENTS))
    row.update(pos=pos, requirement_id=rid, title=title, type=rtype, severity=severity, **extra)
    row.setdefault("automation_status", None)
    if row["automation_status"] is None:
        row["automation_status"] = "ready_for_validation"
    return row


def _src(section, revision, document="Building brief"):
    return {"document": document, "section": section, "revision": revision}


def _cond(kind, low, high=None, quantifier=None):
    return {"type": kind, "min": low, "max": high, "quantifier": quantifier}


def package(spec_id: str) -> list[dict]:
    rev = {"spec-a": "A", "spec-b": "B"}[spec_id]
    b = rev == "B"
    rows = [
        _row(1, "REQ-AREA-STOCK", "Stockroom area", "minimum_room_area", "critical", room_type="stockroom",
             min_value=45.0 if b else 40.0, unit="m²", quantity_type="area", discipline="Architecture", source=_src("1.1", rev),
             source_fragment_ids=["frg-0-0", "frg-1-0"]),
        _row(2, "REQ-AREA-OFFICE", "Office area", "minimum_room_area", "warning", room_type="office",
             min_value=30.0, max_value=80.5, unit="m²", quantity_type="area", discipline="Architecture", source=_src("1.2", rev)),
        _row(3, "REQ-DOOR-ALL", "Stockroom door width", "minimum_door_width_for_room_type", "warning", room_type="stockroom",
             min_value=0.7, unit="m", quantity_type="length", discipline="Fire safety", source=_src("2.1", rev),
             source_fragment_ids=["frg-2-0", "frg-missing"]),
        _row(4, "REQ-DOOR-ANY", "Meeting room door width", "minimum_door_width_for_room_type", "critical",
             room_type="meeting_room", min_value=0.9, max_value=1.05, quantifier="any", unit="m", quantity_type="length",
             discipline="Fire safety", source=_src("2.2", rev)),
        _row(5, "REQ-HAS-DOOR", "Every room has a door", "room_has_connected_door", "warning", discipline="Fire safety",
             source=_src("3", rev, "Fire brief")),
        _row(6, "REQ-COMP-AND", "Office area and door", "composite_room_rule", "critical", room_type="office", operator="and",
             conditions=[_cond("room_area_range", 20.0, 90.0), _cond("connected_door_width_range", 0.65, None, "any")],
             discipline="Architecture"),
        _row(7, "REQ-COMP-OR", "Corridor area or doors", "composite_room_rule", "info", room_type="corridor", operator="or",
             conditions=[_cond("room_area_range", 60.0), _cond("connected_door_width_range", 0.7, None, "all"),
                         _cond("connected_door_width_range", 0.8, 1.0, "any")]),
        _row(8, "REQ-TEXT-INFO", "Scope of the brief", "textual_requirement", "info", automation_status="informational",
             source=_src("0", rev)),
        _row(9, "REQ-TEXT-CFG", "Acoustic separation", "textual_requirement", "critical",
             automation_status="requires_rule_configuration", discipline=""),
        _row(10, "REQ-AREA-LAB", "Other room area", "minimum_room_area", "info", room_type="unknown", min_value=10.0,
             unit="m²", quantity_type="area"),
    ]
    if b:
        rows = [r for r in rows if r["pos"] != 3]
        rows.append(
            _row(11, "REQ-DOOR-COR", "Corridor door width", "minimum_door_width_for_room_type", "warning",
                 room_type="corridor", min_value=0.75, source=_src("2.3", rev))
        )
    for r in rows:
        r["spec_id"] = spec_id
    return rows


def requirements(spark: SparkSession, *spec_ids: str) -> DataFrame:
    rows = [r for s in (spec_ids or ("spec-a", "spec-b")) for r in package(s)]
    return spark.createDataFrame(rows, schemas.REQUIREMENTS)


# Sample policies, as the loose JSON a project stores.
POLICIES = {
    0: "{}",
    1: '{"blockOnNewCritical": false, "blockOnDecreasedCoverage": false, "maxHighFindings": "3"}',
    2: '{"warnOnNewUnknown": false, "allowWaivedCritical": true, "maxMediumFindings": 2.9}',
    3: '{"blockOnNewCritical": false, "blockOnDecreasedCoverage": false, "allowWaivedCritical": "yes", "maxHighFindings": -1}',
    4: "not json",
}
