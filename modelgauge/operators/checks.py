"""Constraint checks. Every check returns violation rows and never raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.functions.skew import salted_join

# Allowed sets.
ROOM_TYPES = ("stockroom", "office", "meeting_room", "corridor", "unknown")
SEVERITIES = ("info", "warning", "critical")
QUANTITY_TYPES = ("length", "area", "volume", "count", "percentage", "angle", "untyped")
AREA_UNITS = ("m²", "m2", "sqm")
LENGTH_UNITS = ("mm", "cm", "m")
REVIEW_STATUSES = ("open", "acknowledged", "resolved", "waived")
TEXT_STATUSES = ("valid_requirement", "informational", "requires_rule_configuration")
MAX_REQUIREMENTS = 1000
MAX_ATTACHMENT_BYTES = 5 * 1024 * 1024


def sql_in(values: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def elements(levels: DataFrame, rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """(model_id, element_type, element_id, level_id, ord, pos) over the three tables."""
    return (
        levels.selectExpr("model_id", "'level' as element_type", "level_id as element_id", "cast(null as string) as level_id", "1 as ord", "pos")
        .unionByName(rooms.selectExpr("model_id", "'room' as element_type", "room_id as element_id", "level_id", "2 as ord", "pos"))
        .unionByName(doors.selectExpr("model_id", "'door' as element_type", "door_id as element_id", "level_id", "3 as ord", "pos"))
    )


def repeats_after_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every row after the first of its key. Only the first order per repeated key is aggregated and joined
    back, salted by the order, so a key with very many copies is never gathered in one task."""
    firsts = (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    return salted_join(df, firsts, list(keys), list(order)).where(F.struct(*order) > F.col("_first")).drop("_first")


def dup_element_ids(levels: DataFrame, rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """Element ids used again, across levels, rooms and doors of one model."""
    return repeats_after_first(elements(levels, rooms, doors), ["model_id", "element_id"], ["ord", "pos"]).selectExpr(
        "model_id", "element_type", "element_id", "pos", "concat('Duplicate model element id: ', element_id) as message"
    )


def unknown_levels(levels: DataFrame, rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """Rooms and doors whose level does not exist in their model."""
    users = elements(levels, rooms, doors).where("element_type <> 'level'")
    known = levels.select("model_id", "level_id").distinct()
    return salted_join(users, known, ["model_id", "level_id"], ["element_id", "pos"], how="left_anti").selectExpr(
        "model_id", "element_type", "element_id", "pos", "concat('Unknown level id: ', level_id) as message"
    )


def relation_violations(rooms: DataFrame, doors: DataFrame, room_doors: DataFrame, door_rooms: DataFrame) -> DataFrame:
    """Unknown targets and one-sided relations, both directions.

    Inputs are the two exploded bridges (model_id, room_id, door_id). Both are dealt by (model_id, door_id) once: there they are folded into
    one row per pair and meet the doors without another shuffle. The pairs are then dealt once more, to meet the rooms.
    """
    both = (
        room_doors.selectExpr("model_id", "room_id", "door_id", "1 as f", "0 as r")
        .unionByName(door_rooms.selectExpr("model_id", "room_id", "door_id", "0 as f", "1 as r"))
        .repartition("model_id", "door_id")
        .groupBy("model_id", "room_id", "door_id")
        .agg(F.sum("f").alias("n_forward"), F.sum("r").alias("n_reverse"))
    )
    with_door = both.join(doors.selectExpr("model_id", "door_id", "true as has_door").distinct(), ["model_id", "door_id"], "left")
    full = with_door.join(rooms.selectExpr("model_id", "room_id", "true as has_room").distinct(), ["model_id", "room_id"], "left")
    def entry(owner: str, target: str, code: str, entries: str, message: str) -> str:
        return (
            f"named_struct('owner_type', '{owner}', 'owner_id', {owner}_id, 'target_id', {target}_id,"
            f" 'code', '{code}', 'entries', {entries}, 'message', {message})"
        )

    def side(owner: str, target: str, n: str, other: str) -> str:
        missing = entry(owner, target, "dangling", n, f"concat('Unknown {target} id: ', {target}_id)")
        alone = entry(
            owner, target, "not_reciprocal", n,
            f"concat('Relationship ', {owner}_id, ' -> ', {target}_id, ' is not reciprocal')",
        )
        return f"case when {n} = 0 then null when has_{target} is null then {missing} when {other} = 0 then {alone} end"

    forward = side("room", "door", "n_forward", "n_reverse")
    reverse = side("door", "room", "n_reverse", "n_forward")
    return full.selectExpr("model_id", f"inline(array_compact(array({forward}, {reverse})))")


def dangling_refs(rooms, doors, room_doors, door_rooms) -> DataFrame:
    return relation_violations(rooms, doors, room_doors, door_rooms).where("code = 'dangling'").drop("code")


def non_reciprocal(rooms, doors, room_doors, door_rooms) -> DataFrame:
    return relation_violations(rooms, doors, room_doors, door_rooms).where("code = 'not_reciprocal'").drop("code")


def _rules_to_rows(df: DataFrame, keep: Sequence[str], rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(condition, path, message) rules as violation rows; one narrow pass over `df`."""
    items = ", ".join(f"if({c}, struct('{p}' as path, {m} as message), null)" for c, p, m in rules)
    return df.selectExpr(*keep, f"inline(array_compact(array({items})))")


def model_field_violations(models: DataFrame, levels: DataFrame, rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """At least one level, non-empty ids and names, known room type, positive measures."""
    blank = lambda c: f"coalesce({c}, '') = ''"
    need = "'Required text is empty'"
    none = models.join(levels.select("model_id").distinct(), "model_id", "left_anti").selectExpr(
        "model_id", "'model' as element_type", "model_id as element_id", "'levels' as path", "'Model needs at least one level' as message"
    )
    lv = _rules_to_rows(
        levels, ["model_id", "'level' as element_type", "level_id as element_id"],
        [(blank("level_id"), "id", need), (blank("name"), "name", need)],
    )
    rm = _rules_to_rows(
        rooms, ["model_id", "'room' as element_type", "room_id as element_id"],
        [
            (blank("room_id"), "id", need), (blank("name"), "name", need), (blank("level_id"), "levelId", need),
            (f"coalesce(room_type, '') not in {sql_in(ROOM_TYPES)}", "roomType", "concat('Unknown room type: ', coalesce(room_type, ''))"),
            ("area_sqm <= 0", "areaSqm", "'Area must be positive'"),
        ],
    )
    dr = _rules_to_rows(
        doors, ["model_id", "'door' as element_type", "door_id as element_id"],
        [
            (blank("door_id"), "id", need), (blank("name"), "name", need), (blank("level_id"), "levelId", need),
            ("width_m <= 0", "widthM", "'Width must be positive'"),
        ],
    )
    return none.unionByName(lv).unionByName(rm).unionByName(dr)


_AREA, _WIDTH, _COMP, _TEXT = (
    "type = 'minimum_room_area'", "type = 'minimum_door_width_for_room_type'", "type = 'composite_room_rule'", "type = 'textual_requirement'",
)
SHAPE_RULES = (
    ("coalesce(trim(requirement_id), '') = ''", "id", "'Requirement id is required'"),
    ("coalesce(trim(title), '') = ''", "title", "'Title is required'"),
    (f"coalesce(severity, '') not in {sql_in(SEVERITIES)}", "severity", "'Unknown severity'"),
    ("coalesce(type, '') not in ('minimum_room_area', 'minimum_door_width_for_room_type', 'room_has_connected_door', 'composite_room_rule', 'textual_requirement')",
     "type", "'Unknown requirement type'"),
    (f"({_AREA} or {_WIDTH} or {_COMP}) and coalesce(room_type, '') not in {sql_in(ROOM_TYPES)}", "roomType", "'Room type is missing or unknown'"),
    (f"({_AREA} or {_WIDTH}) and coalesce(min_value, 0) <= 0", "minimum", "'Minimum must be a positive number'"),
    (f"({_AREA} or {_WIDTH}) and max_value <= 0", "maximum", "'Maximum must be a positive number'"),
    (f"{_WIDTH} and quantifier not in ('any', 'all')", "quantifier", "'Quantifier must be any or all'"),
    (f"not {_WIDTH} and quantifier is not null", "quantifier", "'Field is not allowed for this type'"),
    (f"not ({_AREA} or {_WIDTH}) and (min_value is not null or max_value is not null)", "minimum", "'Field is not allowed for this type'"),
    (f"not ({_AREA} or {_WIDTH} or {_COMP}) and room_type is not null", "roomType", "'Field is not allowed for this type'"),
    (f"{_COMP} and coalesce(operator, '') not in ('and', 'or')", "operator", "'Operator must be and or or'"),
    (f"not {_COMP} and (operator is not null or conditions is not null)", "conditions", "'Field is not allowed for this type'"),
    (f"{_COMP} and exists(conditions, c -> coalesce(c.min, 0) <= 0 or coalesce(c.max, 1) <= 0)", "conditions", "'Condition bounds must be positive'"),
    (f"{_COMP} and exists(conditions, c -> coalesce(c.quantifier, 'all') not in ('any', 'all'))", "conditions", "'Quantifier must be any or all'"),
    (f"{_COMP} and exists(conditions, c -> coalesce(c.type, '') not in ('room_area_range', 'connected_door_width_range'))", "conditions", "'Unknown condition type'"),
    (f"{_TEXT} and coalesce(automation_status, '') not in {sql_in(TEXT_STATUSES)}", "automationStatus", "'Unknown automation status'"),
)
UNIT_RULES = (
    (f"{_AREA} and quantity_type <> 'area'", "quantityType", "\"Room area rules require quantityType 'area'\""),
    (f"{_AREA} and lower(unit) not in {sql_in(AREA_UNITS)}", "unit", "'Room area rules require an area unit'"),
    (f"{_WIDTH} and quantity_type <> 'length'", "quantityType", "\"Door width rules require quantityType 'length'\""),
    (f"{_WIDTH} and lower(unit) not in {sql_in(LENGTH_UNITS)}", "unit", "'Door width rules require a length unit'"),
)
RANGE_RULES = (
    (f"{_AREA} and max_value < min_value", "maxAreaSqm", "'Maximum room area must be greater than or equal to minimum room area'"),
    (f"{_WIDTH} and max_value < min_value", "maxDoorWidthM", "'Maximum door width must be greater than or equal to minimum door width'"),
)
SIZE_RULES = ((f"{_COMP} and coalesce(size(conditions), 0) not between 2 and 10", "conditions", "'Composite rules need 2 to 10 conditions'"),)
_KEYS = ["spec_id", "requirement_id", "pos"]


def requirement_shape_violations(req: DataFrame) -> DataFrame:
    return _rules_to_rows(req, _KEYS, SHAPE_RULES)


def requirement_unit_violations(req: DataFrame) -> DataFrame:
    return _rules_to_rows(req, _KEYS, UNIT_RULES)


def inverted_ranges(req: DataFrame) -> DataFrame:
    simple = _rules_to_rows(req, _KEYS, RANGE_RULES)
    branch = (
        req.where(_COMP)
        .selectExpr(*_KEYS, "posexplode(conditions) as (i, c)")
        .where("c.max < c.min")
        .selectExpr(
            *_KEYS,
            "concat('conditions.', i, if(c.type = 'room_area_range', '.maxAreaSqm', '.maxDoorWidthM')) as path",
            "'Condition maximum must be greater than or equal to its minimum' as message",
        )
    )
    return simple.unionByName(branch)


def package_size_violations(packages: DataFrame, req: DataFrame) -> DataFrame:
    """Packages outside 1..1000 requirements, and composites outside 2..10 conditions."""
    counts = req.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = packages.select("spec_id").join(counts, "spec_id", "left").where(f"coalesce(n, 0) not between 1 and {MAX_REQUIREMENTS}")
    return sizes.selectExpr(
        "spec_id", "cast(null as string) as requirement_id", "cast(null as bigint) as pos", "'requirements' as path",
        f"concat('Package has ', coalesce(n, 0), ' requirements; expected 1 to {MAX_REQUIREMENTS}') as message",
    ).unionByName(_rules_to_rows(req, _KEYS, SIZE_RULES))


def dup_requirement_ids(req: DataFrame) -> DataFrame:
    """Every repeat of a requirement id in its package."""
    return repeats_after_first(req.select(*_KEYS), ["spec_id", "requirement_id"], ["pos"]).selectExpr(
        *_KEYS, "'id' as path", "concat('Duplicate requirement id: ', requirement_id) as message"
    )


def package_consistency(rows: DataFrame) -> DataFrame:
    """Import rows (file, row, specification_name, specification_revision, source_document, source_section):
    package name and revision must agree per file; document and section come together."""
    blank = lambda c: f"nullif(trim({c}), '')"
    names = rows.groupBy("file").agg(
        F.expr(f"min({blank('specification_name')})").alias("n0"), F.expr(f"max({blank('specification_name')})").alias("n1"),
        F.expr(f"min({blank('specification_revision')})").alias("r0"), F.expr(f"max({blank('specification_revision')})").alias("r1"),
    )
    mixed = names.where("n0 <> n1 or r0 <> r1").selectExpr(
        "file", "cast(null as bigint) as row", "'specification name and revision must be consistent across all rows' as message"
    )
    halves = rows.where(f"({blank('source_document')} is null) <> ({blank('source_section')} is null)").selectExpr(
        "file", "cast(row as bigint) as row", "'must provide both source_document and source_section' as message"
    )
    return mixed.unionByName(halves)


def review_violations(reviews: DataFrame) -> DataFrame:
    """Waived needs a reason; waiver fields only on waived decisions; known status; bounded comment."""
    empty = "coalesce(trim(waiver_reason), '') = ''"
    return _rules_to_rows(
        reviews, ["run_id", "requirement_id", "decision_id"],
        [
            (f"coalesce(status, '') not in {sql_in(REVIEW_STATUSES)}", "status", "'Unknown review status'"),
            (f"status = 'waived' and {empty}", "waiverReason", "'Waived decisions require a waiver reason.'"),
            (f"status <> 'waived' and (not ({empty}) or waiver_expires_at is not null)", "waiverReason",
             "'Waiver fields are only valid for waived decisions.'"),
            ("length(comment) > 2000", "comment", "'Comment is too long'"),
        ],
    )


def evidence_violations(ev: DataFrame) -> DataFrame:
    """Kind-specific payload of attached evidence."""
    has = lambda c: f"coalesce({c}, '') <> ''"
    return _rules_to_rows(
        ev, ["id", "run_id", "kind"],
        [
            ("kind not in ('file', 'screenshot', 'model_element', 'comment', 'link', 'technical_note')", "kind", "'Unknown evidence kind'"),
            (f"kind in ('file', 'screenshot') and not ({has('file_name')} and {has('file_content_hash')})", "file",
             "'File and screenshot evidence require fileName and fileContentBase64.'"),
            (f"kind = 'model_element' and not ({has('model_element_id')} and {has('model_element_type')})", "modelElementId",
             "'Model element evidence requires modelElementId and modelElementType.'"),
            ("kind = 'comment' and coalesce(trim(comment), '') = ''", "comment", "'Comment evidence requires a comment.'"),
            (f"kind = 'link' and not {has('link_url')}", "linkUrl", "'Link evidence requires linkUrl.'"),
            (f"kind = 'technical_note' and not {has('technical_note')}", "technicalNote", "'Technical note evidence requires technicalNote.'"),
        ],
    )


def orphan_evidence(ev: DataFrame, req: DataFrame, findings: DataFrame) -> DataFrame:
    """Evidence whose requirement (or rule finding) does not exist in its run, or whose file size is off."""
    known_req = req.select("run_id", "requirement_id").distinct().withColumn("_r", F.lit(True))
    known_rule = findings.select("run_id", "requirement_id", "rule_id").distinct().withColumn("_f", F.lit(True))
    tagged = ev.join(known_req, ["run_id", "requirement_id"], "left").join(known_rule, ["run_id", "requirement_id", "rule_id"], "left")
    return _rules_to_rows(
        tagged, ["id", "run_id"],
        [
            ("_r is null", "requirementId", "'Requirement not found in this validation.'"),
            ("_r is not null and rule_id is not null and _f is null", "ruleId", "'Rule finding not found in this validation.'"),
            (f"kind in ('file', 'screenshot') and file_size_bytes not between 1 and {MAX_ATTACHMENT_BYTES}", "file",
             "'Attachment must be between 1 byte and 5 MB.'"),
        ],
    )


def revision_conflicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New packages whose (project, name, revision) is already stored; a revision is never overwritten."""
    keys = ["project_id", "name", "revision"]
    return new.join(existing.select(*keys).distinct(), keys, "left_semi")
