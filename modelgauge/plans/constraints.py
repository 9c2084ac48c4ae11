"""Registered queries: constraint checks over the derived models, requirements, reviews and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.operators import checks as C
from modelgauge.plans.oracle import cte
from modelgauge.plans.registry import query
from modelgauge.plans.validation import findings, run_req
from modelgauge.sources import testbed as tb

_REUSED = "CASE WHEN {k} % 50 = 0 THEN '{p}shared-' || ({k} % 4) ELSE '{p}' || {k} END"


@query(
    "dup_element_ids",
    f"""SELECT model_id, element_type, element_id, pos, 'Duplicate model element id: ' || element_id AS message FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id, element_id ORDER BY ord, pos) AS rn FROM (
    SELECT model_id, 'level' AS element_type, level_id AS element_id, 1 AS ord, pos FROM x_levels
    UNION ALL SELECT model_id, 'room', {_REUSED.format(k='pos', p='el-')}, 2, pos FROM x_rooms WHERE v = 'a'
    UNION ALL SELECT model_id, 'door', {_REUSED.format(k='pos', p='el-')}, 3, pos FROM x_doors)) WHERE rn > 1""",
)
def _dups(spark, d):
    shared = "if(pos % 50 = 0, concat('el-shared-', pos % 4), concat('el-', pos))"
    rooms = tb.room_facts(spark, d).withColumn("room_id", F.expr(shared))
    doors = tb.doors(spark, d).withColumn("door_id", F.expr(shared))
    return C.dup_element_ids(tb.levels(spark, d), rooms, doors)


@query(
    "unknown_levels",
    """SELECT model_id, element_type, element_id, pos, 'Unknown level id: ' || level_id AS message FROM (
  SELECT model_id, 'room' AS element_type, room_id AS element_id, level_id, pos FROM x_rooms WHERE v = 'a'
  UNION ALL SELECT model_id, 'door', door_id, level_id, pos FROM x_doors) e
WHERE NOT EXISTS (SELECT 1 FROM x_levels l WHERE l.model_id = e.model_id AND l.level_id = e.level_id)""",
)
def _levels(spark, d):
    return C.unknown_levels(tb.levels(spark, d), tb.room_facts(spark, d), tb.doors(spark, d))


def _bridges(spark, d):
    return (
        tb.room_facts(spark, d), tb.doors(spark, d),
        tb.bridge(spark, d).where("o_orderkey % 13 <> 0").select("model_id", "room_id", "door_id"),
        tb.door_rooms(spark, d),
    )


cte("x_fwd", "SELECT model_id, room_id, door_id, count(*) AS n FROM x_bridge WHERE o_orderkey % 13 <> 0 GROUP BY ALL")
cte("x_rev", "SELECT model_id, room_id, door_id, count(*) AS n FROM x_door_rooms GROUP BY ALL")


@query(
    "dangling_refs",
    """SELECT model_id, 'room' AS owner_type, room_id AS owner_id, door_id AS target_id, n AS entries, 'Unknown door id: ' || door_id AS message FROM x_fwd f
WHERE NOT EXISTS (SELECT 1 FROM x_doors x WHERE x.model_id = f.model_id AND x.door_id = f.door_id)
UNION ALL SELECT model_id, 'door', door_id, room_id, n, 'Unknown room id: ' || room_id FROM x_rev r
WHERE NOT EXISTS (SELECT 1 FROM x_rooms x WHERE x.v = 'a' AND x.model_id = r.model_id AND x.room_id = r.room_id)""",
)
def _dangling(spark, d):
    return C.dangling_refs(*_bridges(spark, d))


@query(
    "non_reciprocal",
    """SELECT model_id, 'room' AS owner_type, room_id AS owner_id, door_id AS target_id, n AS entries,
  'Relationship ' || room_id || ' -> ' || door_id || ' is not reciprocal' AS message FROM x_fwd f
WHERE EXISTS (SELECT 1 FROM x_doors x WHERE x.model_id = f.model_id AND x.door_id = f.door_id)
  AND NOT EXISTS (SELECT 1 FROM x_rev r WHERE r.model_id = f.model_id AND r.door_id = f.door_id AND r.room_id = f.room_id)
UNION ALL SELECT model_id, 'door', door_id, room_id, n, 'Relationship ' || door_id || ' -> ' || room_id || ' is not reciprocal' FROM x_rev r
WHERE EXISTS (SELECT 1 FROM x_rooms x WHERE x.v = 'a' AND x.model_id = r.model_id AND x.room_id = r.room_id)
  AND NOT EXISTS (SELECT 1 FROM x_fwd f WHERE r.model_id = f.model_id AND r.door_id = f.door_id AND r.room_id = f.room_id)""",
)
def _reciprocal(spark, d):
    return C.non_reciprocal(*_bridges(spark, d))


@query(
    "model_field_violations",
    """SELECT model_id, 'model' AS element_type, model_id AS element_id, 'levels' AS path, 'Model needs at least one level' AS message FROM x_models
  WHERE CAST(replace(model_id, 'mdl-', '') AS BIGINT) % 45 = 0
UNION ALL SELECT model_id, 'level', level_id, 'name', 'Required text is empty' FROM x_levels WHERE pos = 2 AND CAST(replace(model_id, 'mdl-', '') AS BIGINT) % 45 <> 0
UNION ALL SELECT model_id, 'room', room_id, 'roomType', 'Unknown room type: lab' FROM x_rooms WHERE v = 'a' AND pos % 23 = 0
UNION ALL SELECT model_id, 'room', room_id, 'areaSqm', 'Area must be positive' FROM x_rooms WHERE v = 'a' AND area_sqm - 10 <= 0
UNION ALL SELECT model_id, 'door', door_id, 'widthM', 'Width must be positive' FROM x_doors WHERE width_m - 0.7::DOUBLE <= 0""",
)
def _fields(spark, d):
    """Same tables with faults planted by key: no levels, blank names, bad room types, shifted measures."""
    num = "cast(substring(model_id, 5) as bigint)"
    return C.model_field_violations(
        tb.models(spark, d),
        tb.levels(spark, d).where(f"{num} % 45 <> 0").withColumn("name", F.expr("if(pos = 2, '', name)")),
        tb.room_facts(spark, d).withColumns(
            {"room_type": F.expr("if(pos % 23 = 0, 'lab', room_type)"), "area_sqm": F.expr("area_sqm - 10")}
        ),
        tb.doors(spark, d).withColumn("width_m", F.expr("width_m - 0.7D")),
    )


def part_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Requirement rows derived from parts: one package per brand, faults follow from the part's own values."""
    return tb.table(spark, d, "part").selectExpr(
        "concat('pkg-', replace(p_brand, '#', '')) as spec_id",
        "if(p_partkey % 40 = 7, concat('R-', p_size), concat('R-', p_partkey)) as requirement_id",
        "if(p_partkey % 37 = 0, ' ', p_name) as title",
        """case p_partkey % 6 when 0 then 'minimum_room_area' when 1 then 'minimum_door_width_for_room_type' when 2 then 'room_has_connected_door'
             when 3 then 'composite_room_rule' when 4 then 'textual_requirement' else if(p_partkey % 11 = 0, 'free_text', 'minimum_room_area') end as type""",
        "if(p_partkey % 29 = 0, 'fatal', 'warning') as severity",
        "p_partkey as pos",
        "if(p_partkey % 6 in (0, 1, 3, 5), if(p_partkey % 31 = 0, 'lab', 'office'), if(p_partkey % 13 = 0, 'office', null)) as room_type",
        "if(p_partkey % 6 in (0, 1, 5), cast(p_size - 3 as double), null) as min_value",
        "if(p_partkey % 6 in (0, 1, 5) and p_partkey % 4 = 0, cast(20 as double), null) as max_value",
        "if(p_partkey % 6 = 1, if(p_partkey % 7 = 0, 'some', 'any'), null) as quantifier",
        "if(p_partkey % 6 = 3 and p_partkey % 9 <> 0, 'and', null) as operator",
        """if(p_partkey % 6 = 3, transform(sequence(1, p_size % 13), i -> struct(if(i % 2 = 0, 'room_area_range', 'connected_door_width_range') as type,
             cast(i as double) as min, cast(if(i = 3, 2, null) as double) as max, cast(null as string) as quantifier)), null) as conditions""",
        "if(p_partkey % 6 = 4 and p_partkey % 8 <> 0, 'informational', 'ready_for_validation') as automation_status",
        "element_at(array('m2', 'mm', 'kg', 'SQM'), cast(p_partkey % 4 + 1 as int)) as unit",
        "element_at(array('area', 'length', 'untyped'), cast(p_partkey % 3 + 1 as int)) as quantity_type",
        "p_type as discipline", "cast(null as string) as description",
        "if(p_partkey % 2 = 0, named_struct('document', p_brand, 'section', cast(p_size as string), 'revision', cast(null as string)), null) as source",
    )


cte(
    "x_preq",
    """SELECT 'pkg-' || replace(p_brand, '#', '') AS spec_id, CASE WHEN p_partkey % 40 = 7 THEN 'R-' || p_size ELSE 'R-' || p_partkey END AS requirement_id,
  CASE WHEN p_partkey % 37 = 0 THEN ' ' ELSE p_name END AS title,
  CASE p_partkey % 6 WHEN 0 THEN 'minimum_room_area' WHEN 1 THEN 'minimum_door_width_for_room_type' WHEN 2 THEN 'room_has_connected_door'
    WHEN 3 THEN 'composite_room_rule' WHEN 4 THEN 'textual_requirement' ELSE CASE WHEN p_partkey % 11 = 0 THEN 'free_text' ELSE 'minimum_room_area' END END AS type,
  CASE WHEN p_partkey % 29 = 0 THEN 'fatal' ELSE 'warning' END AS severity, p_partkey AS pos, p_partkey AS k, p_size,
  CASE WHEN p_partkey % 6 IN (0, 1, 3, 5) THEN CASE WHEN p_partkey % 31 = 0 THEN 'lab' ELSE 'office' END ELSE CASE WHEN p_partkey % 13 = 0 THEN 'office' END END AS room_type,
  CASE WHEN p_partkey % 6 IN (0, 1, 5) THEN (p_size - 3)::DOUBLE END AS min_value,
  CASE WHEN p_partkey % 6 IN (0, 1, 5) AND p_partkey % 4 = 0 THEN 20.0::DOUBLE END AS max_value,
  CASE WHEN p_partkey % 6 = 1 THEN CASE WHEN p_partkey % 7 = 0 THEN 'some' ELSE 'any' END END AS quantifier,
  CASE WHEN p_partkey % 6 = 3 AND p_partkey % 9 <> 0 THEN 'and' END AS operator,
  CASE WHEN p_partkey % 6 = 4 AND p_partkey % 8 <> 0 THEN 'informational' ELSE 'ready_for_validation' END AS automation_status,
  ['m2', 'mm', 'kg', 'SQM'][p_partkey % 4 + 1] AS unit, ['area', 'length', 'untyped'][p_partkey % 3 + 1] AS quantity_type,
  p_size % 13 AS n_conditions, p_type AS discipline, p_brand FROM part""",
)
# sequence(1, 0) counts down to 0 in the engine: two conditions, the last with a zero minimum.
cte("x_preq2", "SELECT * REPLACE (CASE WHEN n_conditions = 0 THEN 2 ELSE n_conditions END AS n_conditions), n_conditions = 0 AS zero_min FROM x_preq")
_A, _W, _C2, _T = ("type = 'minimum_room_area'", "type = 'minimum_door_width_for_room_type'", "type = 'composite_room_rule'", "type = 'textual_requirement'")


def _rule_sql(rules) -> str:
    return " UNION ALL ".join(
        f"SELECT spec_id, requirement_id, pos, '{p}' AS path, {m} AS message FROM x_preq2 WHERE {c}" for c, p, m in rules
    )


@query(
    "requirement_shape_violations",
    _rule_sql([
        ("trim(title) = ''", "title", "'Title is required'"),
        ("severity = 'fatal'", "severity", "'Unknown severity'"),
        ("type = 'free_text'", "type", "'Unknown requirement type'"),
        (f"({_A} OR {_W} OR {_C2}) AND room_type = 'lab'", "roomType", "'Room type is missing or unknown'"),
        (f"({_A} OR {_W}) AND min_value <= 0", "minimum", "'Minimum must be a positive number'"),
        (f"{_W} AND quantifier = 'some'", "quantifier", "'Quantifier must be any or all'"),
        ("type = 'free_text' AND min_value IS NOT NULL", "minimum", "'Field is not allowed for this type'"),
        (f"NOT ({_A} OR {_W} OR {_C2}) AND room_type IS NOT NULL", "roomType", "'Field is not allowed for this type'"),
        (f"{_C2} AND operator IS NULL", "operator", "'Operator must be and or or'"),
        (f"{_C2} AND zero_min", "conditions", "'Condition bounds must be positive'"),
        (f"{_T} AND automation_status = 'ready_for_validation'", "automationStatus", "'Unknown automation status'"),
    ]),
)
def _shape(spark, d):
    return C.requirement_shape_violations(part_requirements(spark, d))


@query(
    "requirement_unit_violations",
    _rule_sql([
        (f"{_A} AND quantity_type <> 'area'", "quantityType", "'Room area rules require quantityType ''area'''"),
        (f"{_A} AND lower(unit) NOT IN ('m²', 'm2', 'sqm')", "unit", "'Room area rules require an area unit'"),
        (f"{_W} AND quantity_type <> 'length'", "quantityType", "'Door width rules require quantityType ''length'''"),
        (f"{_W} AND lower(unit) NOT IN ('mm', 'cm', 'm')", "unit", "'Door width rules require a length unit'"),
    ]),
)
def _units(spark, d):
    return C.requirement_unit_violations(part_requirements(spark, d))


@query(
    "inverted_ranges",
    _rule_sql([
        (f"{_A} AND max_value < min_value", "maxAreaSqm", "'Maximum room area must be greater than or equal to minimum room area'"),
        (f"{_W} AND max_value < min_value", "maxDoorWidthM", "'Maximum door width must be greater than or equal to minimum door width'"),
        (f"{_C2} AND n_conditions >= 3", "conditions.2.maxDoorWidthM", "'Condition maximum must be greater than or equal to its minimum'"),
    ]),
)
def _inverted(spark, d):
    return C.inverted_ranges(part_requirements(spark, d))


@query(
    "package_size_violations",
    f"""SELECT spec_id, NULL::VARCHAR AS requirement_id, NULL::BIGINT AS pos, 'requirements' AS path, 'Package has ' || n || ' requirements; expected 1 to 1000' AS message FROM (
  SELECT p.spec_id, count(q.spec_id) AS n FROM (SELECT DISTINCT spec_id FROM x_preq UNION ALL SELECT 'pkg-none-' || r_regionkey FROM region) p LEFT JOIN x_preq q USING (spec_id) GROUP BY 1)
WHERE n NOT BETWEEN 1 AND 1000
UNION ALL SELECT spec_id, requirement_id, pos, 'conditions', 'Composite rules need 2 to 10 conditions' FROM x_preq2 WHERE {_C2} AND n_conditions NOT BETWEEN 2 AND 10""",
)
def _sizes(spark, d):
    req = part_requirements(spark, d)
    empty = tb.table(spark, d, "region").selectExpr("concat('pkg-none-', r_regionkey) as spec_id")
    return C.package_size_violations(req.select("spec_id").distinct().unionByName(empty), req)


@query(
    "dup_requirement_ids",
    """SELECT spec_id, requirement_id, pos, 'id' AS path, 'Duplicate requirement id: ' || requirement_id AS message FROM (
  SELECT *, row_number() OVER (PARTITION BY spec_id, requirement_id ORDER BY pos) AS rn FROM x_preq) WHERE rn > 1""",
)
def _dup_req(spark, d):
    return C.dup_requirement_ids(part_requirements(spark, d))


@query(
    "package_consistency",
    """SELECT file, NULL::BIGINT AS row, 'specification name and revision must be consistent across all rows' AS message FROM (
  SELECT o_custkey AS file, count(DISTINCT nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Brief' END, '')) AS n,
    count(DISTINCT CASE WHEN o_orderkey % 40 = 0 THEN 'B' ELSE 'A' END) AS r FROM orders GROUP BY 1) WHERE n > 1 OR r > 1
UNION ALL SELECT o_custkey, o_orderkey, 'must provide both source_document and source_section' FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 10 = 0)""",
)
def _consistency(spark, d):
    rows = tb.table(spark, d, "orders").selectExpr(
        "o_custkey as file", "o_orderkey as row", "if(o_orderkey % 3 = 0, '', 'Brief') as specification_name",
        "if(o_orderkey % 40 = 0, 'B', 'A') as specification_revision",
        "if(o_orderkey % 5 = 0, '', 'Doc') as source_document", "if(o_orderkey % 10 = 0, ' ', '4.1') as source_section",
    )
    return C.package_consistency(rows)


cte(
    "x_reviews",
    """SELECT 'run-a-mdl-' || user_id AS run_id, ['REQ-AREA-STOCK', 'REQ-DOOR-ALL', 'REQ-DOOR-ANY', 'REQ-COMP-AND', 'REQ-TEXT-CFG'][event_id % 5 + 1] AS requirement_id,
  'dec-' || event_id AS decision_id, event_id,
  CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'acknowledged' WHEN 'purchase' THEN 'waived' WHEN 'error' THEN 'resolved' ELSE 'resolved' END AS status,
  'Decision ' || event_id AS comment,
  CASE WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN 'Agreed deviation' WHEN event_id % 50 = 1 THEN 'Left over' END AS waiver_reason,
  CASE WHEN event_id % 7 = 0 THEN ts END AS waiver_expires_at, 'usr-' || (event_id % 9) AS reviewer_id, ts AS decided_at FROM events""",
)


@query(
    "review_violations",
    """SELECT run_id, requirement_id, decision_id, 'waiverReason' AS path, 'Waived decisions require a waiver reason.' AS message FROM x_reviews WHERE status = 'waived' AND waiver_reason IS NULL
UNION ALL SELECT run_id, requirement_id, decision_id, 'waiverReason', 'Waiver fields are only valid for waived decisions.' FROM x_reviews
WHERE status <> 'waived' AND (waiver_reason IS NOT NULL OR waiver_expires_at IS NOT NULL)""",
)
def _reviews(spark, d):
    return C.review_violations(tb.reviews_log(spark, d))


cte(
    "x_evidence",
    """SELECT 'evd-' || event_id AS id, event_id, 'run-a-mdl-' || user_id AS run_id,
  ['REQ-AREA-STOCK', 'REQ-DOOR-ALL', 'REQ-HAS-DOOR', 'REQ-GONE'][event_id % 4 + 1] AS requirement_id,
  CASE WHEN event_id % 3 = 0 THEN 'RoomHasConnectedDoorRule' END AS rule_id,
  ['file', 'screenshot', 'model_element', 'comment', 'link', 'technical_note'][event_id % 6 + 1] AS kind,
  CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'Seen on site' END AS comment, CASE WHEN event_id % 7 <> 0 THEN 'https://example.org/' || event_id END AS link_url,
  CASE WHEN event_id % 11 <> 0 THEN 'value ' || value END AS technical_note, CASE WHEN event_id % 13 <> 0 THEN 'rm-' || event_id END AS model_element_id, 'room' AS model_element_type,
  CASE WHEN event_id % 17 <> 0 THEN 'photo ' || event_id || '.png' END AS file_name, CAST(floor(value * 1000000) AS BIGINT) AS file_size_bytes,
  sha256(event_id::VARCHAR) AS file_content_hash, 'usr-' || (event_id % 9) AS created_by, ts AS created_at FROM events""",
)


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Attached evidence derived from events; payload gaps follow from the event id."""
    return tb.table(spark, d, "events").selectExpr(
        "concat('evd-', event_id) as id", "event_id", "concat('run-a-mdl-', user_id) as run_id",
        "element_at(array('REQ-AREA-STOCK', 'REQ-DOOR-ALL', 'REQ-HAS-DOOR', 'REQ-GONE'), cast(event_id % 4 + 1 as int)) as requirement_id",
        "if(event_id % 3 = 0, 'RoomHasConnectedDoorRule', null) as rule_id",
        "element_at(array('file', 'screenshot', 'model_element', 'comment', 'link', 'technical_note'), cast(event_id % 6 + 1 as int)) as kind",
        "if(event_id % 5 = 0, ' ', 'Seen on site') as comment",
        "if(event_id % 7 <> 0, concat('https://example.org/', event_id), null) as link_url",
        "if(event_id % 11 <> 0, concat('value ', value), null) as technical_note",
        "if(event_id % 13 <> 0, concat('rm-', event_id), null) as model_element_id", "'room' as model_element_type",
        "if(event_id % 17 <> 0, concat('photo ', event_id, '.png'), null) as file_name",
        "floor(value * 1000000) as file_size_bytes", "sha2(cast(event_id as string), 256) as file_content_hash",
        "concat('usr-', event_id % 9) as created_by", "cast(ts as timestamp) as created_at",
    )


@query(
    "evidence_violations",
    """SELECT id, run_id, kind, 'file' AS path, 'File and screenshot evidence require fileName and fileContentBase64.' AS message FROM x_evidence WHERE kind IN ('file', 'screenshot') AND file_name IS NULL
UNION ALL SELECT id, run_id, kind, 'modelElementId', 'Model element evidence requires modelElementId and modelElementType.' FROM x_evidence WHERE kind = 'model_element' AND model_element_id IS NULL
UNION ALL SELECT id, run_id, kind, 'comment', 'Comment evidence requires a comment.' FROM x_evidence WHERE kind = 'comment' AND trim(comment) = ''
UNION ALL SELECT id, run_id, kind, 'linkUrl', 'Link evidence requires linkUrl.' FROM x_evidence WHERE kind = 'link' AND link_url IS NULL
UNION ALL SELECT id, run_id, kind, 'technicalNote', 'Technical note evidence requires technicalNote.' FROM x_evidence WHERE kind = 'technical_note' AND technical_note IS NULL""",
)
def _evidence(spark, d):
    return C.evidence_violations(evidence(spark, d))


@query(
    "orphan_evidence",
    """SELECT e.id, e.run_id, 'requirementId' AS path, 'Requirement not found in this validation.' AS message FROM x_evidence e
WHERE NOT EXISTS (SELECT 1 FROM x_run_req r WHERE r.run_id = e.run_id AND r.requirement_id = e.requirement_id)
UNION ALL SELECT e.id, e.run_id, 'ruleId', 'Rule finding not found in this validation.' FROM x_evidence e
WHERE e.rule_id IS NOT NULL AND EXISTS (SELECT 1 FROM x_run_req r WHERE r.run_id = e.run_id AND r.requirement_id = e.requirement_id)
  AND NOT EXISTS (SELECT 1 FROM x_findings f WHERE f.run_id = e.run_id AND f.requirement_id = e.requirement_id AND f.rule_id = e.rule_id)
UNION ALL SELECT id, run_id, 'file', 'Attachment must be between 1 byte and 5 MB.' FROM x_evidence WHERE kind IN ('file', 'screenshot') AND file_size_bytes NOT BETWEEN 1 AND 5242880""",
)
def _orphans(spark, d):
    return C.orphan_evidence(evidence(spark, d), run_req(spark, d), findings(spark, d))


@query(
    "revision_conflicts",
    """SELECT o_orderkey AS upload_id, project_id, name, revision FROM (SELECT o_orderkey, 'prj-' || (o_custkey % 50) AS project_id, o_orderpriority AS name, year(o_orderdate)::VARCHAR AS revision FROM orders WHERE o_orderstatus = 'O') n
WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_orderstatus = 'F' AND 'prj-' || (x.o_custkey % 50) = n.project_id AND x.o_orderpriority = n.name AND year(x.o_orderdate)::VARCHAR = n.revision)""",
)
def _conflicts(spark, d):
    o = tb.table(spark, d, "orders").selectExpr(
        "o_orderkey as upload_id", "concat('prj-', o_custkey % 50) as project_id", "o_orderpriority as name",
        "cast(year(o_orderdate) as string) as revision", "o_orderstatus",
    )
    new = o.where("o_orderstatus = 'O'").drop("o_orderstatus")
    return C.revision_conflicts(new, o.where("o_orderstatus = 'F'").drop("o_orderstatus")).select("upload_id", "project_id", "name", "revision")
