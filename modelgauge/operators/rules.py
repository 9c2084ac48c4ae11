"""Rule evaluation: requirements x elements in four-valued logic, with evidence.

Shape of the plan: door links are resolved once per room (one shuffle on the door key, one on the
room key); after that every area, width and composite rule is a narrow expression over the room row,
so adding requirements adds no shuffle. Rooms meet requirements by an equi-join on
(model_id, room_type), salted by room so that one huge model does not land in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgauge import schemas
from modelgauge.functions.columns import combine, fmt_num_sql
from modelgauge.functions.ordered import passing
from modelgauge.functions.skew import salted_join
from modelgauge.operators.checks import ROOM_TYPES

AREA = "minimum_room_area"
WIDTH = "minimum_door_width_for_room_type"
HAS_DOOR = "room_has_connected_door"
COMPOSITE = "composite_room_rule"
TEXTUAL = "textual_requirement"
TARGETED = (AREA, WIDTH, COMPOSITE)
OTHER_TYPE = "(other)"

# Rule identifiers written into findings.
RULE_IDS = {
    AREA: "MinimumRoomAreaRule",
    WIDTH: "MinimumDoorWidthForRoomTypeRule",
    HAS_DOOR: "RoomHasConnectedDoorRule",
    COMPOSITE: "CompositeRoomRule",
    TEXTUAL: "TextualRequirement",
}

FINDING_COLUMNS = schemas.names(schemas.FINDINGS)
Step = Callable[[DataFrame], DataFrame]


def run_requirements(runs: DataFrame, requirements: DataFrame) -> DataFrame:
    """One row per (run, requirement of the run's package). Condition texts are rendered on the package, once for all of its runs."""
    return runs.select("run_id", "model_id", "spec_id").join(requirements.withColumn("rendered", F.expr(_RENDERED)), "spec_id")


def _evidence(message: Column, field: str, observed: Column, expected: Column) -> Column:
    return F.struct(
        message.alias("message"),
        observed.cast("string").alias("observed"),
        expected.cast("string").alias("expected"),
        F.lit(field).alias("field"),
    )


def link_doors(rooms: DataFrame, doors: DataFrame, step: Step = lambda df: df) -> DataFrame:
    """Rooms with `links`, their door list in order, each entry with the width of the model's door, and `unresolved_id`, the first id
    that the model's doors lack.

    NULL and empty lists are decided on the room row before anything is exploded, so the two never
    merge: `has_list` is false for NULL, `n_links` is 0 for both. Repeated ids stay repeated.
    Element ids must be unique in a model (models with violations are not evaluated).
    Only keys and places go to the doors; room columns are dealt once, together with the entries that come back. `step` may write the
    entries before they are dealt, so that what met the doors is off the disk by then.
    """
    carried = [c for c in rooms.columns if c not in ("model_id", "room_id", "door_ids")]
    facts = rooms.selectExpr(
        "model_id", "room_id",
        f"struct({', '.join([*carried, 'door_ids is not null as has_list', 'coalesce(size(door_ids), 0) as n_links'])}) as room",
    )
    links = rooms.selectExpr("model_id", "room_id", "posexplode(door_ids) as (door_pos, door_id)")
    catalogue = doors.selectExpr("model_id", "door_id", "width_m", "true as found")
    found = salted_join(links, catalogue, ["model_id", "door_id"], ["room_id"], how="left")
    entries = step(found.selectExpr("model_id", "room_id", "struct(door_pos, door_id, found, width_m) as entry"))
    gathered = (
        facts.unionByName(entries, allowMissingColumns=True)
        .repartition("model_id", "room_id")
        .groupBy("model_id", "room_id")
        .agg(F.first("room", ignorenulls=True).alias("room"), F.array_sort(F.collect_list("entry")).alias("entries"))
    )
    return gathered.selectExpr(
        "model_id", "room_id", "room.*",
        "transform(entries, d -> struct(d.door_id as door_id, d.width_m as width_m)) as links",
        "try_element_at(transform(filter(entries, d -> d.found is null), d -> d.door_id), 1) as unresolved_id",
    )


_KNOWN = f"""transform(filter(links, d -> d.width_m is not null),
    d -> struct(d.width_m as width_m, concat(d.door_id, ':', {fmt_num_sql('d.width_m')}) as label))"""
_UNMEASURED = "transform(filter(links, d -> d.width_m is null), d -> d.door_id)"
_LINK_IDS = "transform(links, d -> d.door_id)"


def resolve_doors(rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """Rooms with their door list resolved against the model's doors. `known` holds (width, "id:width") of the measured doors."""
    linked = link_doors(rooms, doors)
    return linked.selectExpr(
        *[c for c in linked.columns if c not in ("links", "unresolved_id")],
        f"{_KNOWN} as known", f"{_UNMEASURED} as unmeasured_ids", f"{_LINK_IDS} as link_ids", "unresolved_id",
    )


# Targeted requirements as condition lists; area and width rules become one-condition lists.
_RENDERED = f"""if(type = '{HAS_DOOR}', null, transform(
    if(type = '{COMPOSITE}', conditions, array(struct(if(type = '{AREA}', 'room_area_range', 'connected_door_width_range') as type, min_value as min, max_value as max, quantifier))),
    c -> struct(
        c.type = 'room_area_range' as is_area, c.min as min, c.max as max, coalesce(c.quantifier, 'all') as q,
        {fmt_num_sql('c.min')} as min_text,
        concat(if(c.max is null, concat('>= ', {fmt_num_sql('c.min')}), concat({fmt_num_sql('c.min')}, '-', {fmt_num_sql('c.max')})),
            if(c.type = 'room_area_range', ' sqm', ' m')) as wanted)))"""


def _as_conditions(req: DataFrame) -> DataFrame:
    """Targeted requirements with their conditions, a row for each room type they look at. Conditions that `run_requirements` has rendered
    are taken as they are."""
    # A has-door rule looks at every room: it is listed under each room type, so that all rules meet the
    # rooms in one equi-join.
    every = ", ".join(f"'{t}'" for t in (*ROOM_TYPES, OTHER_TYPE))
    keys = f"explode(if(type = '{HAS_DOOR}', array({every}), array(room_type))) as type_key"
    return req.where(F.col("type").isin(*TARGETED, HAS_DOOR)).selectExpr(
        "run_id", "model_id", "requirement_id", "title", "severity", "type", "operator", "pos as req_pos",
        "rendered as conditions" if "rendered" in req.columns else f"{_RENDERED} as conditions", keys,
    )


def _type_key(rooms: DataFrame) -> DataFrame:
    return rooms.withColumn("type_key", F.when(F.col("room_type").isin(*ROOM_TYPES), F.col("room_type")).otherwise(OTHER_TYPE))


# Branch evaluation in three staged array transforms: door split -> case -> texts. Outcome-only
# consumers read `cases` and never pay for the texts.
_SPLIT = """transform(conditions, c -> struct(c as c,
    if(c.is_area, null, filter(known, d -> d.width_m >= c.min and (c.max is null or d.width_m <= c.max))) as passing,
    if(c.is_area, null, filter(known, d -> not (d.width_m >= c.min and (c.max is null or d.width_m <= c.max)))) as failing))"""

_CASES = """transform(_split, s -> struct(s.c as c, s.failing as failing, case
    when s.c.is_area then case when area_sqm is null then 'area_missing'
        when area_sqm >= s.c.min and (s.c.max is null or area_sqm <= s.c.max) then 'area_ok' else 'area_bad' end
    when not has_list then 'no_list'
    when n_links = 0 then 'empty'
    when unresolved_id is not null then 'unresolved'
    when s.c.q = 'any' then case when size(s.passing) > 0 then 'pass' when size(unmeasured_ids) = 0 then 'fail' else 'unmeasured' end
    when size(s.failing) > 0 then 'fail' when size(unmeasured_ids) = 0 then 'pass' else 'unmeasured' end as k))"""

_STATUSES = """transform(_cases, b -> case when b.k in ('area_ok', 'pass') then 'pass'
    when b.k in ('area_bad', 'empty', 'fail') then 'fail' else 'unknown' end)"""

_LEAD = "case when b.k = 'pass' then if(b.c.q = 'any', 'At least one', 'All') else if(b.c.q = 'any', 'No', 'Not all') end"

_BRANCHES = f"""transform(_cases, b -> struct(
    case b.k
        when 'area_missing' then concat('Cannot verify area for ', name, '; area is missing.')
        when 'area_ok' then concat(name, ' area ', area_text, ' sqm satisfies ', b.c.wanted, '.')
        when 'area_bad' then concat(name, ' area ', area_text, ' sqm violates ', b.c.wanted, '.')
        when 'no_list' then concat('Cannot verify door widths for ', name, '; door relationship data is missing.')
        when 'empty' then concat(name, ' has no connected doors; required minimum door width cannot be met.')
        when 'unresolved' then concat('Cannot verify ', name, '; connected door ', unresolved_id, ' is not present in model doors.')
        when 'unmeasured' then concat('Cannot verify whether ', b.c.q, ' connected doors for ', name, ' satisfy ', b.c.wanted,
            '; one or more doors have missing width.')
        else concat({_LEAD}, ' connected doors for ', name, ' satisfy ', b.c.wanted, '.') end as summary,
    case when b.k in ('pass', 'fail') then concat(array(room_id), link_ids)
        when b.k = 'unmeasured' then concat(array(room_id), unmeasured_ids)
        when b.k = 'unresolved' then array(room_id, unresolved_id)
        else array(room_id) end as affected,
    case b.k
        when 'area_missing' then 'Area parameter is not available in normalized model data.'
        when 'area_ok' then 'Room area was compared against deterministic threshold.'
        when 'area_bad' then 'Room area was compared against deterministic threshold.'
        when 'no_list' then 'Connected door identifiers are required but not available.'
        when 'empty' then 'No connected door found for room.'
        when 'unresolved' then 'Door id referenced by room cannot be resolved in door set.'
        when 'unmeasured' then 'Door width parameter is missing for connected door.'
        else concat({_LEAD}, ' connected door widths meet the deterministic range.') end as message,
    case b.k
        when 'area_ok' then area_text when 'area_bad' then area_text when 'empty' then '[]'
        when 'unresolved' then unresolved_id
        when 'unmeasured' then array_join(unmeasured_ids, ', ')
        when 'pass' then array_join(transform(known, d -> d.label), ', ')
        when 'fail' then array_join(transform(b.failing, d -> d.label), ', ') end as observed,
    case b.k
        when 'area_missing' then concat('>= ', b.c.min_text)
        when 'area_ok' then b.c.wanted when 'area_bad' then b.c.wanted
        when 'no_list' then 'Array of door ids'
        when 'empty' then concat('At least one door width >= ', b.c.min_text, 'm')
        when 'unresolved' then 'Door id existing in model.doors'
        else concat(b.c.q, ' connected doors within ', b.c.wanted) end as expected,
    case when b.c.is_area then 'room.areaSqm' when b.k in ('no_list', 'empty', 'unresolved') then 'room.connectedDoorIds'
        else 'door.widthM' end as field))"""

_EVIDENCE = """transform(_branches, (b, i) -> struct(
    if(type = 'composite_room_rule', concat('Condition ', i + 1, ' (', _statuses[i], '): ', b.message), b.message) as message,
    b.observed as observed, b.expected as expected, b.field as field))"""


_HAS_DOOR_EVIDENCE = """array(struct(
    if(has_list, 'Room-to-door relationships were checked for minimum connectivity.', 'Connected door relationship is missing in normalized data.') as message,
    if(has_list, cast(n_links as string), null) as observed, if(has_list, '>= 1', 'At least one connected door id') as expected, 'room.connectedDoorIds' as field))"""


def _judge(pairs: DataFrame) -> DataFrame:
    """Findings of (room, requirement) pairs."""
    staged = (
        pairs.withColumn("_split", F.expr(_SPLIT))
        .withColumn("_cases", F.expr(_CASES))
        .withColumn("_statuses", F.expr(_STATUSES))
        .withColumn("_branches", F.expr(_BRANCHES))
    )
    composite = F.col("type") == COMPOSITE
    status = (
        F.when(F.col("type") == HAS_DOOR, F.expr("case when not has_list then 'unknown' when n_links > 0 then 'pass' else 'fail' end"))
        .when(composite, combine(F.col("operator"), F.col("_statuses")))
        .otherwise(F.get("_statuses", F.lit(0)))
    )
    return staged.withColumn("_status", status).select(
        "run_id",
        "requirement_id",
        F.expr("case type " + " ".join(f"when '{t}' then '{i}'" for t, i in RULE_IDS.items()) + " end").alias("rule_id"),
        F.col("title").alias("requirement_title"),
        F.lit("room").alias("element_type"),
        F.col("_status").alias("status"),
        "severity",
        F.expr(
            f"""case type when '{COMPOSITE}' then concat(name, ': ', upper(operator), ' composite rule is ', _status, '; branch results: ', array_join(_statuses, ', '), '.')
                when '{HAS_DOOR}' then case when not has_list then concat('Cannot verify connected doors for ', name, '; relationship data is missing.')
                    when n_links > 0 then concat(name, ' has at least one connected door.') else concat(name, ' has no connected doors.') end
                else get(_branches, 0).summary end"""
        ).alias("summary"),
        F.expr(
            f"""case type when '{COMPOSITE}' then array_distinct(flatten(transform(_branches, b -> b.affected))) when '{HAS_DOOR}' then array(room_id)
                else get(_branches, 0).affected end"""
        ).alias("affected_element_ids"),
        F.expr(f"if(type = '{HAS_DOOR}', {_HAS_DOOR_EVIDENCE}, {_EVIDENCE})").alias("evidence"),
        "req_pos",
        F.col("pos").alias("element_pos"),
    )


def _linked(rooms: DataFrame, doors: DataFrame, step: Step | None) -> DataFrame:
    if step is None:
        return link_doors(rooms, doors)
    with passing(rooms.sparkSession) as once:
        return step(link_doors(rooms, doors, once))


def rule_rooms(rooms: DataFrame, doors: DataFrame, req: DataFrame, step: Step | None = None) -> DataFrame:
    """All rules that look at rooms: area, width, composite and has-door, in one pass over the rooms.

    With `step`, which writes a table and reads it back, links are resolved in steps of their own: the disk then holds the shuffle files
    of one step, not of all. Without it nothing runs before the findings are asked for (streams).
    """
    linked = _linked(rooms.drop("level_id"), doors, step)
    pairs = salted_join(_type_key(linked), _as_conditions(req), ["model_id", "type_key"], ["room_id"])
    # Texts and lists of the doors are made after the join, and only for rules that read them, so that they are never shuffled.
    read = lambda e: F.expr(f"if(type in ('{AREA}', '{HAS_DOOR}'), null, {e})")
    return _judge(
        pairs.withColumns(
            {"known": read(_KNOWN), "unmeasured_ids": read(_UNMEASURED), "link_ids": read(_LINK_IDS), "area_text": F.expr(fmt_num_sql("area_sqm"))}
        )
    )


def rule_room_area(rooms: DataFrame, req: DataFrame) -> DataFrame:
    """Inclusive area range; a missing area is unknown. Needs no door data, so no door shuffle."""
    only = _as_conditions(req.where(F.col("type") == AREA))
    return _judge(_without_links(salted_join(_type_key(_counted(rooms)), only, ["model_id", "type_key"], ["room_id"])))


def rule_door_width(rooms: DataFrame, doors: DataFrame, req: DataFrame, step: Step | None = None) -> DataFrame:
    return rule_rooms(rooms, doors, req.where(F.col("type") == WIDTH), step)


def rule_composite(rooms: DataFrame, doors: DataFrame, req: DataFrame, step: Step | None = None) -> DataFrame:
    return rule_rooms(rooms, doors, req.where(F.col("type") == COMPOSITE), step)


def _counted(rooms: DataFrame) -> DataFrame:
    """Rooms with the size of their door list instead of the list."""
    return rooms.selectExpr(
        *[c for c in rooms.columns if c != "door_ids"], "door_ids is not null as has_list", "coalesce(size(door_ids), 0) as n_links"
    )


def _without_links(pairs: DataFrame) -> DataFrame:
    """Pairs in resolved shape for the rules that never look at the doors themselves."""
    return pairs.selectExpr(
        "*", "cast(null as string) as unresolved_id",
        "cast(null as array<struct<width_m:double,label:string>>) as known",
        "cast(null as array<string>) as unmeasured_ids", "cast(null as array<string>) as link_ids",
    ).withColumn("area_text", F.expr(fmt_num_sql("area_sqm")))


def rule_has_door(rooms: DataFrame, req: DataFrame) -> DataFrame:
    """At least one connected door, over every room of the model."""
    only = _as_conditions(req.where(F.col("type") == HAS_DOOR))
    return _judge(_without_links(salted_join(_type_key(_counted(rooms)), only, ["model_id", "type_key"], ["room_id"])))


def not_applicable(rooms: DataFrame, req: DataFrame) -> DataFrame:
    """One row per targeted requirement whose room type does not occur in the model."""
    present = rooms.select("model_id", "room_type").distinct()
    absent = req.where(F.col("type").isin(*TARGETED)).join(present, ["model_id", "room_type"], "left_anti")
    return absent.select(
        "run_id",
        "requirement_id",
        F.concat("type", F.lit(":target-set")).alias("rule_id"),
        F.col("title").alias("requirement_title"),
        F.lit("model").alias("element_type"),
        F.lit("not_applicable").alias("status"),
        "severity",
        F.concat(
            F.lit("Requirement is not applicable because the model contains no "), F.col("room_type"), F.lit(" rooms.")
        ).alias("summary"),
        F.array().cast("array<string>").alias("affected_element_ids"),
        F.array(
            _evidence(
                F.lit("No elements matched the requirement target selector."), "room.roomType", F.lit("0"), F.col("room_type")
            )
        ).alias("evidence"),
        F.col("pos").alias("req_pos"),
        F.lit(0).cast("bigint").alias("element_pos"),
    )


def rule_textual(req: DataFrame) -> DataFrame:
    """Textual requirements: informational is not applicable, everything else is unknown."""
    info = F.col("automation_status") == "informational"
    info = F.coalesce(info, F.lit(False))
    return req.where(F.col("type") == TEXTUAL).select(
        "run_id",
        "requirement_id",
        F.lit(RULE_IDS[TEXTUAL]).alias("rule_id"),
        F.col("title").alias("requirement_title"),
        F.lit("model").alias("element_type"),
        F.when(info, "not_applicable").otherwise("unknown").alias("status"),
        "severity",
        F.when(info, "Informational requirement is preserved for traceability and is not evaluated.")
        .otherwise("Requirement is valid but needs deterministic rule configuration before it can be evaluated.")
        .alias("summary"),
        F.array().cast("array<string>").alias("affected_element_ids"),
        F.array(
            _evidence(
                F.when(info, "The imported row was classified as informational.").otherwise(
                    "No executable rule configuration is attached to this requirement."
                ),
                "requirement.automationStatus",
                F.col("automation_status"),
                F.lit("ready_for_validation"),
            )
        ).alias("evidence"),
        F.col("pos").alias("req_pos"),
        F.lit(0).cast("bigint").alias("element_pos"),
    )


def evaluate(rooms: DataFrame, doors: DataFrame, req: DataFrame, step: Step | None = None) -> DataFrame:
    """All findings of every run. (req_pos, element_pos) carries the requirement-then-room order. `step`: see `rule_rooms`."""
    parts = [
        rule_rooms(rooms, doors, req, step),
        not_applicable(rooms, req),
        rule_textual(req),
    ]
    out = parts[0].select(*FINDING_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*FINDING_COLUMNS))
    return out


def element_status(findings: DataFrame) -> DataFrame:
    """Worst status per element (fail > unknown > pass); not-applicable rows do not count.

    Severity comes from the first fail/unknown that wins, or from the last pass.
    """
    per_element = findings.where(F.col("status") != "not_applicable").select(
        "run_id", F.explode("affected_element_ids").alias("element_id"), "status", "severity", "req_pos", "element_pos"
    )
    rank = F.when(F.col("status") == "fail", 3).when(F.col("status") == "unknown", 2).otherwise(1)
    sign = F.when(F.col("status") == "pass", 1).otherwise(-1)
    order = F.struct(rank.alias("r"), (sign * F.col("req_pos")).alias("p"), (sign * F.col("element_pos")).alias("e"))
    return (
        per_element.groupBy("run_id", "element_id")
        .agg(F.max_by(F.struct("status", "severity"), order).alias("w"))
        .select("run_id", "element_id", F.col("w.status").alias("status"), F.col("w.severity").alias("severity"))
    )


def element_issues(findings: DataFrame) -> DataFrame:
    """Per element: number of non-pass findings and whether it is free of fails."""
    per_element = findings.select("run_id", F.explode(F.array_distinct("affected_element_ids")).alias("element_id"), "status")
    return per_element.groupBy("run_id", "element_id").agg(
        F.count_if(F.col("status") != "pass").alias("issues"),
        (F.count_if(F.col("status") == "fail") == 0).alias("compliant"),
    )


def run_threshold(findings: DataFrame, gates: DataFrame, fail_on: str) -> DataFrame:
    """Whether each run fails at a threshold; a blocking gate fails in every mode, also `none`."""
    hits = {
        "critical": (F.col("status") == "fail") & (F.col("severity") == "critical"),
        "warning": (F.col("status") == "fail") & F.col("severity").isin("critical", "warning"),
        "unknown": F.col("status") == "unknown",
        "gate": F.lit(False),
        "none": F.lit(False),
    }[fail_on]
    per_run = findings.groupBy("run_id").agg(F.count_if(hits).alias("_hits"))
    return per_run.join(gates.select("run_id", "gate_status"), "run_id", "full").select(
        "run_id",
        F.lit(fail_on).alias("fail_on"),
        ((F.coalesce("_hits", F.lit(0)) > 0) | (F.coalesce("gate_status", F.lit("pass")) == "block")).alias("failed"),
    )
