"""Composable SQL fragments for the side-by-side check: the same tables and rules as plain SQL."""

from __future__ import annotations

import re

from modelgauge.plans import rulebook

_CTES: dict[str, str] = {}
#: Parts that several others read: computed once.
SHARED = {"x_findings", "x_resolved", "x_outcomes", "x_last", "x_simple", "x_composite", "x_rooms", "x_doors", "x_deltas", "x_evj", "x_inv", "x_keyed", "x_bridge", "x_metrics"}


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql.strip()


def build(body: str) -> str:
    """Prefix `body` with every CTE it needs, directly or through another CTE, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\bx_[a-z0-9_]+", text)):
            if word in _CTES and word not in needed:
                needed.add(word)
                visit(_CTES[word])

    visit(body)
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}(\n{s}\n)" for n, s in _CTES.items() if n in needed)
    circular = any(n in needed and re.search(rf"\b{n}\b", s) for n, s in _CTES.items())
    head = f"WITH {'RECURSIVE ' if circular else ''}{ctes}\n" if ctes else ""
    body = body.strip()
    if head and body.startswith("WITH "):
        body = f"SELECT * FROM (\n{body}\n)"
    return head + body


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def num(c: str) -> str:
    return f"(CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END)"


def pct(n: str, d: str) -> str:
    return f"(CASE WHEN {d} > 0 THEN CAST(floor(CAST({n} AS DOUBLE) / {d} * 100.0 + 0.5) AS BIGINT) END)"


def rng(lo: str, hi: str, unit: str) -> str:
    return f"(CASE WHEN {hi} IS NULL THEN '>= ' || {num(lo)} || ' {unit}' ELSE {num(lo)} || '-' || {num(hi)} || ' {unit}' END)"


def _req_rows() -> str:
    rows = []
    for spec in ("spec-a", "spec-b"):
        for r in rulebook.package(spec):
            s = r["source"] or {}
            frags = r["source_fragment_ids"]
            rows.append(
                "("
                + ", ".join(
                    [
                        lit(spec), lit(r["requirement_id"]), lit(r["title"]), lit(r["type"]), lit(r["severity"]), lit(r["pos"]),
                        lit(r["room_type"]), f"CAST({lit(r['min_value'])} AS DOUBLE)", f"CAST({lit(r['max_value'])} AS DOUBLE)",
                        lit(r["quantifier"]), lit(r["operator"]), lit(r["automation_status"]), lit(r["discipline"]),
                        lit(s.get("document")), lit(s.get("section")), lit(s.get("revision")), lit(r["unit"]), lit(r["quantity_type"]),
                        "CAST(NULL AS VARCHAR[])" if frags is None else "[" + ", ".join(map(lit, frags)) + "]",
                    ]
                )
                + ")"
            )
    return ",\n".join(rows)


def _cond_rows() -> str:
    rows = []
    for spec in ("spec-a", "spec-b"):
        for r in rulebook.package(spec):
            conds = r["conditions"]
            if r["type"] in ("minimum_room_area", "minimum_door_width_for_room_type"):
                kind = "room_area_range" if r["type"] == "minimum_room_area" else "connected_door_width_range"
                conds = [{"type": kind, "min": r["min_value"], "max": r["max_value"], "quantifier": r["quantifier"]}]
            for i, c in enumerate(conds or []):
                rows.append(
                    f"({lit(spec)}, {lit(r['requirement_id'])}, {i}, {lit(c['type'])}, CAST({lit(c['min'])} AS DOUBLE),"
                    f" CAST({lit(c['max'])} AS DOUBLE), {lit(c['quantifier'] or 'all')})"
                )
    return ",\n".join(rows)


cte(
    "x_req",
    "SELECT * FROM (VALUES " + _req_rows() + ") AS t(spec_id, requirement_id, title, type, severity, pos, room_type, min_value,"
    " max_value, quantifier, operator, automation_status, discipline, src_document, src_section, src_revision, unit,"
    " quantity_type, fragment_ids)",
)
cte("x_cond", "SELECT * FROM (VALUES " + _cond_rows() + ") AS t(spec_id, requirement_id, i, ctype, lo, hi, q)")
cte(
    "x_models",
    "SELECT 'mdl-' || c_custkey AS model_id, 'prj-' || CAST(floor(c_custkey / 10.0) AS BIGINT) AS project_id, c_name AS name FROM customer",
)
cte(
    "x_levels",
    "SELECT 'mdl-' || c_custkey AS model_id, 'lvl-' || i AS level_id, 'Level ' || i AS name, i AS pos FROM customer, range(3) t(i)",
)
cte(
    "x_runs",
    "SELECT 'run-' || v || '-' || model_id AS run_id, project_id, model_id, 'spec-' || v AS spec_id, v FROM x_models, (VALUES ('a'), ('b')) t(v)",
)
cte("x_links", "SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL")
_TYPE = "CASE o_orderpriority " + " ".join(
    f"WHEN '{p}' THEN '{t}'" for p, t in {"1-URGENT": "stockroom", "2-HIGH": "office", "3-MEDIUM": "meeting_room", "4-NOT SPECIFIED": "corridor"}.items()
) + " ELSE 'unknown' END"
cte(
    "x_rooms",
    f"""
SELECT v, o_orderkey, o_custkey, 'mdl-' || o_custkey AS model_id, 'rm-' || o_orderkey AS room_id, 'Room ' || o_orderkey AS name,
  CASE WHEN o_orderkey % 19 = 0 THEN 'lvl-x' ELSE 'lvl-' || (o_orderkey % 3) END AS level_id,
  {_TYPE} AS room_type,
  CASE WHEN o_orderkey % 11 <> 0 THEN
    CASE WHEN v = 'b' AND o_orderstatus = 'F' THEN floor(o_totalprice / 500 + 120) / 10 ELSE floor(o_totalprice / 500) / 10 END
  END AS area_sqm,
  o_orderkey % 13 <> 0 AS has_list, o_orderkey AS pos
FROM orders, (VALUES ('a'), ('b')) t(v) WHERE v = 'a' OR month(o_orderdate) <> 3
""",
)
cte(
    "x_bridge",
    """
SELECT 'mdl-' || o_custkey AS model_id, o_custkey, o_orderkey, l_partkey, 'rm-' || o_orderkey AS room_id,
  'dr-' || l_partkey AS door_id, first_line FROM x_links JOIN orders ON l_orderkey = o_orderkey
""",
)
cte(
    "x_doors",
    """
SELECT d.model_id, 'dr-' || p_partkey AS door_id, 'Door ' || p_partkey AS name,
  CASE WHEN p_partkey % 29 = 0 THEN 'lvl-y' ELSE 'lvl-' || (p_partkey % 3) END AS level_id,
  CASE WHEN p_partkey % 17 <> 0 THEN (p_size + 60) / 100.0 END::DOUBLE AS width_m, p_partkey AS pos
FROM (SELECT DISTINCT model_id, l_partkey FROM x_bridge) d JOIN part ON l_partkey = p_partkey WHERE p_partkey % 97 <> 0
""",
)
cte(
    "x_door_rooms",
    """
SELECT model_id, door_id, room_id FROM x_bridge WHERE l_partkey % 97 <> 0 AND (o_orderkey + l_partkey) % 31 <> 0
UNION ALL
SELECT DISTINCT model_id, door_id, 'rm-ghost-' || l_partkey FROM x_bridge WHERE l_partkey % 97 <> 0 AND l_partkey % 53 = 0
""",
)
# Doors seen from each room, resolved once; list order is (first line, part).
cte(
    "x_resolved",
    """
SELECT b.room_id, count(*) AS n_links,
  count(*) FILTER (WHERE d.door_id IS NOT NULL AND d.width_m IS NULL) AS n_unmeasured,
  min_by(b.door_id, (b.first_line, b.l_partkey)) FILTER (WHERE d.door_id IS NULL) AS unresolved_id,
  list(b.door_id ORDER BY b.first_line, b.l_partkey) AS link_ids,
  list(b.door_id ORDER BY b.first_line, b.l_partkey) FILTER (WHERE d.width_m IS NULL) AS unmeasured_ids,
  list({'id': b.door_id, 'w': d.width_m} ORDER BY b.first_line, b.l_partkey) FILTER (WHERE d.width_m IS NOT NULL) AS known
FROM x_bridge b LEFT JOIN x_doors d ON d.model_id = b.model_id AND d.door_id = b.door_id GROUP BY b.room_id
""",
)
_IN = "(k.w >= c.lo AND (c.hi IS NULL OR k.w <= c.hi))"
cte(
    "x_branch0",
    f"""
SELECT u.run_id, q.requirement_id, q.title, q.type, q.severity, q.operator, q.pos AS req_pos, c.i, c.ctype, c.lo, c.hi, c.q,
  r.room_id, r.name, r.area_sqm, r.pos AS element_pos, r.has_list, coalesce(s.n_links, 0) AS n_links,
  s.unresolved_id, s.link_ids, s.unmeasured_ids, s.known, coalesce(s.n_unmeasured, 0) AS n_unmeasured,
  coalesce(len(list_filter(s.known, lambda k: k.w >= c.lo AND (c.hi IS NULL OR k.w <= c.hi))), 0) AS n_pass,
  list_filter(s.known, lambda k: NOT (k.w >= c.lo AND (c.hi IS NULL OR k.w <= c.hi))) AS failing
FROM x_runs u JOIN x_req q ON q.spec_id = u.spec_id JOIN x_cond c ON c.spec_id = q.spec_id AND c.requirement_id = q.requirement_id
JOIN x_rooms r ON r.v = u.v AND r.model_id = u.model_id AND r.room_type = q.room_type
LEFT JOIN x_resolved s ON s.room_id = r.room_id
""",
)
cte(
    "x_branch1",
    f"""
SELECT *, CASE WHEN ctype = 'room_area_range' THEN
    CASE WHEN area_sqm IS NULL THEN 'a_unknown' WHEN area_sqm >= lo AND (hi IS NULL OR area_sqm <= hi) THEN 'a_pass' ELSE 'a_fail' END
  WHEN NOT has_list THEN 'no_list' WHEN n_links = 0 THEN 'empty' WHEN unresolved_id IS NOT NULL THEN 'unresolved'
  WHEN q = 'any' THEN CASE WHEN n_pass > 0 THEN 'pass' WHEN n_unmeasured = 0 THEN 'fail' ELSE 'unknown' END
  WHEN coalesce(len(failing), 0) > 0 THEN 'fail' WHEN n_unmeasured = 0 THEN 'pass' ELSE 'unknown' END AS c,
  {rng('lo', 'hi', 'sqm')} AS wanted_area, {rng('lo', 'hi', 'm')} AS wanted_width
FROM x_branch0
""",
)
_W = "list_transform({l}, lambda k: k.id || ':' || " + num("k.w") + ")"
cte(
    "x_branch",
    f"""
SELECT run_id, requirement_id, title, type, severity, operator, req_pos, i, room_id, name, element_pos,
  CASE WHEN c IN ('a_pass', 'pass') THEN 'pass' WHEN c IN ('a_fail', 'fail', 'empty') THEN 'fail' ELSE 'unknown' END AS status,
  CASE c WHEN 'a_unknown' THEN 'Cannot verify area for ' || name || '; area is missing.'
    WHEN 'a_pass' THEN name || ' area ' || {num('area_sqm')} || ' sqm satisfies ' || wanted_area || '.'
    WHEN 'a_fail' THEN name || ' area ' || {num('area_sqm')} || ' sqm violates ' || wanted_area || '.'
    WHEN 'no_list' THEN 'Cannot verify door widths for ' || name || '; door relationship data is missing.'
    WHEN 'empty' THEN name || ' has no connected doors; required minimum door width cannot be met.'
    WHEN 'unresolved' THEN 'Cannot verify ' || name || '; connected door ' || unresolved_id || ' is not present in model doors.'
    WHEN 'unknown' THEN 'Cannot verify whether ' || q || ' connected doors for ' || name || ' satisfy ' || wanted_width || '; one or more doors have missing width.'
    WHEN 'pass' THEN (CASE q WHEN 'any' THEN 'At least one' ELSE 'All' END) || ' connected doors for ' || name || ' satisfy ' || wanted_width || '.'
    ELSE (CASE q WHEN 'any' THEN 'No' ELSE 'Not all' END) || ' connected doors for ' || name || ' satisfy ' || wanted_width || '.' END AS summary,
  CASE WHEN c IN ('pass', 'fail') THEN [room_id] || link_ids WHEN c = 'unknown' THEN [room_id] || unmeasured_ids
    WHEN c = 'unresolved' THEN [room_id, unresolved_id] ELSE [room_id] END AS affected,
  CASE c WHEN 'a_unknown' THEN 'Area parameter is not available in normalized model data.'
    WHEN 'a_pass' THEN 'Room area was compared against deterministic threshold.' WHEN 'a_fail' THEN 'Room area was compared against deterministic threshold.'
    WHEN 'no_list' THEN 'Connected door identifiers are required but not available.' WHEN 'empty' THEN 'No connected door found for room.'
    WHEN 'unresolved' THEN 'Door id referenced by room cannot be resolved in door set.'
    WHEN 'unknown' THEN 'Door width parameter is missing for connected door.'
    WHEN 'pass' THEN (CASE q WHEN 'any' THEN 'At least one' ELSE 'All' END) || ' connected door widths meet the deterministic range.'
    ELSE (CASE q WHEN 'any' THEN 'No' ELSE 'Not all' END) || ' connected door widths meet the deterministic range.' END AS ev_message,
  CASE c WHEN 'a_pass' THEN {num('area_sqm')} WHEN 'a_fail' THEN {num('area_sqm')} WHEN 'empty' THEN '[]' WHEN 'unresolved' THEN unresolved_id
    WHEN 'unknown' THEN array_to_string(unmeasured_ids, ', ') WHEN 'pass' THEN array_to_string({_W.format(l='known')}, ', ')
    WHEN 'fail' THEN array_to_string({_W.format(l='failing')}, ', ') END AS ev_observed,
  CASE c WHEN 'a_unknown' THEN '>= ' || {num('lo')} WHEN 'a_pass' THEN wanted_area WHEN 'a_fail' THEN wanted_area
    WHEN 'no_list' THEN 'Array of door ids' WHEN 'empty' THEN 'At least one door width >= ' || {num('lo')} || 'm'
    WHEN 'unresolved' THEN 'Door id existing in model.doors' ELSE q || ' connected doors within ' || wanted_width END AS ev_expected,
  CASE WHEN c LIKE 'a_%' THEN 'room.areaSqm' WHEN c IN ('no_list', 'empty', 'unresolved') THEN 'room.connectedDoorIds' ELSE 'door.widthM' END AS ev_field
FROM x_branch1
""",
)
_EV = "coalesce(ev_message, '') || '~' || coalesce(ev_observed, '') || '~' || coalesce(ev_expected, '') || '~' || ev_field"
cte(
    "x_simple",
    f"""
SELECT run_id, requirement_id, CASE type WHEN 'minimum_room_area' THEN 'MinimumRoomAreaRule' ELSE 'MinimumDoorWidthForRoomTypeRule' END AS rule_id,
  title AS requirement_title, 'room' AS element_type, status, severity, summary, affected, {_EV} AS evidence_text, 1 AS n_evidence, req_pos, element_pos
FROM x_branch WHERE type <> 'composite_room_rule'
""",
)
cte(
    "x_comp0",
    f"""
SELECT run_id, requirement_id, any_value(title) AS title, any_value(severity) AS severity, any_value(operator) AS operator,
  any_value(name) AS name, req_pos, element_pos, list(status ORDER BY i) AS statuses, count(*) AS n_evidence,
  list(affected ORDER BY i) AS branch_ids,
  array_to_string(list('Condition ' || (i + 1) || ' (' || status || '): ' || {_EV} ORDER BY i), '^') AS evidence_text,
  CASE WHEN any_value(operator) = 'and' THEN CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'unknown' END
    ELSE CASE WHEN bool_or(status = 'pass') THEN 'pass' WHEN bool_and(status = 'fail') THEN 'fail' ELSE 'unknown' END END AS status
FROM x_branch WHERE type = 'composite_room_rule' GROUP BY run_id, requirement_id, req_pos, room_id, element_pos
""",
)
cte(
    "x_composite",
    """
SELECT run_id, requirement_id, 'CompositeRoomRule' AS rule_id, title AS requirement_title, 'room' AS element_type, status, severity,
  name || ': ' || upper(operator) || ' composite rule is ' || status || '; branch results: ' || array_to_string(statuses, ', ') || '.' AS summary,
  list_reduce(flatten(branch_ids), lambda acc, x: CASE WHEN contains('~' || acc || '~', '~' || x || '~') THEN acc ELSE acc || '~' || x END) AS affected_text,
  evidence_text, n_evidence, req_pos, element_pos
FROM x_comp0
""",
)
cte(
    "x_has_door",
    """
SELECT run_id, requirement_id, 'RoomHasConnectedDoorRule' AS rule_id, title AS requirement_title, 'room' AS element_type,
  CASE WHEN NOT has_list THEN 'unknown' WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status, severity,
  CASE WHEN NOT has_list THEN 'Cannot verify connected doors for ' || name || '; relationship data is missing.'
    WHEN n > 0 THEN name || ' has at least one connected door.' ELSE name || ' has no connected doors.' END AS summary,
  [room_id] AS affected,
  CASE WHEN NOT has_list THEN 'Connected door relationship is missing in normalized data.~~At least one connected door id~room.connectedDoorIds'
    ELSE 'Room-to-door relationships were checked for minimum connectivity.~' || n || '~>= 1~room.connectedDoorIds' END AS evidence_text,
  1 AS n_evidence, req_pos, element_pos
FROM (SELECT u.run_id, q.requirement_id, q.title, q.severity, q.pos AS req_pos, r.name, r.room_id, r.has_list, r.pos AS element_pos, coalesce(s.n_links, 0) AS n
  FROM x_runs u JOIN x_req q ON q.spec_id = u.spec_id AND q.type = 'room_has_connected_door'
  JOIN x_rooms r ON r.v = u.v AND r.model_id = u.model_id LEFT JOIN x_resolved s ON s.room_id = r.room_id)
""",
)
cte(
    "x_na",
    """
SELECT u.run_id, q.requirement_id, q.type || ':target-set' AS rule_id, q.title AS requirement_title, 'model' AS element_type, 'not_applicable' AS status, q.severity,
  'Requirement is not applicable because the model contains no ' || q.room_type || ' rooms.' AS summary, CAST([] AS VARCHAR[]) AS affected,
  'No elements matched the requirement target selector.~0~' || q.room_type || '~room.roomType' AS evidence_text, 1 AS n_evidence, q.pos AS req_pos, 0 AS element_pos
FROM x_runs u JOIN x_req q ON q.spec_id = u.spec_id WHERE q.room_type IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM x_rooms r WHERE r.v = u.v AND r.model_id = u.model_id AND r.room_type = q.room_type)
""",
)
cte(
    "x_textual",
    """
SELECT u.run_id, q.requirement_id, 'TextualRequirement' AS rule_id, q.title AS requirement_title, 'model' AS element_type,
  CASE WHEN q.automation_status = 'informational' THEN 'not_applicable' ELSE 'unknown' END AS status, q.severity,
  CASE WHEN q.automation_status = 'informational' THEN 'Informational requirement is preserved for traceability and is not evaluated.'
    ELSE 'Requirement is valid but needs deterministic rule configuration before it can be evaluated.' END AS summary, CAST([] AS VARCHAR[]) AS affected,
  CASE WHEN q.automation_status = 'informational' THEN 'The imported row was classified as informational.'
    ELSE 'No executable rule configuration is attached to this requirement.' END || '~' || q.automation_status || '~ready_for_validation~requirement.automationStatus' AS evidence_text,
  1 AS n_evidence, q.pos AS req_pos, 0 AS element_pos
FROM x_runs u JOIN x_req q ON q.spec_id = u.spec_id WHERE q.type = 'textual_requirement'
""",
)
_F = "run_id, requirement_id, rule_id, requirement_title, element_type, status, severity, summary, array_to_string(affected, '~') AS affected_text, evidence_text, n_evidence, req_pos, element_pos"
cte(
    "x_findings",
    f"""
SELECT {_F} FROM x_simple UNION ALL SELECT {_F.replace("array_to_string(affected, '~') AS affected_text", 'affected_text')} FROM x_composite
UNION ALL SELECT {_F} FROM x_has_door UNION ALL SELECT {_F} FROM x_na UNION ALL SELECT {_F} FROM x_textual
""",
)
cte("x_run_req", "SELECT u.run_id, u.model_id, u.project_id, u.v, q.* FROM x_runs u JOIN x_req q ON q.spec_id = u.spec_id")
cte(
    "x_outcomes",
    """
SELECT r.run_id, r.requirement_id, r.title, r.severity, r.type, r.pos AS req_pos, count(f.status) AS n_results,
  CASE WHEN count(f.status) = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE f.status = 'fail') > 0 THEN 'violation'
    WHEN count(*) FILTER (WHERE f.status = 'unknown') > 0 THEN 'unknown'
    WHEN count(*) FILTER (WHERE f.status = 'not_applicable') = count(f.status) THEN 'not_applicable'
    WHEN count(*) FILTER (WHERE f.status = 'pass') = count(f.status) THEN 'compliant' ELSE 'unknown' END AS outcome
FROM x_run_req r LEFT JOIN x_findings f ON f.run_id = r.run_id AND f.requirement_id = r.requirement_id GROUP BY ALL
""",
)
cte(
    "x_metrics0",
    """
SELECT run_id, count(*) AS requirement_count, count(*) FILTER (WHERE outcome = 'compliant') AS compliant,
  count(*) FILTER (WHERE outcome = 'violation') AS violated, count(*) FILTER (WHERE outcome = 'unknown') AS unknown,
  count(*) FILTER (WHERE outcome = 'not_applicable') AS not_applicable,
  count(*) FILTER (WHERE outcome = 'violation' AND severity = 'critical') AS critical_failures
FROM x_outcomes GROUP BY run_id
""",
)
cte(
    "x_metrics",
    f"""
SELECT *, requirement_count - not_applicable AS applicable, compliant + violated AS determined,
  {pct('compliant', '(compliant + violated)')} AS pass_rate, {pct('(compliant + violated)', '(requirement_count - not_applicable)')} AS coverage
FROM x_metrics0
""",
)
