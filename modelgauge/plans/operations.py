"""Registered queries: exports, reviews, audit, usage, plans, jobs, quota and keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.functions.jsontext import with_fingerprint
from modelgauge.operators import access as A
from modelgauge.operators import exports as X
from modelgauge.operators import lifecycle as L
from modelgauge.operators import metrics as M
from modelgauge.operators import quota
from modelgauge.operators.retention import Reference, cascade
from modelgauge.plans.constraints import evidence, part_requirements
from modelgauge.plans.oracle import cte, lit, num
from modelgauge.plans.registry import query
from modelgauge.plans.validation import findings, run_req, run_table
from modelgauge.sources import testbed as tb

NOW = "timestamp'2024-01-31 00:00:00'"
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _js(x: str) -> str:
    return f"'\"' || replace({x}, '\"', '\\\"') || '\"'"


# One finding's evidence JSON from its rendered text (message~observed~expected~field, items by ^).
cte(
    "x_evj",
    f"""SELECT run_id, requirement_id, rule_id, status, severity, element_type, affected_text, summary, req_pos, element_pos, requirement_title,
  list_transform(string_split(evidence_text, '^'), lambda e: string_split(e, '~')) AS items FROM x_findings WHERE run_id LIKE 'run-a-%'""",
)
_ITEM = (
    "'{\"message\":\"' || e[1] || '\",\"field\":\"' || e[4] || '\",\"observed\":' || CASE WHEN e[2] = '' AND e[4] <> 'door.widthM' THEN 'null'"
    " WHEN e[4] IN ('room.areaSqm', 'room.roomType') OR (e[4] = 'room.connectedDoorIds' AND e[3] = '>= 1') THEN e[2] ELSE '\"' || e[2] || '\"' END"
    " || ',\"expected\":\"' || e[3] || '\"}'"
)
_Q = lambda c: f"CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@query(
    "findings_csv",
    f"""SELECT run_id, req_pos::BIGINT AS req_pos, element_pos::BIGINT AS element_pos, run_id || ',' || requirement_id || ',' || rule_id || ',' || status || ',' || severity || ',' || element_type || ',' ||
  replace(affected_text, '~', ';') || ',' || {_Q('summary')} || ',' || {_Q('j')} AS line FROM (SELECT *, '[' || array_to_string(list_transform(items, lambda e: {_ITEM}), ',') || ']' AS j FROM x_evj)""",
)
def _csv(spark, d):
    return X.findings_csv(findings(spark, d)).withColumn("req_pos", F.col("req_pos").cast("bigint"))


_LEVEL = "CASE WHEN status = 'unknown' THEN 'note' WHEN severity = 'critical' THEN 'error' WHEN severity = 'warning' THEN 'warning' ELSE 'note' END"


@query(
    "findings_sarif",
    f"""SELECT f.run_id, f.requirement_id, f.rule_id, {_LEVEL.replace('severity', 'f.severity').replace('status', 'f.status')} AS level, f.summary AS message,
  CASE WHEN f.affected_text = '' THEN '' ELSE array_to_string(list_transform(string_split(f.affected_text, '~'), lambda i: i || '=' || f.element_type || ':' || i), ' ') END AS locations,
  f.n_evidence::BIGINT AS n_evidence, r.src_document AS source_document, r.src_section AS source_section, r.src_revision AS source_revision
FROM x_findings f JOIN x_run_req r USING (run_id, requirement_id) WHERE f.status IN ('fail', 'unknown') AND f.run_id LIKE 'run-a-%'""",
)
def _sarif(spark, d):
    locations = "array_join(transform(logical_locations, l -> concat(l.name, '=', l.fullyQualifiedName)), ' ') as locations"
    return X.findings_sarif(findings(spark, d), run_req(spark, d)).selectExpr(
        "run_id", "requirement_id", "rule_id", "level", "message", locations, "cast(size(evidence) as bigint) as n_evidence", "source_document", "source_section", "source_revision"
    )


@query(
    "sarif_rules",
    """SELECT l.run_id, l.rule_id, r.title AS name, l.summary AS full_description, l.requirement_id, l.severity, r.src_document AS source_document, l.first_req_pos::BIGINT AS first_req_pos, l.first_element_pos::BIGINT AS first_element_pos FROM (
  SELECT *, first_value(req_pos) OVER w AS first_req_pos, first_value(element_pos) OVER w AS first_element_pos, row_number() OVER (PARTITION BY run_id, rule_id ORDER BY req_pos DESC, element_pos DESC) AS rn
  FROM x_findings WHERE status IN ('fail', 'unknown') AND run_id LIKE 'run-a-%' WINDOW w AS (PARTITION BY run_id, rule_id ORDER BY req_pos, element_pos)) l
JOIN x_run_req r USING (run_id, requirement_id) WHERE rn = 1""",
)
def _rules(spark, d):
    return X.sarif_rules(findings(spark, d), run_req(spark, d))


def package_names(spark):
    return spark.createDataFrame([("spec-a", "Building brief", "A"), ("spec-b", "Building brief", "B")], "spec_id string, name string, revision string")


_SHOWN = "CASE WHEN {v} IS NULL THEN '' WHEN quantity_type = 'length' AND unit = 'mm' THEN CAST(CAST({v} * 1000 AS BIGINT) AS VARCHAR) ELSE CAST(CAST({v} AS BIGINT) AS VARCHAR) END"
_CONDITION = """'{"type":"' || CASE WHEN i % 2 = 0 THEN 'room_area_range","minAreaSqm":' || i || CASE WHEN i = 3 THEN ',"maxAreaSqm":2' ELSE '' END
  ELSE 'connected_door_width_range","minDoorWidthM":' || i || CASE WHEN i = 3 THEN ',"maxDoorWidthM":2' ELSE '' END END || '}'"""


@query(
    "spec_to_flat",
    f"""SELECT spec_id, pos, requirement_id AS id, title, discipline, type, severity, coalesce(room_type, '') AS target_type, {_SHOWN.format(v='min_value')} AS minimum, {_SHOWN.format(v='max_value')} AS maximum,
  unit, quantity_type, CASE WHEN k % 2 = 0 THEN p_brand ELSE '' END AS source_document, CASE WHEN k % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS source_section, coalesce(quantifier, '') AS quantifier, coalesce(operator, '') AS operator,
  CASE WHEN type <> 'composite_room_rule' THEN '' ELSE '[' || array_to_string(list_transform(CASE WHEN zero_min THEN [1, 0] ELSE range(1, n_conditions + 1) END, lambda i: {_CONDITION}), ',') || ']' END AS conditions_json,
  'Package ' || spec_id AS specification_name, 'R1' AS specification_revision FROM x_preq2""",
)
def _spec_flat(spark, d):
    req = part_requirements(spark, d)
    names = req.selectExpr("spec_id", "concat('Package ', spec_id) as name", "'R1' as revision").distinct()
    return X.spec_to_flat(req, names).select(
        "spec_id", "pos", "id", "title", "discipline", "type", "severity", "target_type", "minimum", "maximum", "unit", "quantity_type",
        "source_document", "source_section", "quantifier", "operator", "conditions_json", "specification_name", "specification_revision",
    )


@query(
    "findings_sheet",
    """SELECT run_id, requirement_id, requirement_title AS title, rule_id, status, severity, element_type, replace(affected_text, '~', '; ') AS affected_element_ids, summary,
  array_to_string(list_transform(items, lambda e: e[1]), ' | ') AS evidence_messages FROM x_evj""",
)
def _sheet(spark, d):
    return X.findings_sheet(findings(spark, d), run_req(spark, d)).drop("req_pos", "element_pos")


cte("x_inv", """SELECT m.model_id, (SELECT count(*) FROM x_levels l WHERE l.model_id = m.model_id) AS levels,
  (SELECT count(*) FROM x_rooms r WHERE r.v = 'a' AND r.model_id = m.model_id) AS rooms, (SELECT count(*) FROM x_doors x WHERE x.model_id = m.model_id) AS doors FROM x_models m""")


@query(
    "report_lines",
    """SELECT run_id, 0 AS section, 0 AS pos1, 0 AS pos2, generate_subscripts(t, 1) - 1 AS line_no, unnest(t) AS text FROM (SELECT m.run_id, ['# Building Compliance Report',
  'Requirement Pass Rate: ' || coalesce(pass_rate || '%', 'n/a') || ' (' || compliant || ' Compliant / ' || violated || ' Violated among determined requirements)',
  'Evaluation Coverage: ' || coalesce(coverage || '%', 'n/a') || ' (' || determined || ' Determined / ' || applicable || ' Applicable)', 'Critical Failed Requirements: ' || critical_failures,
  'Not Applicable Requirements: ' || not_applicable, '## Overview Metrics', '- Total Rooms Inspected: ' || i.rooms, '- Total Access Doors Inspected: ' || i.doors, '- Spatial Storeys (Levels): ' || i.levels,
  '- Total Evaluated Rule Specifications: ' || requirement_count, '- Specification: Building brief', '- Specification Revision: A'] AS t FROM x_metrics m JOIN x_runs u USING (run_id) JOIN x_inv i USING (model_id) WHERE u.v = 'a')
UNION ALL SELECT o.run_id, 1, o.req_pos, 0, 0, row_number() OVER (PARTITION BY o.run_id ORDER BY o.req_pos) || '. [' || replace(upper(outcome), '_', ' ') || '] **' || o.title || '** (Severity: ' || o.severity || ')' ||
  CASE WHEN r.src_document IS NULL THEN '' ELSE ' — Source: ' || r.src_document || ', ' || r.src_section || ', rev. ' || r.src_revision END FROM x_outcomes o JOIN x_run_req r USING (run_id, requirement_id) WHERE o.run_id LIKE 'run-a-%'
UNION ALL SELECT run_id, 2, req_pos, element_pos, generate_subscripts(t, 1) - 1, unnest(t) FROM (SELECT run_id, req_pos, element_pos, ['### [' || upper(status) || '] ' || requirement_title, '- Requirement ID: `' || requirement_id || '`',
  '- Severity Level: **' || severity || '**', '- Element Type: **' || element_type || '**', '- Affected Elements: ' || CASE WHEN affected_text = '' THEN 'None' ELSE replace(affected_text, '~', ', ') END, '- Summary Record: ' || summary,
  '- Structured Evidence Logs:'] || list_transform(items, lambda e: '  - *' || e[1] || '* (Field: ' || e[4] || ' | Observed: ' || CASE WHEN e[2] = '' AND e[4] <> 'door.widthM' THEN 'null' ELSE e[2] END || ' | Expected: ' || e[3] || ')') AS t FROM x_evj)""",
)
def _report(spark, d):
    f, req = findings(spark, d), run_req(spark, d)
    out = M.outcomes(req, f)
    inv = M.inventory(tb.models(spark, d), tb.levels(spark, d), tb.room_facts(spark, d), tb.doors(spark, d))
    return X.report_lines(run_table(spark, d), M.metrics(out), inv, package_names(spark), out, req, f)


@query(
    "run_summary",
    """WITH c AS (SELECT run_id, count(*) FILTER (WHERE status = 'pass') AS p, count(*) FILTER (WHERE status = 'fail') AS f, count(*) FILTER (WHERE status = 'unknown') AS u,
  count(*) FILTER (WHERE status = 'fail' AND severity = 'critical') AS k FROM x_findings WHERE run_id LIKE 'run-a-%' GROUP BY 1)
SELECT run_id, 1 AS line_no, '**Project status summary**' AS text FROM c UNION ALL SELECT run_id, 2, '- Results: ' || p || ' pass, ' || f || ' fail, ' || u || ' unknown.' FROM c
UNION ALL SELECT run_id, 3, CASE WHEN k = 0 THEN '- Critical failures: none in current deterministic results.' ELSE '- Critical failures:' END FROM c UNION ALL SELECT run_id, 5, '- Unknown follow-up:' FROM c WHERE u > 0
UNION ALL SELECT run_id, 7, '- Unknowns remain unknown until missing parameters or relationships are provided.' FROM c WHERE u > 0 UNION ALL SELECT run_id, 8, '- I cannot determine that from the available model evidence.' FROM c
UNION ALL SELECT run_id, 9, '- Follow-up priority: resolve critical failures first, then close unknown data gaps.' FROM c
UNION ALL SELECT run_id, 4, requirement_id || ' (' || replace(affected_text, '~', ', ') || ')' FROM x_findings WHERE status = 'fail' AND severity = 'critical' AND run_id LIKE 'run-a-%'
UNION ALL SELECT DISTINCT run_id, 6, unnest(string_split(affected_text, '~')) FROM x_findings WHERE status = 'unknown' AND affected_text <> '' AND run_id LIKE 'run-a-%'""".replace("WITH c AS", "SELECT * FROM (WITH c AS") + ")",
)
def _summary(spark, d):
    return X.run_summary(findings(spark, d), "Project Manager", "Which rooms are Missing an area?").select("run_id", "line_no", "text")


cte("x_members", "SELECT DISTINCT 'prj-' || (o_custkey // 10) AS project_id, 'usr-' || (o_orderkey % 150) AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'editor' ELSE 'viewer' END AS role FROM orders")


@query(
    "export_owner",
    """SELECT owner_id AS user_id, 'project' AS kind, project_id, CASE WHEN baseline_run_id IS NULL THEN '' ELSE baseline_run_id END AS detail FROM x_projects
UNION ALL SELECT p.owner_id, 'run', p.project_id, u.run_id FROM x_runs u JOIN x_projects p USING (project_id) WHERE u.v = 'a'
UNION ALL SELECT p.owner_id, 'review', p.project_id, r.decision_id FROM x_reviews r JOIN x_runs u USING (run_id) JOIN x_projects p USING (project_id)
UNION ALL SELECT p.owner_id, 'evidence', p.project_id, e.id FROM x_evidence e JOIN x_runs u USING (run_id) JOIN x_projects p USING (project_id)
UNION ALL SELECT p.owner_id, 'package', p.project_id, 'pkg-' || k.p_partkey FROM part k JOIN x_projects p ON p.project_id = 'prj-' || k.p_partkey % 150 UNION ALL SELECT user_id, 'membership', project_id, role FROM x_members""",
)
def _owner(spark, d):
    runs = tb.runs(spark, d)
    keys = runs.select("run_id", "project_id")
    tables = {
        "run": runs, "review": tb.reviews_log(spark, d).join(keys, "run_id"), "evidence": evidence(spark, d).join(keys, "run_id"),
        "package": tb.table(spark, d, "part").selectExpr("concat('pkg-', p_partkey) as id", "concat('prj-', p_partkey % 150) as project_id", "p_name as name"),
    }
    out = X.export_owner(tb.projects(spark, d).select("project_id", "owner_id", "baseline_run_id"), tables, members(spark, d))
    detail = """coalesce(get_json_object(record, case kind when 'project' then '$.baseline_run_id' when 'run' then '$.run_id'
        when 'review' then '$.decision_id' when 'membership' then '$.role' else '$.id' end), '') as detail"""
    return out.selectExpr("user_id", "kind", "project_id", detail)


# ---- reviews, intake, access ----------------------------------------------------------------


@query("current_reviews", "SELECT run_id, requirement_id, decision_id, status, reviewer_id FROM x_current")
def _current(spark, d):
    return A.current_reviews(tb.reviews_log(spark, d)).select("run_id", "requirement_id", "decision_id", "status", "reviewer_id")


@query(
    "review_history",
    """SELECT run_id, requirement_id, decision_id, status, lead(decision_id) OVER w AS superseded_by, CAST(epoch_us(lead(decided_at) OVER w) AS BIGINT) AS superseded_us FROM x_reviews WINDOW w AS (PARTITION BY run_id, requirement_id ORDER BY decided_at, decision_id)""",
)
def _history(spark, d):
    return A.review_history(tb.reviews_log(spark, d)).selectExpr(
        "run_id", "requirement_id", "decision_id", "status", "superseded_by", "unix_micros(superseded_at) as superseded_us"
    )


@query(
    "normalize_waivers",
    """SELECT decision_id, status, CASE WHEN status = 'waived' THEN coalesce(waiver_reason, 'Legacy waiver — reason not recorded') END AS waiver_reason, status = 'waived' AND waiver_expires_at IS NOT NULL AS expires FROM x_reviews""",
)
def _waivers(spark, d):
    return A.normalize_waivers(tb.reviews_log(spark, d)).selectExpr("decision_id", "status", "waiver_reason", "waiver_expires_at is not null as expires")


_ARRIVALS = "SELECT l_orderkey, l_linenumber, 'prj-' || (l_suppkey % 20) AS project_id, 'key-' || (l_orderkey % 1000) AS idempotency_key, 'fp-' || (l_orderkey % 3000) || l_returnflag AS input_fingerprint, l_shipdate, l_partkey, l_linestatus FROM lineitem"
_ARR = (
    "l_orderkey", "l_linenumber", "concat('prj-', l_suppkey % 20) as project_id", "concat('key-', l_orderkey % 1000) as idempotency_key",
    "concat('fp-', l_orderkey % 3000, l_returnflag) as input_fingerprint", "l_shipdate", "l_partkey", "l_linestatus",
)


def _intake_frames(spark, d):
    a = tb.table(spark, d, "lineitem").selectExpr(*_ARR)
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "project_id", "idempotency_key", "input_fingerprint", "l_shipdate"]
    return a.where("l_linestatus = 'O'").select(*cols), a.where("l_linestatus = 'F'").select(*cols)


@query(
    "classify_intake",
    f"""WITH a AS ({_ARRIVALS}) SELECT n.project_id, n.idempotency_key, n.input_fingerprint, CASE WHEN k.fp IS NULL THEN 'new' WHEN k.fp = n.input_fingerprint THEN 'replay' ELSE 'conflict' END AS intake, count(*) AS n
FROM a n LEFT JOIN (SELECT project_id, idempotency_key, min(input_fingerprint) AS fp FROM a WHERE l_linestatus = 'F' GROUP BY 1, 2) k USING (project_id, idempotency_key) WHERE n.l_linestatus = 'O' GROUP BY ALL""",
)
def _intake(spark, d):
    new, old = _intake_frames(spark, d)
    return A.classify_intake(new, old).groupBy("project_id", "idempotency_key", "input_fingerprint", "intake").agg(F.count(F.lit(1)).alias("n"))


@query(
    "append_idempotent",
    f"""WITH a AS ({_ARRIVALS}) SELECT project_id, idempotency_key, l_orderkey, l_linenumber, l_partkey FROM a WHERE l_linestatus = 'O' AND (project_id, idempotency_key) NOT IN (SELECT (project_id, idempotency_key) FROM a WHERE l_linestatus = 'F')
QUALIFY row_number() OVER (PARTITION BY project_id, idempotency_key ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) = 1""",
)
def _append(spark, d):
    new, old = _intake_frames(spark, d)
    keys = ["project_id", "idempotency_key"]
    return A.append_idempotent(new, old, keys, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]).select(*keys, "l_orderkey", "l_linenumber", "l_partkey")


def members(spark, d):
    return tb.table(spark, d, "orders").selectExpr(
        "concat('prj-', floor(o_custkey / 10)) as project_id", "concat('usr-', o_orderkey % 150) as user_id", "if(o_orderstatus = 'F', 'editor', 'viewer') as role"
    ).distinct()


cte(
    "x_roles",
    """SELECT user_id, project_id, min_by(role, k) AS role FROM (SELECT owner_id AS user_id, project_id, 'owner' AS role, '0' AS k FROM x_projects WHERE deleted_at IS NULL
UNION ALL SELECT m.user_id, m.project_id, m.role, '1' || m.role FROM x_members m JOIN x_projects p USING (project_id) WHERE p.deleted_at IS NULL) GROUP BY 1, 2""",
)


@query("visible_projects", "SELECT * FROM x_roles")
def _visible(spark, d):
    return A.visible_projects(tb.projects(spark, d), members(spark, d))


@query("editable_projects", "SELECT * FROM x_roles WHERE role IN ('owner', 'editor')")
def _editable(spark, d):
    return A.editable_projects(tb.projects(spark, d), members(spark, d))


#: The tables that hang on projects, and what each row refers to.
REFERENCES = (
    Reference("run", ("project_id",), "project", ("project_id",)), Reference("package", ("project_id",), "project", ("project_id",)), Reference("member", ("project_id",), "project", ("project_id",)),
    Reference("webhook", ("project_id",), "project", ("project_id",)), Reference("review", ("run_id",), "run", ("id",)), Reference("evidence", ("run_id",), "run", ("id",)), Reference("job", ("run_id",), "run", ("id",)),
    Reference("delivery", ("webhook_id",), "webhook", ("id",)),
)

cte(
    "x_gone",
    f"SELECT project_id FROM x_projects WHERE deleted_at < {_NOW} - INTERVAL 30 DAY",
)


@query(
    "purge_candidates",
    """WITH r AS (SELECT run_id FROM x_runs JOIN x_gone USING (project_id) WHERE v = 'a')
SELECT 'project' AS kind, project_id AS id FROM x_gone UNION ALL SELECT 'run', run_id FROM r UNION ALL SELECT 'review', decision_id FROM x_reviews JOIN r USING (run_id) UNION ALL SELECT 'evidence', id FROM x_evidence JOIN r USING (run_id)
UNION ALL SELECT 'package', 'pkg-' || p_partkey FROM part JOIN x_gone ON project_id = 'prj-' || p_partkey % 150 UNION ALL SELECT 'member', project_id || '/' || user_id || '/' || role FROM x_members JOIN x_gone USING (project_id)
UNION ALL SELECT DISTINCT 'job', 'job-' || l_orderkey || '-' || l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN r ON run_id = 'run-a-mdl-' || o_custkey
UNION ALL SELECT 'webhook', 'whk-' || c_custkey FROM customer JOIN x_gone ON project_id = 'prj-' || c_custkey % 150
UNION ALL SELECT 'delivery', 'dlv-' || event_id FROM events JOIN customer ON c_custkey = event_id % 1000 + 1 JOIN x_gone ON project_id = 'prj-' || c_custkey % 150""".join(("SELECT * FROM (", ")")),
)
def _purge(spark, d):
    """Projects deleted more than 30 days ago, with everything that hangs on them."""
    projects = tb.projects(spark, d)
    orders = tb.table(spark, d, "orders").selectExpr("o_orderkey as l_orderkey", "concat('run-a-mdl-', o_custkey) as run_id")
    tables = {
        "project": projects.withColumn("id", F.col("project_id")),
        "run": tb.runs(spark, d).withColumn("id", F.col("run_id")),
        "review": tb.reviews_log(spark, d).withColumn("id", F.col("decision_id")),
        "evidence": evidence(spark, d),
        "package": tb.table(spark, d, "part").selectExpr("concat('pkg-', p_partkey) as id", "concat('prj-', p_partkey % 150) as project_id"),
        "member": members(spark, d).withColumn("id", F.concat_ws("/", "project_id", "user_id", "role")),
        "job": tb.table(spark, d, "lineitem").join(orders, "l_orderkey").selectExpr("concat('job-', l_orderkey, '-', l_linenumber) as id", "run_id"),
        "webhook": tb.table(spark, d, "customer").selectExpr("concat('whk-', c_custkey) as id", "concat('prj-', c_custkey % 150) as project_id"),
        "delivery": tb.table(spark, d, "events").selectExpr("concat('dlv-', event_id) as id", "concat('whk-', event_id % 1000 + 1) as webhook_id"),
    }
    gone = A.purge_candidates(projects, 30, F.expr(NOW)).select(F.col("project_id").alias("id"))
    found = cascade(tables, dict.fromkeys(tables, ("id",)), REFERENCES, {"project": gone})
    return reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("kind"), "id") for kind, df in found.items()))


@query(
    "latest_per_project",
    """SELECT 'prj-' || (o_custkey // 10) AS project_id, o_orderkey, CAST(epoch_us(o_orderdate) AS BIGINT) AS at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderdate DESC, o_orderkey DESC) <= 50""",
)
def _latest(spark, d):
    o = tb.table(spark, d, "orders").selectExpr("concat('prj-', floor(o_custkey / 10)) as project_id", "o_orderkey", "unix_micros(cast(o_orderdate as timestamp)) as at")
    return A.latest_per_project(o, [F.col("at").desc(), F.col("o_orderkey").desc()], 50)


@query(
    "upsert_reviews",
    """WITH inc AS (SELECT run_id, requirement_id, decision_id, status FROM x_reviews WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY run_id, requirement_id ORDER BY event_id DESC) = 1),
  old AS (SELECT run_id, requirement_id, decision_id, status FROM x_reviews WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY run_id, requirement_id ORDER BY event_id DESC) = 1)
SELECT * FROM inc UNION ALL SELECT * FROM old WHERE (run_id, requirement_id) NOT IN (SELECT (run_id, requirement_id) FROM inc)""",
)
def _upsert(spark, d):
    log = tb.reviews_log(spark, d).selectExpr("run_id", "requirement_id", "decision_id", "status", "cast(substring(decision_id, 5) as bigint) as ord")
    keys = ["run_id", "requirement_id"]
    old = A.latest(log.where("ord % 3 <> 0"), keys, [F.col("ord")]).drop("ord")
    return A.upsert(old, log.where("ord % 3 = 0"), keys, "ord")


@query(
    "insert_missing_accounts",
    """WITH old AS (SELECT DISTINCT 'usr-' || user_id AS user_id, 'professional' AS plan FROM events WHERE user_id % 4 = 0), inc AS (SELECT 'usr-' || user_id AS user_id, ['starter', 'enterprise'][min(event_id) % 2 + 1] AS plan FROM events GROUP BY 1)
SELECT * FROM old UNION ALL SELECT * FROM inc WHERE user_id NOT IN (SELECT user_id FROM old)""",
)
def _insert(spark, d):
    e = tb.table(spark, d, "events")
    old = e.where("user_id % 4 = 0").selectExpr("concat('usr-', user_id) as user_id", "'professional' as plan").distinct()
    inc = e.selectExpr("concat('usr-', user_id) as user_id", "if(event_id % 2 = 0, 'starter', 'enterprise') as plan", "event_id as ord")
    return A.insert_missing(old, inc, ["user_id"], "ord")


# ---- fingerprints, hashes, audit ------------------------------------------------------------


@query(
    "canonical_fingerprint",
    f"""SELECT room_id, j AS canonical_json, sha256(j) AS fingerprint FROM (SELECT room_id, '{{' || CASE WHEN area_sqm IS NULL THEN '' ELSE '"areaSqm":' || {num('area_sqm')} || ',' END ||
  '"id":"' || room_id || '","position":{{"level":"' || level_id || '","order":' || pos || '}},"tags":["' || room_type || '","' || name || '"]}}' AS j FROM x_rooms WHERE v = 'a')""",
)
def _fingerprint(spark, d):
    doc = tb.room_facts(spark, d).selectExpr(
        "room_id", "room_id as id", "area_sqm as areaSqm", "array(room_type, name) as tags", "struct(pos as `order`, level_id as level) as position"
    )
    return with_fingerprint(doc, ["id", "areaSqm", "tags", "position"]).select("room_id", "canonical_json", "fingerprint")


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def _hash(spark, d):
    return L.checksums(tb.table(spark, d, "documents").selectExpr("doc_id as bundle_id", "source as path", "text as content")).selectExpr("bundle_id as doc_id", "sha256", "bytes")


@query(
    "engine_notes",
    """SELECT run_id, rule_id, finding_key, title, technical_note, count(*) AS n FROM (SELECT run_id, rule_id, requirement_id || '|' || rule_id || '|' || ids AS finding_key, 'Engine evidence ' || i AS title,
  e[1] || ' · field=' || e[4] || CASE WHEN e[2] = '' AND e[4] <> 'door.widthM' THEN '' ELSE ' · observed=' || e[2] END || ' · expected=' || e[3] AS technical_note
  FROM (SELECT *, CASE WHEN affected_text = '' THEN '' ELSE array_to_string(list_sort(string_split(affected_text, '~')), ',') END AS ids, generate_subscripts(items, 1) AS i, unnest(items) AS e FROM x_evj)) GROUP BY ALL""",
)
def _notes(spark, d):
    return L.engine_notes(findings(spark, d)).groupBy("run_id", "rule_id", "finding_key", "title", "technical_note").agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalize_decisions",
    """SELECT decision_id, run_id, requirement_id, status, comment, waiver_reason, reviewer_id, false AS superseded FROM x_reviews""",
)
def _decisions(spark, d):
    return L.normalize_decisions(tb.reviews_log(spark, d)).drop("decided_at")


@query(
    "normalize_evidence",
    "SELECT id, run_id, requirement_id, rule_id, link_url, technical_note, model_element_id, model_element_type, file_name, file_content_hash, kind, comment, file_size_bytes, created_by AS author_id FROM x_evidence",
)
def _norm_evidence(spark, d):
    return L.normalize_evidence(evidence(spark, d)).drop("created_at")


@query(
    "audit_timeline",
    f"""SELECT run_id, CAST(epoch_us(at_ts) AS BIGINT) AS at_us, type, subject_id, detail, actor_id FROM (
  SELECT run_id, {_NOW} AS at_ts, 'validation.completed' AS type, run_id AS subject_id, NULL AS detail, NULL AS actor_id FROM x_runs WHERE v = 'a'
  UNION ALL SELECT run_id, decided_at, CASE WHEN lead(decision_id) OVER (PARTITION BY run_id, requirement_id ORDER BY decided_at, decision_id) IS NULL THEN 'review.decision.current' ELSE 'review.decision.superseded' END, decision_id, requirement_id || ':' || status, reviewer_id FROM x_reviews
  UNION ALL SELECT run_id, created_at, 'evidence.attached', id, kind, created_by FROM x_evidence)""",
)
def _timeline(spark, d):
    runs = tb.runs(spark, d).withColumn("created_at", F.expr(NOW))
    return L.audit_timeline(runs, A.review_history(tb.reviews_log(spark, d)), evidence(spark, d)).selectExpr(
        "run_id", "unix_micros(cast(at as timestamp)) as at_us", "type", "subject_id", "detail", "actor_id"
    )


def artefacts(spark, d):
    return tb.table(spark, d, "documents").selectExpr("concat('bdl-', floor(doc_id / 20)) as bundle_id", "concat('results/', source, '-', doc_id, '.txt') as path", "text as content", "doc_id")


_ART = "SELECT 'bdl-' || (doc_id // 20) AS bundle_id, 'results/' || source || '-' || doc_id || '.txt' AS path, sha256(text) AS sha256, strlen(text) AS bytes, doc_id FROM documents"


@query(
    "checksum_manifest",
    f"""SELECT bundle_id, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS total_bytes, sha256(string_agg(sha256 || ':' || path || ':' || bytes, '|' ORDER BY path)) AS package_sha256 FROM ({_ART}) GROUP BY 1""",
)
def _manifest(spark, d):
    return L.checksum_manifest(L.checksums(artefacts(spark, d)))


@query(
    "verify_manifest",
    f"SELECT bundle_id, path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'unexpected' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS status FROM ({_ART}) WHERE doc_id % 77 <> 0",
)
def _verify(spark, d):
    """Every 7th artefact lost, every 11th unlisted, every 5th edited."""
    a = artefacts(spark, d)
    now = a.where("doc_id % 7 <> 0").withColumn("content", F.expr("if(doc_id % 5 = 0, concat(content, '!'), content)"))
    return L.verify_manifest(now, L.checksums(a.where("doc_id % 11 <> 0")))


# ---- usage, plans, jobs ---------------------------------------------------------------------

cte(
    "x_usage",
    """SELECT 'usr-' || user_id AS user_id, strftime(ts, '%Y-%m') AS month, CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS BIGINT) AS validation_runs,
  CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS audit_exports, CAST(sum(CASE WHEN event_type IN ('purchase', 'error') THEN CAST(floor(value * 1000) AS BIGINT) ELSE 0 END) AS BIGINT) AS storage_bytes FROM events GROUP BY 1, 2""",
)


def usage_events(spark, d):
    return tb.table(spark, d, "events").selectExpr(
        "concat('usr-', user_id) as user_id", "ts", "case when event_type in ('view', 'click') then 'run' when event_type = 'signup' then 'export' else 'bytes' end as kind",
        "if(event_type in ('purchase', 'error'), floor(value * 1000), 1) as amount",
    )


@query("usage_by_month", "SELECT * FROM x_usage")
def _usage(spark, d):
    return L.usage_by_month(usage_events(spark, d))


cte(
    "x_model_bytes",
    f"""SELECT model_id, CAST(sum(n) + 35 + sum(greatest(c - 1, 0)) AS BIGINT) AS bytes FROM (
  SELECT model_id, 'l' AS k, sum(strlen('{{"id":"' || level_id || '","name":"' || name || '"}}')) AS n, count(*) AS c FROM x_levels GROUP BY 1
  UNION ALL SELECT r.model_id, 'r', sum(strlen('{{"id":"' || r.room_id || '","name":"' || r.name || '","levelId":"' || r.level_id || '","roomType":"' || r.room_type || '"}}') + CASE WHEN r.area_sqm IS NULL THEN 0 ELSE strlen(',"areaSqm":' || {num('r.area_sqm')}) END
    + CASE WHEN NOT r.has_list THEN 0 ELSE strlen(',"connectedDoorIds":[]') + coalesce(b.n, 0) END), count(*) FROM x_rooms r LEFT JOIN (SELECT room_id, sum(strlen(door_id) + 2) + count(*) - 1 AS n FROM x_bridge GROUP BY 1) b USING (room_id) WHERE r.v = 'a' GROUP BY 1
  UNION ALL SELECT model_id, 'd', sum(strlen('{{"id":"' || door_id || '","name":"' || name || '","levelId":"' || level_id || '"}}') + CASE WHEN width_m IS NULL THEN 0 ELSE strlen(',"widthM":' || {num('width_m')}) END), count(*) FROM x_doors GROUP BY 1) GROUP BY 1""",
)


@query("model_json_bytes", "SELECT * FROM x_model_bytes")
def _bytes(spark, d):
    return L.model_json_bytes(tb.levels(spark, d), tb.rooms(spark, d), tb.doors(spark, d))


_JOB = (
    "event_id as job_id", "concat('prj-', user_id) as project_id",
    "element_at(array('queued', 'processing', 'completed', 'failed', 'cancelled'), cast(event_id % 5 + 1 as int)) as status",
    "element_at(array('queued', 'parsing', 'validating', 'persisting', 'completed'), cast(event_id % 5 + 1 as int)) as phase",
    "cast(event_id % 4 as int) as attempts", "3 as max_attempts", "timestampadd(DAY, cast(event_id % 3 as int), ts) as next_run_at",
    "timestampadd(SECOND, 90, ts) as lease_expires_at", "ts as started_at", "300 as timeout_seconds", "ts as finished_at", "event_id % 2 = 0 as has_payload", "event_id % 3 = 0 as has_state",
    "floor(value * 100) as bytes",
)
_MID = "timestamp'2024-01-30 12:00:00'"
cte(
    "x_jobs",
    """SELECT event_id AS job_id, 'prj-' || user_id AS project_id, ['queued', 'processing', 'completed', 'failed', 'cancelled'][event_id % 5 + 1] AS status, ['queued', 'parsing', 'validating', 'persisting', 'completed'][event_id % 5 + 1] AS phase,
  event_id % 4 AS attempts, 3 AS max_attempts, ts + to_days(CAST(event_id % 3 AS INTEGER)) AS next_run_at, ts + INTERVAL 90 SECOND AS lease_expires_at, ts, event_id % 2 = 0 AS has_payload, event_id % 3 = 0 AS has_state, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events""",
)


def jobs(spark, d):
    return tb.table(spark, d, "events").selectExpr(*_JOB)


@query(
    "storage_usage",
    """SELECT coalesce(e.user_id, c.user_id) AS user_id, greatest(coalesce(e.estimate, 0), coalesce(c.storage_bytes, 0)) AS storage_bytes FROM (
  SELECT p.owner_id AS user_id, CAST(coalesce(sum(b.bytes), 0) AS BIGINT) AS estimate FROM x_projects p LEFT JOIN (SELECT m.project_id, x.bytes FROM x_model_bytes x JOIN x_models m USING (model_id)
    UNION ALL SELECT u.project_id, e.file_size_bytes FROM x_evidence e JOIN x_runs u USING (run_id) UNION ALL SELECT project_id, bytes FROM x_jobs WHERE status IN ('queued', 'processing')) b USING (project_id)
  WHERE p.deleted_at IS NULL GROUP BY 1) e FULL JOIN (SELECT user_id, storage_bytes FROM x_usage) c ON c.user_id = e.user_id""",
)
def _storage(spark, d):
    keys = tb.models(spark, d).select("model_id", "project_id")
    models = L.model_json_bytes(tb.levels(spark, d), tb.rooms(spark, d), tb.doors(spark, d)).join(keys, "model_id")
    ev = evidence(spark, d).join(tb.runs(spark, d).select("run_id", "project_id"), "run_id").selectExpr("project_id", "file_size_bytes as bytes")
    counters = L.usage_by_month(usage_events(spark, d)).select("user_id", "storage_bytes")
    return L.storage_usage(tb.projects(spark, d), models, ev, jobs(spark, d), counters)


@query(
    "plan_violations",
    "WITH u AS (SELECT 'usr-' || c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'professional' WHEN 2 THEN 'enterprise' ELSE 'starter' END AS plan, c_custkey % 20 AS projects, c_custkey % 5 AS seats, c_custkey % 300 AS runs,"
    " c_custkey % 7 AS exports, CAST(c_custkey * 5000000 AS BIGINT) AS storage, CAST(c_custkey * 50000 AS BIGINT) AS file_bytes, c_custkey % 2 = 0 AS wants_api FROM customer), p AS (SELECT * FROM (VALUES "
    + ", ".join(f"({lit(k)}, {v[1]}, {v[2]}, {v[3]}, {v[4]}, {v[5]}, {v[6]}, {lit(v[7])})" for k, v in L.PLANS.items())
    + ") t(plan, mp, mm, mr, ms, mf, me, api)), j AS (SELECT * FROM u JOIN p USING (plan)) "
    + " UNION ALL ".join(
        f"SELECT user_id, plan, '{n}' AS limit_name, CAST({v} AS BIGINT) AS limit_value FROM j WHERE {c}"
        for n, c, v in [
            ("projects", "projects >= mp", "mp"), ("seats", "seats >= mm", "mm"), ("validation_runs", "runs >= mr", "mr"), ("audit_exports", "exports >= me", "me"),
            ("file_size", "file_bytes > mf", "mf"), ("storage", "storage + file_bytes > ms", "ms"), ("api_access", "wants_api AND NOT api", "0"),
        ]
    ),
)
def _plans(spark, d):
    c = tb.table(spark, d, "customer")
    usage = c.selectExpr(
        "concat('usr-', c_custkey) as user_id", "c_custkey % 20 as projects", "c_custkey % 5 as seats", "c_custkey % 300 as runs", "c_custkey % 7 as exports",
        "c_custkey * 5000000L as storage", "c_custkey * 50000L as file_bytes", "c_custkey % 2 = 0 as wants_api",
    )
    accounts = c.where("c_custkey % 8 <> 7").selectExpr("concat('usr-', c_custkey) as user_id", "element_at(array('starter', 'professional', 'enterprise', 'gold'), cast(c_custkey % 4 + 1 as int)) as plan")
    return L.plan_violations(usage, accounts, L.plan_table(spark))


@query(
    "redact_fields",
    """SELECT event_id, k, v FROM (SELECT event_id, 'user_id' AS k, user_id::VARCHAR AS v FROM events UNION ALL SELECT event_id, 'apiKey', '[redacted]' FROM events UNION ALL SELECT event_id, 'Session-Id', '[redacted]' FROM events
UNION ALL SELECT event_id, 'trace', CASE WHEN event_id % 9 = 0 THEN repeat('x', 500) || '…[truncated]' ELSE 'short' END FROM events
UNION ALL SELECT event_id, 'ids', CASE WHEN event_id % 100 > 50 THEN '[array of ' || (event_id % 100) || ']' ELSE '[' || array_to_string(range(event_id % 100), ',') || ']' END FROM events)""",
)
def _redact(spark, d):
    rows = tb.table(spark, d, "events").selectExpr(
        "event_id",
        """map('user_id', cast(user_id as string), 'apiKey', props, 'Session-Id', event_type, 'trace', if(event_id % 9 = 0, repeat('x', 600), 'short'),
             'ids', concat('[', array_join(transform(if(event_id % 100 = 0, array(), sequence(0, cast(event_id % 100 as int) - 1)), i -> cast(i as string)), ','), ']')) as fields""",
    )
    return L.redact(rows, "fields").selectExpr("event_id", "explode(fields) as (k, v)")


@query(
    "retry_plan",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN r AND a < 3 THEN 'queued' ELSE 'failed' END ELSE CASE WHEN a >= 8 THEN 'failed' ELSE 'pending' END END AS next_state,
  CASE WHEN event_id % 2 = 0 THEN CASE WHEN r AND a < 3 THEN CAST(15 * pow(2, a - 1) AS BIGINT) END ELSE CAST(least(3600, 30 * pow(2, a - 1)) AS BIGINT) END AS delay_seconds, event_id % 2 = 0 AND r AND a >= 3 AS dead_lettered
FROM (SELECT event_id, event_id % 9 + 1 AS a, event_type <> 'error' AS r FROM events)""",
)
def _retry(spark, d):
    rows = tb.table(spark, d, "events").selectExpr("event_id", "if(event_id % 2 = 0, 'job', 'delivery') as kind", "event_id % 9 + 1 as attempts", "3 as max_attempts", "event_type <> 'error' as retryable")
    return L.retry_plan(rows).select("event_id", "next_state", "delay_seconds", "dead_lettered")


@query(
    "classify_error",
    """SELECT event_id, CASE WHEN s IS NOT NULL THEN s = 429 OR s >= 500 ELSE n END AS retryable, CASE WHEN s IS NOT NULL THEN m WHEN n THEN 'A transient network error interrupted the job.' ELSE m END AS message FROM (
  SELECT *, m IN ('TypeError: fetch failed', 'Socket hang up') AS n FROM (SELECT event_id, [NULL, 429, 404, 503][event_id % 4 + 1] AS s, ['TypeError: fetch failed', 'Invalid JSON', 'Socket hang up'][event_id % 3 + 1] AS m FROM events))""",
)
def _errors(spark, d):
    rows = tb.table(spark, d, "events").selectExpr(
        "event_id", "element_at(array(null, 429, 404, 503), cast(event_id % 4 + 1 as int)) as s",
        "element_at(array('TypeError: fetch failed', 'Invalid JSON', 'Socket hang up'), cast(event_id % 3 + 1 as int)) as m",
    )
    retry, shown = L.classify_error("s", "m")
    return rows.selectExpr("event_id", f"{retry} as retryable", f"{shown} as message")


@query(
    "job_backlog",
    """SELECT job_id, CASE WHEN status = 'queued' AND next_run_at <= m THEN 'due' WHEN status = 'processing' AND lease_expires_at < m THEN CASE WHEN attempts + 1 >= max_attempts THEN 'dead_letter' ELSE 'stale_lease' END
  WHEN status = 'processing' AND date_diff('second', ts, m) > 300 THEN 'timed_out' ELSE status END AS backlog, CASE phase WHEN 'queued' THEN 5 WHEN 'parsing' THEN 40 WHEN 'validating' THEN 70 WHEN 'persisting' THEN 90 ELSE 100 END AS progress_percent
FROM (SELECT *, TIMESTAMP '2024-01-30 12:00:00' AS m FROM x_jobs)""",
)
def _backlog(spark, d):
    return L.job_backlog(jobs(spark, d), _MID).select("job_id", "backlog", "progress_percent")


@query("cleanup_candidates", "SELECT job_id FROM x_jobs WHERE status IN ('failed', 'cancelled', 'completed') AND ts < TIMESTAMP '2024-01-29 12:00:00' AND (has_payload OR has_state)")
def _cleanup(spark, d):
    return L.cleanup_candidates(jobs(spark, d), _MID).select("job_id")


@query(
    "fan_out",
    """WITH s AS (SELECT 'whk-' || c_custkey AS webhook_id, c_custkey % 150 AS p, CASE WHEN c_custkey % 3 = 0 THEN ['click', 'error'] ELSE ['purchase'] END AS events, c_custkey % 10 <> 0 AS enabled, c_custkey % 13 = 0 AS revoked, c_custkey % 17 = 0 AS expired FROM customer)
SELECT event_id, webhook_id, 'prj-' || user_id AS project_id, event_type FROM events JOIN s ON s.p = user_id WHERE enabled AND NOT revoked AND NOT expired AND list_contains(s.events, event_type)""",
)
def _fan(spark, d):
    subs = tb.table(spark, d, "customer").selectExpr(
        "concat('whk-', c_custkey) as webhook_id", "concat('prj-', c_custkey % 150) as project_id", "if(c_custkey % 3 = 0, array('click', 'error'), array('purchase')) as events",
        "c_custkey % 10 <> 0 as enabled", f"if(c_custkey % 13 = 0, {NOW}, null) as revoked_at", f"if(c_custkey % 17 = 0, timestamp'2023-01-01 00:00:00', null) as expires_at",
    )
    ev = tb.table(spark, d, "events").selectExpr("event_id", "concat('prj-', user_id) as project_id", "event_type")
    return L.fan_out(ev, subs, NOW)


@query(
    "quota_flags",
    """SELECT * FROM (WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), w(user_id, s) AS (SELECT user_id, min(t) FROM ev GROUP BY 1
  UNION ALL SELECT w.user_id, (SELECT min(e.t) FROM ev e WHERE e.user_id = w.user_id AND e.t >= w.s + 43200000000) FROM w WHERE w.s IS NOT NULL),
  a AS (SELECT e.event_id, e.user_id, e.t, max(w.s) AS s FROM ev e JOIN w ON w.user_id = e.user_id AND w.s <= e.t GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY t, event_id) AS position FROM a)
SELECT event_id, user_id, CAST(s AS BIGINT) AS window_us, position, position <= 2 AS allowed, CASE WHEN position <= 2 THEN 0 ELSE greatest(1, CAST(ceil((s + 43200000000 - t) / 1000000.0) AS BIGINT)) END AS retry_after FROM r)""",
)
def _quota(spark, d):
    e = tb.table(spark, d, "events").selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts")
    return quota.quota_flags(e, "user_id", "ts", 43_200, 2).selectExpr(
        "event_id", "user_id", "unix_micros(window_start) as window_us", "cast(position as bigint) as position", "allowed", "retry_after"
    )
