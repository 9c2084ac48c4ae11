"""Registered queries: requirement-row import over rows and cell grids derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.operators import importer as IM
from modelgauge.plans.oracle import cte, lit
from modelgauge.plans.registry import query
from modelgauge.plans.session import written
from modelgauge.sources import testbed as tb

# Sheet headers in four styles: canonical, aliases, near matches, duplicates and unknown words.
HEADERS = (
    ("id", "title", "type", "severity", "room_type", "minimum", "maximum", "unit", "source_document", "source_section"),
    ("Req ID", "Requirement", "Rule type", "Priority", "Room Type", "Min", "Max", "UOM", "Document", "Section"),
    ("Identifier no", "Requirement Title (EN)", "Validation type", "Criticality level", "Target", "Lower bound", "Upper bound m", "Units", "Source", "Clause number"),
    ("id", "ID", "Name", "Foo", "Type", "Severity", "Max value", "Measurement unit", "Comments", "Quantité type"),
)
_ROW = {
    "id": "if(k % 43 = 0, ' ', concat('R-', k % 997))", "title": "if(k % 41 = 0, '', concat(' Title ', k, ' '))",
    "type": "element_at(array('room area', 'minimum_room_area', 'Door Width', 'door_width', 'connected door', 'composite', 'Informational', 'Foo Rule', ''), cast(k % 9 + 1 as int))",
    "severity": "element_at(array('critical', 'Warning', 'INFO', 'urgent', ''), cast(k % 5 + 1 as int))",
    "target_type": "element_at(array('office', 'lab', 'corridor', '', 'stockroom', 'office', 'office'), cast(k % 7 + 1 as int))",
    "minimum": "element_at(array(concat(k % 90 + 1, ',', k % 10), concat('1.', 100 + k % 900, ',5'), concat('1,', 100 + k % 900, '.5'), concat(' ', k % 50, ' . 5'), 'abc', '', concat(k % 9, 'e2')), cast(floor(k / 7) % 7 + 1 as int))",
    "maximum": "element_at(array('', concat(k % 100), '1,2,3', ''), cast(floor(k / 3) % 4 + 1 as int))",
    "unit": "element_at(array('m2', 'm²', 'SQM', 'mm', ' c m', 'm', 'kg', ''), cast(floor(k / 2) % 8 + 1 as int))",
    "quantity_type": "element_at(array('', 'area', 'LENGTH', 'weird', '', ''), cast(floor(k / 5) % 6 + 1 as int))",
    "source_document": "if(k % 6 = 0, '', 'Brief')", "source_section": "if(k % 4 = 0, '  ', '2.1')",
    "derived_fields": "element_at(array('', 'minimum; nope', 'unit,minimum'), cast(k % 3 + 1 as int))",
    "quantifier": "element_at(array('', 'ANY', 'some'), cast(floor(k / 11) % 3 + 1 as int))", "operator": "element_at(array('AND', 'xor', 'or'), cast(floor(k / 13) % 3 + 1 as int))",
    "conditions_json": """element_at(array('[{"type":"room_area_range","minAreaSqm":5},{"type":"connected_door_width_range","minDoorWidthM":0.8,"maxDoorWidthM":0.7}]',
        '[{"type":"room_area_range","minAreaSqm":5}]', 'not json', '[{"type":"room_area_range","minAreaSqm":5},{"type":"room_area_range","minAreaSqm":9,"maxAreaSqm":10}]'), cast(floor(k / 9) % 4 + 1 as int))""",
}


def import_rows(spark: SparkSession, d: str) -> DataFrame:
    """One raw import row per order; one file per customer."""
    o = tb.table(spark, d, "orders").selectExpr("o_custkey as file", "o_orderkey as k")
    return o.selectExpr("file", "k as source_row", *[f"{e} as {f}" for f, e in _ROW.items()])


def _at(values: str, i: str) -> str:
    return f"({values})[{i} + 1]"


cte(
    "x_imp0",
    """SELECT o_custkey AS file, o_orderkey AS k, CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE 'R-' || (o_orderkey % 997) END AS id, CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'Title ' || o_orderkey END AS title,
  ['minimum_room_area', 'minimum_room_area', 'minimum_door_width_for_room_type', 'minimum_door_width_for_room_type', 'room_has_connected_door', 'composite_room_rule', 'info', 'foo', 'none'][o_orderkey % 9 + 1] AS ty,
  ['critical', 'warning', 'info', 'urgent', 'warning'][o_orderkey % 5 + 1] AS sev, ['office', 'lab', 'corridor', 'unknown', 'stockroom', 'office', 'office'][o_orderkey % 7 + 1] AS room,
  o_orderkey // 7 % 7 AS mi, o_orderkey // 3 % 4 AS mx, ['m²', 'm²', 'm²', 'mm', 'cm', 'm', 'kg', NULL][o_orderkey // 2 % 8 + 1] AS unit, [NULL, 'area', 'length', 'weird', NULL, NULL][o_orderkey // 5 % 6 + 1] AS declared,
  (o_orderkey % 6 = 0) <> (o_orderkey % 4 = 0) AS half, ['', 'minimum', 'unit, minimum'][o_orderkey % 3 + 1] AS derived, o_orderkey // 11 % 3 AS qn, o_orderkey // 13 % 3 AS op, o_orderkey // 9 % 4 AS cj FROM orders""",
)
cte(
    "x_imp1",
    """SELECT *, CASE WHEN declared IS NOT NULL AND declared <> 'weird' THEN declared WHEN ty = 'minimum_room_area' THEN 'area' WHEN ty = 'minimum_door_width_for_room_type' THEN 'length' WHEN unit = 'm²' THEN 'area'
    WHEN unit IN ('mm', 'cm', 'm') THEN 'length' ELSE 'untyped' END AS qty,
  CASE mi WHEN 0 THEN ((k % 90 + 1)::VARCHAR || '.' || (k % 10))::DOUBLE WHEN 1 THEN ('1' || (100 + k % 900) || '.5')::DOUBLE WHEN 2 THEN ('1' || (100 + k % 900) || '.5')::DOUBLE WHEN 3 THEN ((k % 50)::VARCHAR || '.5')::DOUBLE WHEN 6 THEN (k % 9) * 100.0::DOUBLE END AS rawmin,
  CASE mx WHEN 1 THEN (k % 100)::DOUBLE END AS rawmax FROM x_imp0""",
)
_CANON = "CASE WHEN qty = 'length' THEN CASE unit WHEN 'mm' THEN {v} / 1000 WHEN 'cm' THEN {v} / 100 WHEN 'm' THEN {v} ELSE CASE WHEN unit IS NULL THEN {v} END END WHEN qty = 'area' THEN CASE WHEN unit IS NULL OR unit = 'm²' THEN {v} END ELSE {v} END"
cte("x_imp2", f"SELECT *, {_CANON.format(v='rawmin')} AS minv, {_CANON.format(v='rawmax')} AS maxv, ty IN ('minimum_room_area', 'minimum_door_width_for_room_type') AS ranged FROM x_imp1")
_E = [
    ("id = ''", "Requirement ID is required."), ("title = ''", "Title is required."), ("declared = 'weird'", "Unsupported quantity type 'weird'."),
    ("mi <> 5 AND minv IS NULL", "Minimum value or unit is invalid for the selected quantity type."), ("mx IN (1, 2) AND maxv IS NULL", "Maximum value or unit is invalid for the selected quantity type."),
    ("half", "Source document and source section must be supplied together."), ("ty = 'composite_room_rule' AND cj = 2", "Composite conditions must be valid JSON."),
    ("(ranged OR ty = 'composite_room_rule') AND room = 'lab'", "roomType: Unknown room type"), ("ranged AND mi = 5", "minimum: Required"), ("ranged AND minv <= 0", "minimum: Number must be greater than 0"),
    ("ranged AND maxv <= 0", "maximum: Number must be greater than 0"), ("ty = 'minimum_door_width_for_room_type' AND qn = 2", "quantifier: Expected any or all"),
    ("ty = 'minimum_room_area' AND qty <> 'area'", "quantityType: Room area rules require quantityType 'area'"), ("ty = 'minimum_room_area' AND unit <> 'm²'", "unit: Room area rules require an area unit"),
    ("ty = 'minimum_door_width_for_room_type' AND qty <> 'length'", "quantityType: Door width rules require quantityType 'length'"),
    ("ty = 'minimum_door_width_for_room_type' AND unit NOT IN ('mm', 'cm', 'm')", "unit: Door width rules require a length unit"),
    ("ty = 'minimum_room_area' AND maxv < minv", "maxAreaSqm: Maximum room area must be greater than or equal to minimum room area"),
    ("ty = 'minimum_door_width_for_room_type' AND maxv < minv", "maxDoorWidthM: Maximum door width must be greater than or equal to minimum door width"),
    ("ty = 'composite_room_rule' AND op = 1", "operator: Expected and or or"), ("ty = 'composite_room_rule' AND cj = 1", "conditions: Composite rules need 2 to 10 conditions"),
    ("ty = 'composite_room_rule' AND cj = 0", "conditions: Condition maximum must be greater than or equal to its minimum"),
]
cte(
    "x_imp",
    "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {c} THEN {lit(m)} END" for c, m in _E) + """], lambda e: e IS NOT NULL) AS errors,
  list_filter([CASE WHEN derived <> '' THEN 'Formula-derived values may be stale: ' || derived || '.' END, CASE WHEN ty = 'foo' THEN 'Unknown rule type ''Foo Rule'' was preserved as a textual requirement.' END,
    CASE WHEN ty = 'none' THEN 'No executable rule type was supplied.' END, CASE WHEN sev = 'urgent' THEN 'Unknown severity ''urgent'' defaulted to warning.' END], lambda e: e IS NOT NULL) AS warnings,
  CASE ty WHEN 'info' THEN 'informational' WHEN 'foo' THEN 'requires_rule_configuration' WHEN 'none' THEN 'requires_rule_configuration' ELSE 'ready_for_validation' END AS status FROM x_imp2""",
)


@query(
    "normalize_rows",
    """SELECT file, k AS source_row, id AS requirement_id, CASE WHEN ty IN ('info', 'foo', 'none') THEN 'textual_requirement' ELSE ty END AS rule_type, CASE WHEN sev = 'urgent' THEN 'warning' ELSE sev END AS severity,
  unit, qty AS quantity, minv AS min_value, maxv AS max_value, status, array_to_string(errors, '^') AS errors, array_to_string(warnings, '^') AS warnings, len(warnings) = 0 AS reviewed FROM x_imp""",
)
def _normalize(spark, d):
    return IM.normalize_rows(import_rows(spark, d)).selectExpr(
        "file", "source_row", "requirement_id", "rule_type", "severity_text as severity", "unit_text as unit", "quantity_text as quantity", "min_value", "max_value", "status",
        "array_join(errors, '^') as errors", "array_join(warnings, '^') as warnings", "reviewed",
    )


@query("parse_numbers", "SELECT k AS source_row, rawmin AS minimum, rawmax AS maximum FROM x_imp1")
def _numbers(spark, d):
    return import_rows(spark, d).selectExpr("source_row", f"{IM.parse_number('minimum')} as minimum", f"{IM.parse_number('maximum')} as maximum")


def reviewed_rows(spark, d):
    """Normalised rows where every third row was excluded (every ninth without a reason) and even rows reviewed."""
    rows = IM.normalize_rows(import_rows(spark, d))
    return rows.withColumns(
        {
            "included": F.expr("source_row % 3 <> 0"), "exclusion_reason": F.expr("if(source_row % 3 = 0 and source_row % 9 <> 0, 'informational', null)"),
            "reviewed": F.expr("reviewed or source_row % 2 = 0"),
        }
    )


@query(
    "finalize_package",
    """SELECT file, k AS source_row, 'Row ' || k || ': excluded rows require a reason.' AS message FROM x_imp WHERE k % 9 = 0 UNION ALL SELECT file, k, 'Row ' || k || ': ' || array_to_string(errors, ' ') FROM x_imp WHERE k % 3 <> 0 AND len(errors) > 0
UNION ALL SELECT file, k, 'Row ' || k || ': warnings must be explicitly reviewed.' FROM x_imp WHERE k % 3 <> 0 AND len(warnings) > 0 AND k % 2 = 1
UNION ALL SELECT file, NULL, 'Duplicate requirement ID: ' || id FROM x_imp WHERE k % 3 <> 0 AND len(errors) = 0 GROUP BY file, id HAVING count(*) > 1
UNION ALL SELECT file, NULL, 'At least one included requirement is required.' FROM x_imp GROUP BY file HAVING count(*) FILTER (WHERE k % 3 <> 0) = 0""",
)
def _finalize(spark, d):
    return IM.finalize_package(reviewed_rows(spark, d))


@query(
    "toggle_included",
    """SELECT file, k AS source_row, CASE WHEN k % 4 = 1 THEN k % 3 = 0 ELSE k % 3 <> 0 END AS included, CASE WHEN k % 4 = 1 AND k % 3 <> 0 THEN 'excluded' ELSE status END AS status,
  CASE WHEN k % 4 = 1 THEN CASE WHEN k % 3 <> 0 THEN 'excluded_by_user' END WHEN k % 3 = 0 AND k % 9 <> 0 THEN 'informational' END AS exclusion_reason FROM x_imp""",
)
def _toggle(spark, d):
    """Every fourth row is flipped: excluded rows come back, included ones are taken out by the user."""
    rows = reviewed_rows(spark, d)
    flipped = IM.toggle_included(rows, rows.where("source_row % 4 = 1").select("file", "source_row"))
    return flipped.select("file", "source_row", "included", "status", "exclusion_reason")


@query(
    "import_counts",
    """SELECT file, count(*) FILTER (WHERE k % 3 <> 0 AND len(errors) = 0 AND len(warnings) = 0) AS valid, count(*) FILTER (WHERE k % 3 <> 0 AND len(errors) = 0 AND len(warnings) > 0) AS warning,
  count(*) FILTER (WHERE k % 3 <> 0 AND len(errors) > 0) AS blocked, count(*) FILTER (WHERE k % 3 = 0) AS excluded FROM x_imp GROUP BY file""",
)
def _counts(spark, d):
    return IM.import_counts(reviewed_rows(spark, d))


@query(
    "apply_row_edits",
    """SELECT file, k AS source_row, CASE WHEN k % 10 = 1 THEN 'fixed-' || k ELSE id END AS requirement_id, CASE WHEN k % 10 = 1 THEN list_filter(errors, lambda e: e <> 'Requirement ID is required.') ELSE errors END = [] AS clean, k % 10 = 1 AS edited FROM x_imp""",
)
def _edits(spark, d):
    """Every tenth row gets a new id (two edits, the later wins), then all rows are normalised again."""
    raw = import_rows(spark, d)
    hit = raw.where("source_row % 10 = 1")
    edits = hit.selectExpr("file", "source_row", "'id' as field", "'draft' as value", "1 as seq").unionByName(
        hit.selectExpr("file", "source_row", "'id' as field", "concat('fixed-', source_row) as value", "2 as seq")
    )
    return IM.normalize_rows(IM.apply_row_edits(raw, edits)).selectExpr("file", "source_row", "requirement_id", "size(errors) = 0 as clean", "edited")


@query(
    "set_row_status",
    """SELECT file, k AS source_row, CASE WHEN ty IN ('info', 'foo', 'none') AND k % 4 = 1 THEN CASE WHEN k % 8 = 1 THEN 'valid_requirement' ELSE 'informational' END ELSE status END AS status, k % 4 IN (1, 2) AS edited, true AS included,
  len(warnings) = 0 AND NOT k % 4 IN (1, 2) AS reviewed FROM x_imp""",
)
def _statuses(spark, d):
    """Every fourth row is called informational and half of those then a valid requirement; every other fourth gets a status that texts do not have."""
    raw = import_rows(spark, d)
    asked = lambda where, status, seq: raw.where(where).selectExpr("file", "source_row", f"'{status}' as status", f"{seq} as seq")
    statuses = asked("source_row % 4 = 1", "informational", 1).unionByName(asked("source_row % 8 = 1", "valid_requirement", 2)).unionByName(asked("source_row % 4 = 2", "excluded", 1))
    rows = IM.normalize_rows(IM.set_status(raw, statuses))
    return rows.selectExpr("file", "source_row", "status", "edited", "included", "reviewed and not edited as reviewed")


@query(
    "route_csv_fields",
    """SELECT o_orderkey AS source_row, CASE WHEN o_orderkey % 4 = 0 THEN 'door' ELSE 'office' END AS target_type, CASE WHEN o_orderkey % 2 = 0 THEN '12' WHEN o_orderkey % 3 = 0 THEN '1' ELSE '0.9' END AS minimum, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '2' END AS maximum FROM orders""",
)
def _route(spark, d):
    records = tb.table(spark, d, "orders").selectExpr(
        "o_custkey as file", "o_orderkey as source_row", "if(o_orderkey % 2 = 0, 'minimum_room_area', 'door_width') as type", "if(o_orderkey % 4 = 0, '', 'office') as room_type", "'door' as element_type",
        "'12' as min_area_sqm", "'' as max_area_sqm", "if(o_orderkey % 3 = 0, '', '0.9') as min_door_width_m", "'1' as minimum", "'2' as max_door_width_m",
    )
    return IM.route_csv_fields(records).select("source_row", "target_type", "minimum", "maximum")


# ---- grids ----------------------------------------------------------------------------------


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Two sheets per customer: a title row, the header on row 2, then one row per order on its sheet."""
    c = tb.table(spark, d, "customer").selectExpr("c_custkey as file", "explode(array(0, 1)) as s")
    styles = "array(" + ", ".join("array(" + ", ".join(f"'{h}'" for h in row) + ")" for row in HEADERS) + ")"
    top = c.selectExpr("file", "s", "1 as row", "0 as col", "'Requirement list' as display").unionByName(
        c.selectExpr("file", "s", "2 as row", f"posexplode({styles}[cast((file + s) % 4 as int)]) as (col, display)")
    )
    o = tb.table(spark, d, "orders").selectExpr("o_custkey as file", "cast(o_orderkey % 2 as int) as s", "cast(o_orderkey + 3 as int) as row", "o_orderkey as k")
    body = o.selectExpr("file", "s", "row", "posexplode(array(concat('R-', k), concat('Title ', k), 'room area', 'warning', 'office', cast(k % 30 as string), '', 'm2', 'Brief', if(k % 8 = 0, '', '2.1'))) as (col, display)")
    return top.unionByName(body).selectExpr(
        "file", "if(s = 0, 'Main', 'Other') as sheet", "s as sheet_pos", "file % 5 = 0 and s = 0 as hidden", "row", "col", "display",
        "if(col = 5 and row % 4 = 0, '=A1', null) as formula", "col = 5 and row % 4 = 0 as derived", "col = 5 and row % 12 = 0 as missing_formula_result",
    )


cte("x_alias", "SELECT * FROM (VALUES " + ", ".join(
    f"({f}, {lit(field)}, {i}, {lit(IM.normalize_header_text(name))})" for f, (field, names) in enumerate(IM.ALIASES.items()) for i, name in enumerate([field, *names])
) + ") t(f, field, i, cand)")
cte("x_heads", "SELECT * FROM (VALUES " + ", ".join(f"({s}, {c}, {lit(h)})" for s, row in enumerate(HEADERS) for c, h in enumerate(row)) + ") t(style, col, header)")
cte(
    "x_hbest",
    """SELECT h.style, h.col, h.header, max(s) AS score, max_by(field, (s, -f)) AS field FROM (SELECT h.style, h.col, h.header, a.f, a.field, CASE WHEN a.cand = h.n THEN CASE WHEN a.i = 0 THEN 100 ELSE 92 END WHEN sh >= 0.75 THEN 75 WHEN sh >= 0.5 THEN 50 ELSE 0 END AS s
  FROM (SELECT *, trim(regexp_replace(strip_accents(lower(header)), '[^a-z0-9]+', ' ', 'g')) AS n FROM x_heads) h, LATERAL (SELECT *, len(list_filter(string_split(cand, ' '), lambda t: list_contains(string_split(h.n, ' '), t))) / len(string_split(cand, ' ')) AS sh FROM x_alias) a) h GROUP BY 1, 2, 3""",
)
cte(
    "x_map",
    """SELECT style, col, header, CASE WHEN score > 0 AND rn = 1 THEN field END AS field, CASE WHEN score = 0 OR rn > 1 THEN 'unmapped' WHEN score >= 92 THEN 'high' WHEN score = 75 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY style, CASE WHEN score > 0 THEN field ELSE '?' || col END ORDER BY col) AS rn FROM x_hbest)""",
)


def header_cells(grid: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Cells of each sheet's detected header row, as header texts. The header is one of the rows that detection looks at. `headers`, what
    was detected, may be given as a stored table."""
    rows = (IM.detect_header(grid) if headers is None else headers).select("file", "sheet", F.col("header_row").alias("row"))
    return grid.where(f"row <= {IM.HEADER_ROWS}").join(rows, ["file", "sheet", "row"]).selectExpr("file", "sheet", "row", "col", "display as header")


def headers(spark: SparkSession, d: str) -> DataFrame:
    """The detected header row of every sheet, written once: three steps of an import read it, and each would detect it again."""
    return written(spark, f"grid-headers:{d}", lambda: IM.detect_header(cells(spark, d)))


def mappings(spark: SparkSession, d: str) -> DataFrame:
    """The mapped columns of every sheet, written once."""
    return written(spark, f"grid-mappings:{d}", lambda: IM.suggest_mappings(header_cells(cells(spark, d), headers(spark, d))))


@query("suggest_mappings", "SELECT c_custkey AS file, CASE s WHEN 0 THEN 'Main' ELSE 'Other' END AS sheet, m.col, m.header, m.field, m.confidence, m.confidence = 'high' AS accepted FROM customer, (VALUES (0), (1)) t(s), x_map m WHERE m.style = (c_custkey + s) % 4")
def _suggest(spark, d):
    return mappings(spark, d).select("file", "sheet", "col", "header", "field", "confidence", "accepted")


@query("normalize_headers", r"SELECT doc_id, l AS header, trim(regexp_replace(lower(strip_accents(l)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM x_lines0")
def _norm(spark, d):
    """All document lines as header texts."""
    from modelgauge.operators import fragments as FR

    lines = FR.read_fragments(tb.table(spark, d, "documents"))
    return IM.norm_headers(lines.selectExpr("doc_id", "exact_text as header"), "header", "norm")


@query("detect_header", "SELECT c_custkey AS file, CASE s WHEN 0 THEN 'Main' ELSE 'Other' END AS sheet, 2 AS header_row FROM customer, (VALUES (0), (1)) t(s)")
def _detect(spark, d):
    return headers(spark, d).select("file", "sheet", "header_row")


def _chosen(spark, d, strict):
    grid = cells(spark, d)
    sheets = grid.select("file", "sheet", "hidden", "sheet_pos").distinct()
    return IM.choose_sheet(sheets, mappings(spark, d), strict)


cte("x_stylestat", "SELECT style, count(field) AS mapped, count(*) FILTER (WHERE confidence = 'high' AND field IN ('id', 'title', 'type', 'severity')) AS req, count(*) FILTER (WHERE field IS NOT NULL AND confidence <> 'high') AS weak, count(*) FILTER (WHERE field IN ('id', 'title')) AS both_n FROM x_map GROUP BY 1")
cte("x_sheets", "SELECT c_custkey AS file, s, CASE s WHEN 0 THEN 'Main' ELSE 'Other' END AS sheet, c_custkey % 5 = 0 AND s = 0 AS hidden, t.* FROM customer, (VALUES (0), (1)) v(s), x_stylestat t WHERE t.style = (c_custkey + s) % 4")


@query("choose_sheet_strict", "SELECT file, min_by(sheet, s) AS sheet FROM x_sheets WHERE NOT hidden AND req = 4 AND weak = 0 GROUP BY 1")
def _strict(spark, d):
    return _chosen(spark, d, True)


@query(
    "choose_sheet_interactive",
    "SELECT file, sheet FROM x_sheets QUALIFY row_number() OVER (PARTITION BY file ORDER BY CASE WHEN NOT hidden AND both_n = 2 THEN 0 WHEN NOT hidden THEN 1 ELSE 2 END, CASE WHEN NOT hidden AND both_n = 2 THEN -mapped ELSE 0 END, s) = 1",
)
def _interactive(spark, d):
    return _chosen(spark, d, False)


@query("read_cell_grid", "SELECT o_custkey AS file, CASE o_orderkey % 2 WHEN 0 THEN 'Main' ELSE 'Other' END AS sheet, o_orderkey + 3 AS row, 10 AS n_cells, false AS empty FROM orders UNION ALL SELECT c_custkey, sh, r, n, false FROM customer, (VALUES ('Main'), ('Other')) t(sh), (VALUES (1, 1), (2, 10)) u(r, n)")
def _grid(spark, d):
    return IM.read_cell_grid(cells(spark, d)).selectExpr("file", "sheet", "row", "size(cells) as n_cells", "empty")


@query(
    "grid_to_rows",
    """WITH c AS (SELECT file, s, (file + s) % 4 AS style FROM x_sheets QUALIFY row_number() OVER (PARTITION BY file ORDER BY CASE WHEN NOT hidden AND both_n = 2 THEN 0 WHEN NOT hidden THEN 1 ELSE 2 END, CASE WHEN NOT hidden AND both_n = 2 THEN -mapped ELSE 0 END, s) = 1),
f AS (SELECT style, max(col) FILTER (WHERE field = 'id') AS ci, max(col) FILTER (WHERE field = 'minimum') AS cm, max(field) FILTER (WHERE col = 5) AS f5 FROM x_map GROUP BY 1)
SELECT file, k + 3 AS source_row, vals[ci + 1] AS id, vals[cm + 1] AS minimum, CASE WHEN (k + 3) % 4 = 0 THEN coalesce(f5, '') ELSE '' END AS derived,
  CASE WHEN (k + 3) % 12 = 0 AND f5 IS NOT NULL THEN f5 || ': formula has no cached result.' ELSE '' END AS formula_errors
FROM (SELECT c.*, o_orderkey AS k, ['R-' || o_orderkey, 'Title ' || o_orderkey, 'room area', 'warning', 'office', (o_orderkey % 30)::VARCHAR, '', 'm2', 'Brief', CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE '2.1' END] AS vals
  FROM orders JOIN c ON o_custkey = file AND o_orderkey % 2 = s) JOIN f USING (style)""",
)
def _rows(spark, d):
    """Every file: its chosen sheet below the detected header row."""
    chosen = headers(spark, d).join(_chosen(spark, d, False), ["file", "sheet"])
    rows = IM.grid_to_rows(cells(spark, d), mappings(spark, d), chosen)
    return IM.values_to_columns(rows).selectExpr("file", "source_row", "id", "minimum", "array_join(derived, ',') as derived", "array_join(formula_errors, ',') as formula_errors")
