"""Requirement-row import: header mapping, number and unit normalising, row checks and package confirmation."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgauge.functions.ordered import stored
from modelgauge.functions.skew import latest, salted_join
from modelgauge.operators.checks import (
    AREA_UNITS, LENGTH_UNITS, QUANTITY_TYPES, ROOM_TYPES, SEVERITIES, repeats_after_first, sql_in,
)

# Canonical fields with the header aliases recognised for each.
ALIASES = {
    "id": ["requirement id", "requirement_id", "req id", "req_id", "identifier", "clause id", "code"],
    "title": ["requirement", "requirement title", "name", "clause", "subject"],
    "description": ["details", "requirement description", "text", "clause text", "requirement text"],
    "discipline": ["trade", "category", "domain"],
    "type": ["rule type", "requirement type", "validation type"],
    "severity": ["priority", "criticality", "risk"],
    "target_type": ["room type", "room_type", "element type", "element_type", "target", "target type"],
    "minimum": ["min", "minimum value", "min value", "lower bound", "min_area_sqm", "min_door_width_m"],
    "maximum": ["max", "maximum value", "max value", "upper bound", "max_area_sqm", "max_door_width_m"],
    "unit": ["units", "measurement unit", "uom"],
    "quantity_type": ["quantity type", "quantity_type", "measure type", "dimension"],
    "source_document": ["source document", "document", "specification", "source"],
    "source_section": ["source section", "section", "clause number", "paragraph"],
    "source_revision": ["source revision", "document revision", "source rev"],
    "notes": ["note", "comments", "comment", "remarks"],
    "derived_fields": ["derived fields", "formula fields", "calculated fields"],
    "quantifier": ["door quantifier", "any all"],
    "operator": ["logical operator", "and or"],
    "conditions_json": ["conditions", "conditions json", "composite conditions"],
    "specification_name": ["specification name", "package name", "spec name"],
    "specification_revision": ["specification revision", "package revision", "spec revision"],
}
# Rule-type names accepted on import.
RULE_TYPES = {
    "room_area": "minimum_room_area", "minimum_area": "minimum_room_area", "minimum_room_area": "minimum_room_area",
    "door_width": "minimum_door_width_for_room_type", "minimum_door_width": "minimum_door_width_for_room_type",
    "minimum_door_width_for_room_type": "minimum_door_width_for_room_type", "connected_door": "room_has_connected_door",
    "room_has_connected_door": "room_has_connected_door", "composite": "composite_room_rule", "composite_room_rule": "composite_room_rule",
    "informational": "textual_requirement", "textual_requirement": "textual_requirement",
}
HEADER_ROWS = 50
REQUIRED_HIGH = ("id", "title", "type", "severity")
CONDITIONS_JSON = "array<struct<type:string,minAreaSqm:double,maxAreaSqm:double,minDoorWidthM:double,maxDoorWidthM:double,quantifier:string>>"


def normalize_header_text(value: str | None) -> str | None:
    if value is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not "̀" <= c <= "ͯ")
    return re.sub(r"[^a-z0-9]+", " ", plain.lower()).strip()


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str, dict[str, str]]:
    """What `normalize_header_text` makes of single characters outside ASCII: characters that become one ASCII letter or digit, these
    letters, and a table of those that become several (ligatures, fractions, squared units). All others separate words."""
    singles, targets, several = [], [], {}
    for code in chain(range(0x80, 0xD800), range(0xE000, 0x110000)):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char)
        if plain == char:
            continue
        told = re.sub(r"[^a-z0-9]", " ", "".join(c for c in plain if not "\u0300" <= c <= "\u036f").lower())
        if len(told) == 1 and told != " ":
            singles.append(char)
            targets.append(told)
        elif told.strip() or not told:
            several[char] = told
    return "".join(singles), "".join(targets), several


def norm_header(column: str | Column) -> Column:
    """Normal form of header texts as a native expression: ASCII texts are lower-cased at once, others lose their combining marks and have
    their letters replaced first; NULL stays NULL."""
    text = F.col(column) if isinstance(column, str) else column
    singles, targets, several = _letters()
    plain = F.translate(F.regexp_replace(text, "[\u0300-\u036F]+", ""), singles, targets)
    # One text literal that Spark folds into a map, not a node of the plan for each letter.
    table = F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in several.items())), F.lit("\u0001"), F.lit("\u0002"))
    wide = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    marks = "[" + "".join(several) + "]"
    told = F.when(text.rlike("^[\\x00-\\x7F]*$"), text).when(plain.rlike(marks), wide).otherwise(plain)
    return F.trim(F.regexp_replace(F.lower(told), "[^a-z0-9]+", " "))


def norm_headers(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the normal form of `column`."""
    return df.withColumn(out, norm_header(column))


def _alias_tokens(spark) -> DataFrame:
    """The fixed alias table, one row per word of each alias."""
    rows = []
    for f, (field, names) in enumerate(ALIASES.items()):
        for i, name in enumerate([field, *names]):
            text = normalize_header_text(name)
            rows += [(f, field, i, text, len(text.split()), token) for token in text.split()]
    return spark.createDataFrame(rows, "f int, field string, i int, cand string, n_tokens int, token string")


def best_fields(headers: DataFrame) -> DataFrame:
    """(header, field, score): best canonical field of each distinct header text.

    Words meet aliases by an equi-join, so only aliases that share a word with a header are looked at.
    """
    words = headers.select("header").distinct().withColumn("_n", norm_header("header")).selectExpr(
        "header", "_n", "explode(array_distinct(split(_n, ' '))) as token"
    )
    shared = (
        words.join(_alias_tokens(headers.sparkSession), "token")
        .groupBy("header", "_n", "f", "field", "i", "cand", "n_tokens")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    score = "case when cand = _n then if(i = 0, 100, 92) when hits / n_tokens >= 0.75 then 75 when hits / n_tokens >= 0.5 then 50 else 0 end"
    return (
        shared.withColumn("score", F.expr(score))
        .groupBy("header")
        .agg(F.max(F.struct("score", (-F.col("f")).alias("r"), "field")).alias("b"))
        .selectExpr("header", "if(b.score > 0, b.field, null) as _field", "b.score as _score")
    )


def suggest_mappings(headers: DataFrame) -> DataFrame:
    """headers (file, sheet, row, col, header) -> + field, confidence, score, accepted.

    A field is given to the first column of the header row that suggests it; later ones are unmapped.
    Scoring runs once per distinct header text, and its result is written, so that Spark knows its size: a few texts that all files share
    are broadcast and the cells stay where they are. Blank texts have no words, so they map to nothing.
    """
    blank = F.trim(F.coalesce(F.col("header"), F.lit(""))) == ""
    tagged = headers.join(stored(best_fields(headers.where(~blank))), "header", "left")
    first = tagged.groupBy("file", "sheet", "row", "_field").agg(F.min("col").alias("_first"))
    joined = tagged.join(first, ["file", "sheet", "row", "_field"], "left")
    return joined.selectExpr(
        "file", "sheet", "row", "col", "header",
        "if(_first = col, _field, null) as field",
        "case when _first = col then case when _score >= 92 then 'high' when _score = 75 then 'medium' else 'low' end else 'unmapped' end as confidence",
        "coalesce(_first = col and _score >= 92, false) as accepted",
    )


def read_cell_grid(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, cells, empty): one row per sheet row with its cells in column order."""
    return cells.groupBy("file", "sheet", "hidden", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", "display", "formula", "derived", "missing_formula_result"))).alias("cells"),
        F.bool_and(F.trim(F.coalesce("display", F.lit(""))) == "").alias("empty"),
    )


def detect_header(cells: DataFrame) -> DataFrame:
    """(file, sheet, header_row, score): best of the first 50 rows (HEADER_ROWS), the first row wins ties."""
    width = cells.groupBy("file", "sheet").agg((F.max("col") + 1).alias("_cols"))
    top = cells.where(f"row <= {HEADER_ROWS}").selectExpr("file", "sheet", "row", "col", "coalesce(display, '') as header")
    rows = suggest_mappings(top).groupBy("file", "sheet", "row").agg(
        F.sum(F.expr("case confidence when 'high' then 4 when 'medium' then 2 when 'low' then 1 else 0 end")).alias("points"),
        F.max(F.expr("if(field = 'id', 8, 0)")).alias("has_id"),
        F.max(F.expr("if(field = 'title', 8, 0)")).alias("has_title"),
        F.count_if(F.expr("trim(header) <> ''")).alias("filled"),
    )
    scored = rows.join(width, ["file", "sheet"]).withColumn(
        "score", F.expr("points + coalesce(has_id, 0) + coalesce(has_title, 0) + filled / greatest(_cols, 1)")
    )
    return (
        scored.groupBy("file", "sheet")
        .agg(F.max(F.struct("score", (-F.col("row")).alias("r"))).alias("b"))
        .selectExpr("file", "sheet", "-b.r as header_row", "b.score as score")
    )


def choose_sheet(sheets: DataFrame, mappings: DataFrame, strict: bool) -> DataFrame:
    """(file, sheet) to import. sheets: file, sheet, hidden, sheet_pos; mappings: of each sheet's header row.

    Interactive: the visible sheet with id and title and the most mapped columns, else the first visible, else the
    first. Strict: the first visible sheet with all four required fields at high confidence and nothing below high.
    """
    per = mappings.groupBy("file", "sheet").agg(
        F.count("field").alias("mapped"),
        F.count_if(F.expr(f"confidence = 'high' and field in {sql_in(REQUIRED_HIGH)}")).alias("required"),
        F.count_if(F.expr("field is not null and confidence <> 'high'")).alias("weak"),
        F.count_if(F.expr("field in ('id', 'title')")).alias("both"),
    )
    joined = sheets.join(per, ["file", "sheet"], "left").fillna(0, ["mapped", "required", "weak", "both"])
    if strict:
        ranked = joined.where("not hidden and required = 4 and weak = 0").withColumn("_o", F.struct(F.col("sheet_pos")))
    else:
        rank = F.expr("case when not hidden and both = 2 then 0 when not hidden then 1 else 2 end")
        ranked = joined.withColumn(
            "_o", F.struct(rank.alias("a"), F.when(rank == 0, -F.col("mapped")).otherwise(0).alias("b"), F.col("sheet_pos"))
        )
    return ranked.groupBy("file").agg(F.min_by("sheet", "_o").alias("sheet"))


def grid_to_rows(cells: DataFrame, mappings: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Data rows of the chosen sheets as (file, source_row, empty, values, derived, formula_errors).

    header_rows are limited to the chosen sheets; mappings are the accepted ones. What is known of a sheet, its header row and the fields of
    its columns, is put together first, so that the cells meet it in one join by sheet, which never passes through the driver."""
    used = mappings.where("field is not null").groupBy("file", "sheet").agg(F.collect_list(F.struct("col", "field")).alias("_fields"))
    known = salted_join(header_rows.select("file", "sheet", "header_row"), used, ["file", "sheet"], ["sheet"], how="left")
    body = salted_join(cells, known, ["file", "sheet"], ["row"]).where("row > header_row")
    tagged = body.withColumn("_own", F.expr("filter(_fields, x -> x.col = col)")).selectExpr("*", "explode_outer(_own.field) as field")
    has = "field is not null"
    return tagged.groupBy("file", F.col("row").alias("source_row")).agg(
        F.bool_and(F.trim(F.coalesce("display", F.lit(""))) == "").alias("empty"),
        F.expr(f"map_from_entries(collect_list(if({has}, struct(field, coalesce(display, '')), null)))").alias("values"),
        F.expr(f"transform(array_sort(collect_list(if({has} and derived, struct(col, field), null))), x -> x.field)").alias("derived"),
        F.expr(
            f"transform(array_sort(collect_list(if({has} and missing_formula_result, struct(col, field), null))), x -> concat(x.field, ': formula has no cached result.'))"
        ).alias("formula_errors"),
    )


def values_to_columns(rows: DataFrame, column: str = "values") -> DataFrame:
    """The canonical fields of a values map as columns."""
    rest = [c for c in rows.columns if c != column]
    return rows.selectExpr(*rest, *[f"try_element_at({column}, '{f}') as {f}" for f in ALIASES])


def clean(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^\\\\s+|\\\\s+$', ''), '')"


def compact(x: str) -> str:
    return f"regexp_replace({x}, '\\\\s', '')"


def point_decimal(c: str) -> str:
    """SQL text: a compact number text with its decimal sign turned into a point.

    With both separators the last one is the decimal sign; a lone comma is decimal (only the first is replaced)."""
    dotted = lambda v: f"if(instr({v}, ',') > 0, concat(left({v}, instr({v}, ',') - 1), '.', substring({v}, instr({v}, ',') + 1)), {v})"
    no_dots = f"replace({c}, '.', '')"
    return (
        f"case when instr({c}, ',') > 0 and instr({c}, '.') > 0 then"
        f" if(instr(reverse({c}), ',') < instr(reverse({c}), '.'), {dotted(no_dots)}, replace({c}, ',', ''))"
        f" else {dotted(c)} end"
    )


def plain_number(text: str) -> str:
    """SQL text: double of a point-decimal text, NULL when it is no number; hexadecimal is not accepted."""
    return f"if({text} rlike '^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$', try_cast({text} as double), null)"


def parse_number(x: str) -> str:
    """SQL text: double of a localised number text; NULL when it is blank or no number (tell apart by `clean`)."""
    return plain_number(point_decimal(compact(x)))


def norm_unit(x: str) -> str:
    u = f"nullif(lower(regexp_replace({x}, '\\\\s', '')), '')"
    return f"if({u} in {sql_in(AREA_UNITS)}, 'm²', {u})"


def infer_quantity(rule_type: str, unit: str) -> str:
    return (
        f"case when {rule_type} = 'minimum_room_area' then 'area' when {rule_type} = 'minimum_door_width_for_room_type' then 'length'"
        f" when {unit} = 'm²' then 'area' when {unit} in {sql_in(LENGTH_UNITS)} then 'length' else 'untyped' end"
    )


def to_canonical(value: str, unit: str, quantity: str) -> str:
    """SQL text: value in metres / square metres; NULL when the unit does not fit the quantity."""
    return (
        f"case when {quantity} = 'length' then case when {unit} = 'mm' then {value} / 1000 when {unit} = 'cm' then {value} / 100"
        f" when {unit} is null or {unit} = 'm' then {value} end"
        f" when {quantity} = 'area' then if({unit} is null or {unit} = 'm²', {value}, null) else {value} end"
    )


def norm_rule_type(normalised: str) -> str:
    """SQL text over a normalised header text; '' when no type was given."""
    key = f"replace(coalesce({normalised}, ''), ' ', '_')"
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in RULE_TYPES.items())
    return f"case {key} {cases} else {key} end"


def normalize_rows(rows: DataFrame) -> DataFrame:
    """Typed requirement, errors, warnings and status of every import row.

    Input: file, source_row, the canonical fields as text columns, and optionally derived (array),
    formula_errors (array), status_override. All checks are narrow expressions over one scan.
    """
    have = set(rows.columns)
    for name, default in (("derived", "cast(array() as array<string>)"), ("formula_errors", "cast(array() as array<string>)"), ("status_override", "cast(null as string)")):
        if name not in have:
            rows = rows.withColumn(name, F.expr(default))
    for field in ALIASES:
        if field not in have:
            rows = rows.withColumn(field, F.lit(None).cast("string"))
    keep = [c for c in rows.columns if c not in ALIASES]
    known = "array(" + ", ".join(f"'{f}'" for f in ALIASES) + ")"
    executable = "('minimum_room_area', 'minimum_door_width_for_room_type', 'room_has_connected_door', 'composite_room_rule')"
    staged = norm_headers(rows.withColumn("_t", F.coalesce("type", F.lit(""))), "_t", "_tn")
    staged = staged.selectExpr(
        *keep, *[f"{f} as raw_{f}" for f in ALIASES], *[f"{clean(f)} as {f}" for f in ALIASES], f"{norm_rule_type('_tn')} as _raw"
    )
    staged = staged.selectExpr(
        "*", f"if(_raw in {executable}, _raw, 'textual_requirement') as _type", f"{norm_unit('unit')} as _unit", "lower(quantity_type) as _declared",
        f"""array_distinct(concat(derived, filter(transform(coalesce(split(derived_fields, '[;,]'), array()), x -> trim(x)), x -> array_contains({known}, x)))) as _derived""",
        "coalesce(lower(severity), 'warning') as _sev", f"if(_raw = 'composite_room_rule', from_json(conditions_json, '{CONDITIONS_JSON}'), null) as _cond",
    ).withColumn("_qty", F.expr(f"if(_declared in {sql_in(QUANTITY_TYPES)}, _declared, {infer_quantity('_type', '_unit')})"))
    # One stage per step: each intermediate text is computed once per row.
    bounds = {"_min": "minimum", "_max": "maximum"}
    for step in (compact, point_decimal, plain_number):
        staged = staged.withColumns({k: F.expr(step(v)) for k, v in bounds.items()})
        bounds = {k: k for k in bounds}
    staged = staged.withColumns({k: F.expr(to_canonical(k, "_unit", "_qty")) for k in bounds})
    ranged, area, width, comp = (
        "_type in ('minimum_room_area', 'minimum_door_width_for_room_type')", "_type = 'minimum_room_area'",
        "_type = 'minimum_door_width_for_room_type'", "_type = 'composite_room_rule'",
    )
    low = "coalesce(c.minAreaSqm, c.minDoorWidthM)"
    high = "coalesce(c.maxAreaSqm, c.maxDoorWidthM)"
    rules = [
        ("id is null", "'Requirement ID is required.'"),
        ("title is null", "'Title is required.'"),
        (f"_declared is not null and _declared not in {sql_in(QUANTITY_TYPES)}", "concat(\"Unsupported quantity type '\", _declared, \"'.\")"),
        ("minimum is not null and _min is null", "'Minimum value or unit is invalid for the selected quantity type.'"),
        ("maximum is not null and _max is null", "'Maximum value or unit is invalid for the selected quantity type.'"),
        ("(source_document is null) <> (source_section is null)", "'Source document and source section must be supplied together.'"),
        (f"{comp} and _cond is null", "'Composite conditions must be valid JSON.'"),
        (f"({ranged} or {comp}) and coalesce(target_type, 'unknown') not in {sql_in(ROOM_TYPES)}", "'roomType: Unknown room type'"),
        (f"{ranged} and minimum is null", "'minimum: Required'"),
        (f"{ranged} and _min <= 0", "'minimum: Number must be greater than 0'"),
        (f"{ranged} and _max <= 0", "'maximum: Number must be greater than 0'"),
        (f"{width} and lower(quantifier) not in ('any', 'all')", "'quantifier: Expected any or all'"),
        (f"{area} and _qty <> 'area'", "\"quantityType: Room area rules require quantityType 'area'\""),
        (f"{area} and _unit not in {sql_in(AREA_UNITS)}", "'unit: Room area rules require an area unit'"),
        (f"{width} and _qty <> 'length'", "\"quantityType: Door width rules require quantityType 'length'\""),
        (f"{width} and _unit not in {sql_in(LENGTH_UNITS)}", "'unit: Door width rules require a length unit'"),
        (f"{area} and _max < _min", "'maxAreaSqm: Maximum room area must be greater than or equal to minimum room area'"),
        (f"{width} and _max < _min", "'maxDoorWidthM: Maximum door width must be greater than or equal to minimum door width'"),
        (f"{comp} and coalesce(lower(operator), '') not in ('and', 'or')", "'operator: Expected and or or'"),
        (f"{comp} and _cond is not null and size(_cond) not between 2 and 10", "'conditions: Composite rules need 2 to 10 conditions'"),
        (f"{comp} and exists(_cond, c -> coalesce({low}, 0) <= 0 or {high} <= 0 or coalesce(c.type, '') not in ('room_area_range', 'connected_door_width_range'))", "'conditions: Invalid condition'"),
        (f"{comp} and exists(_cond, c -> {high} < {low})", "'conditions: Condition maximum must be greater than or equal to its minimum'"),
    ]
    errors = "array_compact(array(" + ", ".join(f"if({c}, {m}, null)" for c, m in rules) + "))"
    warnings = f"""array_compact(array(
        if(size(_derived) > 0, concat('Formula-derived values may be stale: ', array_join(_derived, ', '), '.'), null),
        if(_raw <> '' and _type = 'textual_requirement' and _raw <> 'textual_requirement', concat("Unknown rule type '", raw_type, "' was preserved as a textual requirement."), null),
        if(_raw = '', 'No executable rule type was supplied.', null),
        if(_sev not in {sql_in(SEVERITIES)}, concat("Unknown severity '", raw_severity, "' defaulted to warning."), null)))"""
    status = """case when _type <> 'textual_requirement' then 'ready_for_validation' when status_override in ('informational', 'valid_requirement') then status_override
        when lower(type) = 'informational' then 'informational' else 'requires_rule_configuration' end"""
    out = staged.selectExpr(
        *[c for c in keep if c not in ("derived", "formula_errors", "status_override")],
        "coalesce(id, '') as requirement_id", "coalesce(title, '') as title_text", "_type as rule_type",
        f"if(_sev in {sql_in(SEVERITIES)}, _sev, 'warning') as severity_text",
        "_unit as unit_text", "_qty as quantity_text", "_min as min_value", "_max as max_value", "_derived as derived_all",
        f"{status} as status", f"array_distinct(concat({errors}, formula_errors)) as errors", f"array_distinct({warnings}) as warnings",
        "struct(" + ", ".join(f"raw_{f} as {f}" for f in ALIASES) + ") as raw",
    )
    return out.withColumns({"included": F.lit(True), "exclusion_reason": F.lit(None).cast("string"), "reviewed": F.size("warnings") == 0})


def exclude_empty(rows: DataFrame, empty: str = "empty") -> DataFrame:
    """Blank sheet rows are kept as excluded rows with their reason."""
    return rows.withColumns(
        {
            "included": F.expr(f"included and not {empty}"), "status": F.expr(f"if({empty}, 'excluded', status)"),
            "exclusion_reason": F.expr(f"if({empty}, 'empty', exclusion_reason)"),
        }
    )


def finalize_package(rows: DataFrame) -> DataFrame:
    """(file, source_row, message): reasons why a file's package cannot be stored. No rows = it can.

    What the three parts read is written once, so rows are normalised once and no filter is pushed into the row checks, where it would
    repeat their nested expressions many times over."""
    rows = stored(rows.select("file", "source_row", "requirement_id", "errors", "warnings", "included", "exclusion_reason", "reviewed"))
    per_row = rows.selectExpr(
        "file", "source_row",
        """explode(array_compact(array(
            if(not included and exclusion_reason is null, concat('Row ', source_row, ': excluded rows require a reason.'), null),
            if(included and size(errors) > 0, concat('Row ', source_row, ': ', array_join(errors, ' ')), null),
            if(included and size(warnings) > 0 and not reviewed, concat('Row ', source_row, ': warnings must be explicitly reviewed.'), null)))) as message""",
    )
    none = "cast(null as bigint) as source_row"
    live = rows.where("included and size(errors) = 0 and requirement_id <> ''").selectExpr("file", "requirement_id", "source_row")
    dup = repeats_after_first(live, ["file", "requirement_id"], ["source_row"]).select("file", "requirement_id").distinct().selectExpr(
        "file", none, "concat('Duplicate requirement ID: ', requirement_id) as message"
    )
    empty = (
        rows.groupBy("file").agg(F.count_if("included").alias("n")).where("n = 0")
        .selectExpr("file", none, "'At least one included requirement is required.' as message")
    )
    return per_row.selectExpr("file", "cast(source_row as bigint) as source_row", "message").unionByName(dup).unionByName(empty)


def apply_row_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Raw rows with edits (file, source_row, field, value, seq) put in; the last edit of a field wins.
    Follow with `normalize_rows`; edited rows come back unreviewed."""
    final = latest(edits, ["file", "source_row", "field"], [F.col("seq")])
    packed = final.groupBy("file", "source_row").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_e"))
    joined = rows.join(packed, ["file", "source_row"], "left")
    return joined.selectExpr(
        *[c for c in rows.columns if c not in ALIASES],
        *[f"coalesce(try_element_at(_e, '{f}'), {f}) as {f}" for f in ALIASES if f in rows.columns],
        "_e is not null as edited",
    )


def set_status(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """Raw rows with a status (file, source_row, status, seq) asked for; the last one of a row wins. Follow with `normalize_rows`: a textual
    requirement takes the status if it is one of a text's, and the row comes back included and unreviewed, whatever it was before."""
    final = latest(statuses, ["file", "source_row"], [F.col("seq")]).select("file", "source_row", F.col("status").alias("_s"))
    joined = rows.join(final, ["file", "source_row"], "left")
    asked = F.coalesce("_s", "status_override") if "status_override" in rows.columns else F.col("_s")
    return joined.withColumns({"status_override": asked, "edited": F.col("_s").isNotNull()}).drop("_s")


def toggle_included(rows: DataFrame, toggles: DataFrame) -> DataFrame:
    """Flip rows (file, source_row): included rows are excluded by the user, excluded ones come back."""
    t = toggles.select("file", "source_row").distinct().withColumn("_t", F.lit(True))
    joined = rows.join(t, ["file", "source_row"], "left")
    changed = {
        "included": "if(_t is null, included, not included)", "status": "if(_t is not null and included, 'excluded', status)",
        "exclusion_reason": "case when _t is null then exclusion_reason when included then coalesce(exclusion_reason, 'excluded_by_user') end",
    }
    return joined.selectExpr(*[f"{changed[c]} as {c}" if c in changed else c for c in rows.columns])


IMPORT_FILTERS = {
    "errors": "included and size(errors) > 0", "warnings": "included and size(warnings) > 0", "excluded": "not included", "all": "true",
}


def import_counts(rows: DataFrame) -> DataFrame:
    """valid / warning / blocked / excluded rows per file."""
    n = lambda c: F.count_if(F.expr(c))
    return rows.groupBy("file").agg(
        n("included and size(errors) = 0 and size(warnings) = 0").alias("valid"), n("included and size(errors) = 0 and size(warnings) > 0").alias("warning"),
        n("included and size(errors) > 0").alias("blocked"), n("not included").alias("excluded"),
    )


def route_csv_fields(records: DataFrame) -> DataFrame:
    """CSV columns to canonical fields: room type else element type; area bounds for area rules, else door bounds or plain ones."""
    have = set(records.columns)
    col = lambda c: f"nullif({c}, '')" if c in have else "cast(null as string)"
    area = "type = 'minimum_room_area'"
    special = {
        "target_type": f"coalesce({col('room_type')}, {col('element_type')})",
        "minimum": f"if({area}, {col('min_area_sqm')}, coalesce({col('min_door_width_m')}, {col('minimum')}))",
        "maximum": f"if({area}, {col('max_area_sqm')}, coalesce({col('max_door_width_m')}, {col('maximum')}))",
    }
    return records.selectExpr("file", "source_row", *[f"{special.get(f, col(f))} as {f}" for f in ALIASES])
