"""Exports. Reports are emitted as ordered rows, so a run of any size is written by many tasks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelgauge.functions.columns import fmt_num_sql
from modelgauge.functions.jsontext import EVIDENCE_JSON, csv_line
from modelgauge.functions.skew import salted_join

FINDING_HEADERS = (
    "run_id", "requirement_id", "rule_id", "status", "severity", "element_type", "affected_element_ids", "summary", "evidence",
)
SPEC_HEADERS = (
    "id", "title", "description", "discipline", "type", "severity", "target_type", "minimum", "maximum", "unit", "quantity_type",
    "source_document", "source_section", "source_revision", "notes", "derived_fields", "quantifier", "operator", "conditions_json",
    "specification_name", "specification_revision",
)


def findings_csv(findings: DataFrame) -> DataFrame:
    """(run_id, req_pos, element_pos, line): one CSV line per finding."""
    flat = findings.select(
        "run_id", "requirement_id", "rule_id", "status", "severity", "element_type",
        F.array_join("affected_element_ids", ";").alias("affected_element_ids"),
        "summary", F.expr(EVIDENCE_JSON).alias("evidence"), "req_pos", "element_pos",
    )
    return flat.select("run_id", "req_pos", "element_pos", csv_line(*FINDING_HEADERS).alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str], partition: str = "run_id") -> None:
    """Text files per partition value, CRLF line ends, each file ordered; rows are range-partitioned
    by (partition, order), so a large run becomes several consecutive files."""
    (
        lines.repartitionByRange(partition, *order)
        .sortWithinPartitions(partition, *order)
        .select(partition, "line")
        .write.mode("overwrite")
        .partitionBy(partition)
        .option("lineSep", "\r\n")
        .text(path)
    )


def findings_sarif(findings: DataFrame, req: DataFrame) -> DataFrame:
    """SARIF-shaped result rows of the failed and unknown findings."""
    problems = findings.where(F.col("status").isin("fail", "unknown"))
    source = req.select("run_id", "requirement_id", F.col("source").alias("_s"))
    level = (
        F.when(F.col("status") == "unknown", "note")
        .when(F.col("severity") == "critical", "error")
        .when(F.col("severity") == "warning", "warning")
        .otherwise("note")
    )
    return salted_join(problems, source, ["run_id", "requirement_id"], ["element_pos"], how="left").select(
        "run_id", "requirement_id", "rule_id", level.alias("level"), F.col("summary").alias("message"),
        F.expr(
            "transform(affected_element_ids, i -> named_struct('name', i, 'fullyQualifiedName', concat(element_type, ':', i), 'kind', element_type))"
        ).alias("logical_locations"),
        "affected_element_ids", "evidence",
        F.col("_s.document").alias("source_document"), F.col("_s.section").alias("source_section"),
        F.col("_s.revision").alias("source_revision"), "req_pos", "element_pos",
    )


def sarif_rules(findings: DataFrame, req: DataFrame) -> DataFrame:
    """Rule catalogue per run: the last problem finding describes the rule, the first gives its position."""
    order = F.struct("req_pos", "element_pos")
    rules = (
        findings.where(F.col("status").isin("fail", "unknown"))
        .groupBy("run_id", "rule_id")
        .agg(
            F.max_by(F.struct("requirement_id", "requirement_title", "summary", "severity"), order).alias("l"),
            F.min(order).alias("f"),
        )
    )
    facts = req.select("run_id", "requirement_id", F.col("title").alias("_title"), F.col("description").alias("_description"), F.col("source").alias("_source"))
    flat = rules.select("run_id", "rule_id", "f", "l.*")
    return flat.join(facts, ["run_id", "requirement_id"], "left").select(
        "run_id", "rule_id",
        F.coalesce("_title", "requirement_title").alias("name"),
        F.coalesce("_description", "summary").alias("full_description"),
        "requirement_id", "severity",
        F.col("_source.document").alias("source_document"),
        F.col("f.req_pos").alias("first_req_pos"), F.col("f.element_pos").alias("first_element_pos"),
    )


def _display_number(x: str) -> str:
    scaled = f"case when quantity_type = 'length' and unit = 'mm' then {x} * 1000 when quantity_type = 'length' and unit = 'cm' then {x} * 100 else {x} end"
    return f"coalesce({fmt_num_sql('(' + scaled + ')')}, '')"


def _condition_json() -> str:
    def bounds(low: str, high: str) -> str:
        return f"""concat(',"{low}":', {fmt_num_sql('c.min')}, if(c.max is null, '', concat(',"{high}":', {fmt_num_sql('c.max')})))"""

    return f"""coalesce(concat('[', array_join(transform(conditions, c -> concat('{{"type":"', c.type, '"',
        if(c.type = 'room_area_range', {bounds('minAreaSqm', 'maxAreaSqm')}, {bounds('minDoorWidthM', 'maxDoorWidthM')}),
        if(c.quantifier is null, '', concat(',"quantifier":"', c.quantifier, '"')), '}}')), ','), ']'), '')"""


def spec_to_flat(req: DataFrame, packages: DataFrame) -> DataFrame:
    """Canonical 21-field rows; thresholds are converted back to the declared unit."""
    named = req.join(packages.selectExpr("spec_id", "name as specification_name", "revision as specification_revision"), "spec_id")
    blank = lambda c, name=None: f"coalesce({c}, '') as {name or c}"
    return named.selectExpr(
        "spec_id", "pos", "requirement_id as id", "title", blank("description"), blank("discipline"), "type", "severity", blank("room_type", "target_type"),
        f"{_display_number('min_value')} as minimum", f"{_display_number('max_value')} as maximum", blank("unit"), blank("quantity_type"),
        blank("source.document", "source_document"), blank("source.section", "source_section"), blank("source.revision", "source_revision"),
        "'' as notes", "'' as derived_fields", blank("quantifier"), blank("operator"), f"{_condition_json()} as conditions_json",
        "specification_name", "specification_revision",
    )


def findings_sheet(findings: DataFrame, req: DataFrame) -> DataFrame:
    titles = req.select("run_id", "requirement_id", F.col("title").alias("_t"))
    return salted_join(findings, titles, ["run_id", "requirement_id"], ["element_pos"], how="left").select(
        "run_id", "requirement_id", F.coalesce("_t", "requirement_title").alias("title"), "rule_id", "status", "severity", "element_type",
        F.array_join("affected_element_ids", "; ").alias("affected_element_ids"), "summary",
        F.expr("array_join(transform(evidence, e -> e.message), ' | ')").alias("evidence_messages"),
        "req_pos", "element_pos",
    )


def report_lines(
    runs: DataFrame, metrics: DataFrame, inventory: DataFrame, packages: DataFrame, outcomes: DataFrame, req: DataFrame, findings: DataFrame
) -> DataFrame:
    """Markdown report as rows (run_id, section, pos1, pos2, line_no, text); order by them to read it.

    The breakdown number is the requirement's rank in its package (at most 1,000 rows per window).
    """
    pct = lambda c: f"coalesce(concat({c}, '%'), 'n/a')"
    head = (
        runs.select("run_id", "model_id", "spec_id")
        .join(metrics, "run_id")
        .join(inventory, "model_id")
        .join(packages.selectExpr("spec_id", "name", "revision"), "spec_id")
    )
    overview = head.selectExpr(
        "run_id", "0 as section", "cast(0 as bigint) as pos1", "cast(0 as bigint) as pos2",
        f"""posexplode(array('# Building Compliance Report',
            concat('Requirement Pass Rate: ', {pct('pass_rate')}, ' (', compliant, ' Compliant / ', violated, ' Violated among determined requirements)'),
            concat('Evaluation Coverage: ', {pct('coverage')}, ' (', determined, ' Determined / ', applicable, ' Applicable)'),
            concat('Critical Failed Requirements: ', critical_failures), concat('Not Applicable Requirements: ', not_applicable),
            '## Overview Metrics', concat('- Total Rooms Inspected: ', rooms), concat('- Total Access Doors Inspected: ', doors),
            concat('- Spatial Storeys (Levels): ', levels), concat('- Total Evaluated Rule Specifications: ', requirement_count),
            concat('- Specification: ', name), concat('- Specification Revision: ', revision))) as (line_no, text)""",
    )
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("req_pos"))
    source = req.selectExpr(
        "run_id", "requirement_id",
        "coalesce(concat(' — Source: ', source.document, ', ', source.section, coalesce(concat(', rev. ', source.revision), '')), '') as _src",
    )
    breakdown = (
        outcomes.withColumn("_n", rank)
        .join(source, ["run_id", "requirement_id"])
        .selectExpr(
            "run_id", "1 as section", "req_pos as pos1", "cast(0 as bigint) as pos2", "0 as line_no",
            "concat(_n, '. [', replace(upper(outcome), '_', ' '), '] **', title, '** (Severity: ', severity, ')', _src) as text",
        )
    )
    evidence = """concat(array(concat('### [', upper(status), '] ', requirement_title), concat('- Requirement ID: `', requirement_id, '`'),
        concat('- Severity Level: **', severity, '**'), concat('- Element Type: **', element_type, '**'),
        concat('- Affected Elements: ', if(size(affected_element_ids) > 0, array_join(affected_element_ids, ', '), 'None')),
        concat('- Summary Record: ', summary), '- Structured Evidence Logs:'),
        transform(evidence, e -> concat('  - *', e.message, '* (Field: ', coalesce(e.field, 'N/A'), ' | Observed: ', coalesce(e.observed, 'null'),
            ' | Expected: ', coalesce(e.expected, 'n/a'), ')')))"""
    details = findings.selectExpr(
        "run_id", "2 as section", "req_pos as pos1", "element_pos as pos2", f"posexplode({evidence}) as (line_no, text)"
    )
    return overview.unionByName(breakdown).unionByName(details)


# Wording of the run summary, as of the report lines, CSV headers and sheet fields above.
ROLE_TITLE = {"Design Engineer": "Technical summary", "Stockroom Personnel": "Operational summary"}
ROLE_TAIL = {
    "Stockroom Personnel": "- Guidance: Use spaces cautiously where failures or unknowns exist.",
    "Project Manager": "- Follow-up priority: resolve critical failures first, then close unknown data gaps.",
}
DEFAULT_TAIL = "- Action: Reference requirement IDs and element IDs when planning corrective action."
GUARDRAIL = "- I cannot determine that from the available model evidence."


#: Fixed value: words of a question that ask for what the evidence may not hold.
DOUBT = "cannot determine|unknown|missing|insufficient|not sure"


def run_summary(findings: DataFrame, role: str, question: str = "") -> DataFrame:
    """Role-specific summary as rows (run_id, line_no, pos1, pos2, pos3, text).

    Lists (critical failures, unknown element ids) have a lead row and one row per entry under the next line number, so no run's ids
    are gathered into one value; written out, entries of line 4 are joined by "; " and of line 6 by ", ", each list ends with a full stop.
    The guardrail stands if something is unknown or the question asks for doubtful evidence.
    """
    counts = findings.groupBy("run_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "fail", "unknown")],
        F.count_if((F.col("status") == "fail") & (F.col("severity") == "critical")).alias("n_critical"),
    )
    title, tail = ROLE_TITLE.get(role, "Project status summary"), ROLE_TAIL.get(role, DEFAULT_TAIL)
    zero = "cast(0 as bigint)"
    doubt = "true" if re.search(DOUBT, question, re.IGNORECASE) else "false"
    fixed = counts.selectExpr(
        "run_id",
        f"""inline(array_compact(array(
            struct(1 as line_no, '**{title}**' as text),
            struct(2 as line_no, concat('- Results: ', n_pass, ' pass, ', n_fail, ' fail, ', n_unknown, ' unknown.') as text),
            struct(3 as line_no, if(n_critical = 0, '- Critical failures: none in current deterministic results.', '- Critical failures:') as text),
            if(n_unknown > 0, struct(5 as line_no, '- Unknown follow-up:' as text), null),
            if(n_unknown > 0, struct(7 as line_no, '- Unknowns remain unknown until missing parameters or relationships are provided.' as text), null),
            if(n_unknown > 0 or {doubt}, struct(8 as line_no, '{GUARDRAIL}' as text), null),
            struct(9 as line_no, '{tail}' as text))))""",
    ).selectExpr("run_id", "line_no", f"{zero} as pos1", f"{zero} as pos2", f"{zero} as pos3", "text")
    critical = findings.where("status = 'fail' and severity = 'critical'").selectExpr(
        "run_id", "4 as line_no", "req_pos as pos1", "element_pos as pos2", f"{zero} as pos3",
        "concat(requirement_id, ' (', array_join(affected_element_ids, ', '), ')') as text",
    )
    unknown = (
        findings.where("status = 'unknown'")
        .selectExpr("run_id", "req_pos", "element_pos", "posexplode(affected_element_ids) as (i, element_id)")
        .groupBy("run_id", "element_id")
        .agg(F.min(F.struct("req_pos", "element_pos", "i")).alias("o"))
        .selectExpr("run_id", "6 as line_no", "o.req_pos as pos1", "o.element_pos as pos2", "cast(o.i as bigint) as pos3", "element_id as text")
    )
    return fixed.unionByName(critical).unionByName(unknown)


def export_owner(projects: DataFrame, tables: dict[str, DataFrame], memberships: DataFrame) -> DataFrame:
    """(user_id, kind, project_id, record): every stored row of each owner's projects as JSON, and each user's own memberships
    (user_id, project_id, role) in whosever projects.

    Tables carry project_id; binary columns must already be hashes. Write partitioned by user_id.
    """
    owned = projects.select(F.col("owner_id").alias("user_id"), "project_id")
    out = projects.select(F.col("owner_id").alias("user_id"), F.lit("project").alias("kind"), "project_id", F.to_json(F.struct(*projects.columns)).alias("record"))
    for kind, df in tables.items():
        rows = df.join(owned, "project_id").select("user_id", F.lit(kind).alias("kind"), "project_id", F.to_json(F.struct(*df.columns)).alias("record"))
        out = out.unionByName(rows)
    own = memberships.select("user_id", F.lit("membership").alias("kind"), "project_id", F.to_json(F.struct(*(c for c in memberships.columns if c != "user_id"))).alias("record"))
    return out.unionByName(own)
