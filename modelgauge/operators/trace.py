"""Traceability: clause -> requirement -> findings -> review, per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgauge.functions.columns import iso_ts, percent
from modelgauge.functions.skew import salted_join
from modelgauge.operators.metrics import outcomes

EXECUTABLE_TYPES = (
    "minimum_room_area",
    "minimum_door_width_for_room_type",
    "room_has_connected_door",
    "composite_room_rule",
)
GAPS = ("uncovered", "no_executable_rule", "unknown_outcome", "finding_without_review", "waived")
NO_DOCUMENT = "No source document"
UNASSIGNED = "Unassigned"


def location_label(anchor: Column) -> Column:
    """Human location of a fragment anchor; stored indexes are 0-based, labels 1-based."""
    one = lambda f: (anchor[f] + 1).cast("string")
    return (
        F.when(
            anchor["kind"].isin("pdf_text_block", "pdf_table_cell"),
            F.concat(F.lit("PDF page "), anchor["page_number"].cast("string")),
        )
        .when(
            anchor["kind"] == "table_cell",
            F.concat(
                F.lit("DOCX table "), one("table_index"), F.lit(", row "), one("row_index"), F.lit(", cell "), one("cell_index")
            ),
        )
        .otherwise(F.concat(F.lit("DOCX paragraph "), one("paragraph_index")))
    )


def resolve_clauses(req: DataFrame, fragments: DataFrame) -> DataFrame:
    """Clause text and location per (spec, requirement) from its fragment ids; unknown ids are dropped.

    `fragments`: spec_id, fragment_id, exact_text, anchor.
    """
    wanted = req.select("spec_id", "requirement_id", F.posexplode("source_fragment_ids").alias("_i", "fragment_id"))
    found = fragments.select(
        "spec_id", "fragment_id", F.col("exact_text").alias("_text"), location_label(F.col("anchor")).alias("_where")
    )
    ordered = (
        wanted.join(found, ["spec_id", "fragment_id"])
        .groupBy("spec_id", "requirement_id")
        .agg(F.array_sort(F.collect_list(F.struct("_i", "_text", "_where"))).alias("_c"))
    )
    return ordered.select(
        "spec_id",
        "requirement_id",
        F.array_join(F.transform("_c", lambda c: c["_text"]), "\n\n").alias("source_clause_text"),
        F.array_join(F.transform("_c", lambda c: c["_where"]), "; ").alias("source_clause_location"),
    )


def traceability(
    req: DataFrame, findings: DataFrame, reviews: DataFrame, fragments: DataFrame | None = None
) -> DataFrame:
    """One row per (run, requirement) with outcome, review, source fields and the five gap flags.

    Findings stay in their own table (join on run_id, requirement_id); a row never holds them all.
    """
    out = outcomes(req, findings).select("run_id", "requirement_id", "outcome", "n_results")
    source = req.select(
        "run_id", "spec_id", "requirement_id", "title", "severity", "type",
        F.col("pos").alias("req_pos"),
        F.coalesce("discipline", F.lit(UNASSIGNED)).alias("discipline"),
        F.coalesce("source.document", F.lit("")).alias("source_document"),
        F.coalesce("source.section", F.lit("")).alias("source_section"),
        F.coalesce("source.revision", F.lit("")).alias("source_revision"),
        F.coalesce("source_fragment_ids", F.array().cast("array<string>")).alias("source_fragment_ids"),
    )
    current = reviews.select(
        "run_id", "requirement_id",
        F.col("status").alias("review_status"),
        F.col("comment").alias("review_comment"),
        F.col("decided_at").alias("review_updated_at"),
    )
    rows = source.join(out, ["run_id", "requirement_id"]).join(current, ["run_id", "requirement_id"], "left")
    if fragments is None:
        none = F.lit(None).cast("string")
        rows = rows.withColumn("source_clause_text", none).withColumn("source_clause_location", none)
    else:
        specs = req.select("spec_id", "requirement_id", "source_fragment_ids").dropDuplicates(["spec_id", "requirement_id"])
        rows = rows.join(resolve_clauses(specs, fragments), ["spec_id", "requirement_id"], "left")
    needs = F.col("outcome").isin("violation", "unknown")
    decided = F.col("review_status").isNotNull() & (F.col("review_status") != "open")
    executable = F.col("type").isin(*EXECUTABLE_TYPES)
    return (
        rows.withColumn("source_resolved", F.col("source_clause_text").isNotNull())
        .withColumn(
            "has_source_metadata",
            ((F.col("source_document") != "") & (F.col("source_section") != "")) | (F.size("source_fragment_ids") > 0),
        )
        .withColumn("has_executable_rule", executable)
        .withColumn("needs_review", needs)
        .withColumn("gap_uncovered", F.col("n_results") == 0)
        .withColumn("gap_no_executable_rule", ~executable)
        .withColumn("gap_unknown_outcome", F.col("outcome") == "unknown")
        .withColumn("gap_finding_without_review", needs & ~decided)
        .withColumn("gap_waived", F.coalesce(F.col("review_status") == "waived", F.lit(False)))
    )


_METRICS = (
    # name, label, numerator, denominator
    ("extraction_coverage", "Extraction coverage", "n_source", "n"),
    ("rule_coverage", "Rule coverage", "n_rule", "n"),
    ("evaluation_coverage", "Evaluation coverage", "n_determined", "n_applicable"),
    ("pass_rate", "Pass rate", "n_compliant", "n_determined"),
    ("review_completion", "Review completion", "n_reviewed", "n_needs"),
    ("source_traceability_coverage", "Source traceability coverage", "n_resolved", "n"),
)


def coverage_metrics(rows: DataFrame) -> DataFrame:
    """The six separate coverage metrics of each run, one row each, in fixed order."""
    determined = F.col("outcome").isin("compliant", "violation")
    base = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("has_source_metadata").alias("n_source"),
        F.count_if("has_executable_rule").alias("n_rule"),
        F.count_if(determined).alias("n_determined"),
        F.count_if(F.col("outcome") != "not_applicable").alias("n_applicable"),
        F.count_if(F.col("outcome") == "compliant").alias("n_compliant"),
        F.count_if(F.col("needs_review") & ~F.col("gap_finding_without_review")).alias("n_reviewed"),
        F.count_if("needs_review").alias("n_needs"),
        F.count_if("source_resolved").alias("n_resolved"),
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("metric_pos"), F.lit(name).alias("metric"), F.lit(label).alias("label"),
                F.col(num).alias("numerator"), F.col(den).alias("denominator"),
            )
            for i, (name, label, num, den) in enumerate(_METRICS)
        ]
    )
    return base.select("run_id", F.inline(entries)).withColumn(
        "percent", percent(F.col("numerator"), F.col("denominator"))
    )


def coverage_by(rows: DataFrame) -> DataFrame:
    """Coverage groups by document and by discipline, in one pass (grouping sets)."""
    keyed = rows.select(
        "run_id",
        F.when(F.col("source_document") == "", NO_DOCUMENT).otherwise(F.col("source_document")).alias("document"),
        F.when(F.col("discipline") == "", UNASSIGNED).otherwise(F.col("discipline")).alias("discipline"),
        "has_executable_rule", "outcome", "gap_finding_without_review",
    )
    grouped = keyed.groupingSets(
        [["run_id", "document"], ["run_id", "discipline"]], "run_id", "document", "discipline"
    ).agg(
        F.grouping("document").alias("_by_discipline"),
        F.count(F.lit(1)).alias("requirement_count"),
        F.count_if("has_executable_rule").alias("with_rule"),
        F.count_if(F.col("outcome").isin("compliant", "violation")).alias("determined"),
        F.count_if(F.col("outcome") == "compliant").alias("compliant"),
        F.count_if("gap_finding_without_review").alias("unreviewed_findings"),
    )
    return grouped.select(
        "run_id",
        F.when(F.col("_by_discipline") == 1, "discipline").otherwise("document").alias("group_kind"),
        F.when(F.col("_by_discipline") == 1, F.col("discipline")).otherwise(F.col("document")).alias("group_key"),
        "requirement_count", "with_rule", "determined", "compliant", "unreviewed_findings",
    )


def filter_traceability(
    rows: DataFrame,
    document: str | None = None,
    discipline: str | None = None,
    severity: str | None = None,
    gap: str | None = None,
) -> DataFrame:
    out = rows
    if document:
        name = F.when(F.col("source_document") == "", NO_DOCUMENT).otherwise(F.col("source_document"))
        out = out.where(name == document)
    if discipline:
        out = out.where(F.col("discipline") == discipline)
    if severity:
        out = out.where(F.col("severity") == severity)
    if gap:
        out = out.where(F.col(f"gap_{gap}"))
    return out


def traceability_facets(rows: DataFrame) -> DataFrame:
    """Values offered per filter with their row counts, and the count of each gap."""
    doc = F.when(F.col("source_document") == "", NO_DOCUMENT).otherwise(F.col("source_document"))
    facets = F.array(
        F.struct(F.lit("document").alias("facet"), doc.alias("value"), F.lit(True).alias("hit")),
        F.struct(F.lit("discipline").alias("facet"), F.col("discipline").alias("value"), F.lit(True).alias("hit")),
        *[F.struct(F.lit("gap").alias("facet"), F.lit(g).alias("value"), F.col(f"gap_{g}").alias("hit")) for g in GAPS],
    )
    return (
        rows.select("run_id", F.inline(facets))
        .groupBy("run_id", "facet", "value")
        .agg(F.count_if("hit").alias("n"))
    )


FLAT_COLUMNS = (
    "requirement_id", "title", "discipline", "severity", "requirement_type", "source_document",
    "source_section", "source_revision", "source_fragment_ids", "source_clause_location",
    "source_resolved", "has_executable_rule", "outcome", "rule_id", "element_type", "finding_status",
    "finding_summary", "affected_element_ids", "evidence_count", "review_status", "review_comment",
    "review_updated_at",
)


def traceability_flat(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Export lines: one per finding, one with evidence_count "0" for a requirement without findings."""
    detail = findings.select(
        "run_id", "requirement_id", "rule_id", "element_type",
        F.col("status").alias("finding_status"),
        F.col("summary").alias("finding_summary"),
        F.array_join("affected_element_ids", "; ").alias("affected_element_ids"),
        F.size("evidence").cast("string").alias("evidence_count"),
        "element_pos",
    )
    base = rows.select(
        "run_id", "requirement_id", "title", "discipline", "severity",
        F.col("type").alias("requirement_type"),
        "source_document", "source_section", "source_revision",
        F.array_join("source_fragment_ids", "; ").alias("source_fragment_ids"),
        F.coalesce("source_clause_location", F.lit("")).alias("source_clause_location"),
        F.col("source_resolved").cast("string").alias("source_resolved"),
        F.col("has_executable_rule").cast("string").alias("has_executable_rule"),
        "outcome", "req_pos",
        F.coalesce("review_status", F.lit("")).alias("review_status"),
        F.coalesce("review_comment", F.lit("")).alias("review_comment"),
        F.coalesce(iso_ts(F.col("review_updated_at")), F.lit("")).alias("review_updated_at"),
    )
    # A requirement with most of the findings is spread over many tasks; those without any are added.
    keys = ["run_id", "requirement_id"]
    bare = base.join(detail.select(*keys).distinct(), keys, "left_anti")
    joined = salted_join(detail, base, keys, ["element_pos"]).unionByName(bare, allowMissingColumns=True)
    blank = ["rule_id", "element_type", "finding_status", "finding_summary", "affected_element_ids"]
    return joined.fillna("", blank).fillna("0", ["evidence_count"]).select(
        "run_id", *FLAT_COLUMNS, "req_pos", F.coalesce("element_pos", F.lit(0)).alias("element_pos")
    )


def traceability_summary(rows: DataFrame) -> DataFrame:
    """Metric and coverage sheets as one tall table of text cells."""
    metric_rows = coverage_metrics(rows).select(
        "run_id", F.lit("Metrics").alias("sheet"), F.col("label").alias("name"), F.lit("").alias("group_kind"),
        F.concat_ws(
            "|", F.col("numerator").cast("string"), F.col("denominator").cast("string"),
            F.coalesce(F.col("percent").cast("string"), F.lit("n/a")),
        ).alias("cells"),
    )
    group_rows = coverage_by(rows).select(
        "run_id", F.lit("Coverage").alias("sheet"), F.col("group_key").alias("name"), "group_kind",
        F.concat_ws(
            "|", *[F.col(c).cast("string") for c in ("requirement_count", "with_rule", "determined", "compliant", "unreviewed_findings")]
        ).alias("cells"),
    )
    return metric_rows.unionByName(group_rows)
