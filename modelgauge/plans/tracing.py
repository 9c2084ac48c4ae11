"""Registered queries: traceability rows, coverage metrics, groups, filters and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelgauge.operators import trace as T
from modelgauge.operators.access import current_reviews
from modelgauge.plans.oracle import cte, pct
from modelgauge.plans.registry import query
from modelgauge.plans.validation import findings, run_req, statuses
from modelgauge.sources import testbed as tb

cte(
    "x_clause_frags",
    """SELECT 'spec-a' AS spec_id, 'frg-' || doc_id || '-0' AS fragment_id, string_split(text, chr(10))[1] AS exact_text, doc_id, doc_id % 3 AS k FROM documents""",
)


def clause_fragments(spark, d):
    """First line of every document as a clause fragment of package A, with the three anchor kinds."""
    return tb.table(spark, d, "documents").selectExpr(
        "'spec-a' as spec_id", "concat('frg-', doc_id, '-0') as fragment_id", "split(text, '\\n')[0] as exact_text",
        """named_struct('kind', element_at(array('pdf_text_block', 'table_cell', 'paragraph'), cast(doc_id % 3 + 1 as int)), 'page_number', doc_id % 7 + 1,
             'paragraph_index', doc_id, 'table_index', doc_id % 4, 'row_index', doc_id % 5, 'cell_index', doc_id % 6) as anchor""",
    )


_WHERE = """CASE k WHEN 0 THEN 'PDF page ' || (doc_id % 7 + 1) WHEN 1 THEN 'DOCX table ' || (doc_id % 4 + 1) || ', row ' || (doc_id % 5 + 1) || ', cell ' || (doc_id % 6 + 1)
  ELSE 'DOCX paragraph ' || (doc_id + 1) END"""
cte(
    "x_clauses",
    f"""SELECT q.spec_id, q.requirement_id, array_to_string(list(f.exact_text ORDER BY q.i), chr(10) || chr(10)) AS source_clause_text, array_to_string(list({_WHERE} ORDER BY q.i), '; ') AS source_clause_location
FROM (SELECT spec_id, requirement_id, unnest(fragment_ids) AS fragment_id, generate_subscripts(fragment_ids, 1) AS i FROM x_req WHERE fragment_ids IS NOT NULL) q
JOIN x_clause_frags f USING (spec_id, fragment_id) GROUP BY 1, 2""",
)
cte(
    "x_trace",
    """SELECT r.run_id, r.requirement_id, r.title, r.severity, r.type, r.pos AS req_pos, coalesce(r.discipline, 'Unassigned') AS discipline, coalesce(r.src_document, '') AS source_document,
  coalesce(r.src_section, '') AS source_section, coalesce(r.src_revision, '') AS source_revision, coalesce(array_to_string(r.fragment_ids, '; '), '') AS source_fragment_ids, o.outcome, o.n_results,
  c.status AS review_status, c.comment AS review_comment, c.decided_at AS review_updated_at, l.source_clause_text, l.source_clause_location, l.source_clause_text IS NOT NULL AS source_resolved,
  (r.src_document IS NOT NULL AND r.src_section IS NOT NULL) OR coalesce(len(r.fragment_ids), 0) > 0 AS has_source_metadata, r.type <> 'textual_requirement' AS has_executable_rule,
  o.outcome IN ('violation', 'unknown') AS needs_review, o.n_results = 0 AS gap_uncovered, r.type = 'textual_requirement' AS gap_no_executable_rule, o.outcome = 'unknown' AS gap_unknown_outcome,
  o.outcome IN ('violation', 'unknown') AND coalesce(c.status, 'open') = 'open' AS gap_finding_without_review, coalesce(c.status = 'waived', false) AS gap_waived
FROM x_run_req r JOIN x_outcomes o USING (run_id, requirement_id) LEFT JOIN x_current c USING (run_id, requirement_id) LEFT JOIN x_clauses l ON l.spec_id = r.spec_id AND l.requirement_id = r.requirement_id
WHERE r.v = 'a'""",
)
_COLS = (
    "run_id", "requirement_id", "title", "severity", "type", "discipline", "source_document", "source_section", "source_revision", "source_fragment_ids", "outcome", "n_results",
    "review_status", "review_comment", "source_clause_text", "source_clause_location", "source_resolved", "has_source_metadata", "has_executable_rule", "needs_review",
    "gap_uncovered", "gap_no_executable_rule", "gap_unknown_outcome", "gap_finding_without_review", "gap_waived",
)


def trace_rows(spark, d, f=None):
    return T.traceability(run_req(spark, d), f if f is not None else statuses(spark, d), current_reviews(tb.reviews_log(spark, d)), clause_fragments(spark, d))


@query("traceability_rows", f"SELECT {', '.join(_COLS)} FROM x_trace")
def _rows(spark, d):
    return trace_rows(spark, d).withColumn("source_fragment_ids", F.array_join("source_fragment_ids", "; ")).select(*_COLS)


@query(
    "resolve_clauses",
    f"""SELECT 'spec-a' AS spec_id, 'R-' || r AS requirement_id, array_to_string(list(exact_text ORDER BY i), chr(10) || chr(10)) AS source_clause_text, array_to_string(list({_WHERE} ORDER BY i), '; ') AS source_clause_location
FROM (SELECT doc_id AS r, unnest([doc_id + 1, doc_id, -1, doc_id * 2]) AS f, unnest([0, 1, 2, 3]) AS i FROM documents) q JOIN x_clause_frags f ON f.doc_id = q.f GROUP BY r""",
)
def _clauses(spark, d):
    """One requirement per document citing four fragments, some of them unknown."""
    req = tb.table(spark, d, "documents").selectExpr(
        "'spec-a' as spec_id", "concat('R-', doc_id) as requirement_id",
        "transform(array(doc_id + 1, doc_id, -1, doc_id * 2), i -> concat('frg-', i, '-0')) as source_fragment_ids",
    )
    return T.resolve_clauses(req, clause_fragments(spark, d))


@query("fragment_locations", f"SELECT fragment_id, {_WHERE} AS location FROM x_clause_frags")
def _locations(spark, d):
    return clause_fragments(spark, d).select("fragment_id", T.location_label(F.col("anchor")).alias("location"))


cte(
    "x_cov",
    "SELECT run_id, metric_pos, metric, label, numerator, denominator, " + pct("numerator", "denominator") + " AS percent FROM ("
    + " UNION ALL ".join(
        f"SELECT run_id, {i} AS metric_pos, '{m}' AS metric, '{label}' AS label, count(*) FILTER (WHERE {n}) AS numerator, count(*) FILTER (WHERE {dn}) AS denominator FROM x_trace GROUP BY run_id"
        for i, (m, label, n, dn) in enumerate([
            ("extraction_coverage", "Extraction coverage", "has_source_metadata", "true"),
            ("rule_coverage", "Rule coverage", "has_executable_rule", "true"),
            ("evaluation_coverage", "Evaluation coverage", "outcome IN ('compliant', 'violation')", "outcome <> 'not_applicable'"),
            ("pass_rate", "Pass rate", "outcome = 'compliant'", "outcome IN ('compliant', 'violation')"),
            ("review_completion", "Review completion", "needs_review AND NOT gap_finding_without_review", "needs_review"),
            ("source_traceability_coverage", "Source traceability coverage", "source_resolved", "true"),
        ])
    ) + ")",
)


@query("coverage_metrics", "SELECT * FROM x_cov")
def coverage_metrics(spark, d):
    return T.coverage_metrics(trace_rows(spark, d))


_DOC = "CASE WHEN source_document = '' THEN 'No source document' ELSE source_document END"
_DISC = "CASE WHEN discipline = '' THEN 'Unassigned' ELSE discipline END"
_GROUP = """SELECT run_id, '{kind}' AS group_kind, {key} AS group_key, count(*) AS requirement_count, count(*) FILTER (WHERE has_executable_rule) AS with_rule,
  count(*) FILTER (WHERE outcome IN ('compliant', 'violation')) AS determined, count(*) FILTER (WHERE outcome = 'compliant') AS compliant,
  count(*) FILTER (WHERE gap_finding_without_review) AS unreviewed_findings FROM x_trace GROUP BY ALL"""
cte("x_groups", _GROUP.format(kind="document", key=_DOC) + " UNION ALL " + _GROUP.format(kind="discipline", key=_DISC))


@query("coverage_groups", "SELECT * FROM x_groups")
def _groups(spark, d):
    return T.coverage_by(trace_rows(spark, d))


@query(
    "filter_traceability",
    "SELECT run_id, requirement_id, severity, outcome FROM x_trace WHERE source_document = '' AND severity = 'critical' AND gap_finding_without_review AND discipline = 'Architecture'",
)
def _filter(spark, d):
    rows = T.filter_traceability(trace_rows(spark, d), "No source document", "Architecture", "critical", "finding_without_review")
    return rows.select("run_id", "requirement_id", "severity", "outcome")


@query(
    "traceability_facets",
    f"""SELECT run_id, 'document' AS facet, {_DOC} AS value, count(*) AS n FROM x_trace GROUP BY ALL UNION ALL SELECT run_id, 'discipline', discipline, count(*) FROM x_trace GROUP BY ALL """
    + "".join(f" UNION ALL SELECT run_id, 'gap', '{g}', count(*) FILTER (WHERE gap_{g}) FROM x_trace GROUP BY ALL" for g in T.GAPS),
)
def _facets(spark, d):
    return T.traceability_facets(trace_rows(spark, d))


@query(
    "traceability_flat",
    """SELECT t.run_id, t.requirement_id, t.title, t.discipline, t.severity, t.type AS requirement_type, t.source_document, t.source_section, t.source_revision, t.source_fragment_ids,
  coalesce(t.source_clause_location, '') AS source_clause_location, t.source_resolved::VARCHAR AS source_resolved, t.has_executable_rule::VARCHAR AS has_executable_rule, t.outcome,
  coalesce(f.rule_id, '') AS rule_id, coalesce(f.element_type, '') AS element_type, coalesce(f.status, '') AS finding_status, coalesce(f.summary, '') AS finding_summary,
  coalesce(replace(f.affected_text, '~', '; '), '') AS affected_element_ids, coalesce(f.n_evidence, 0)::VARCHAR AS evidence_count, coalesce(t.review_status, '') AS review_status,
  coalesce(t.review_comment, '') AS review_comment, CASE WHEN t.review_updated_at IS NULL THEN '' ELSE strftime(t.review_updated_at, '%Y-%m-%dT%H:%M:%S.') || lpad((millisecond(t.review_updated_at) % 1000)::VARCHAR, 3, '0') || 'Z' END AS review_updated_at
FROM x_trace t LEFT JOIN x_findings f USING (run_id, requirement_id)""",
)
def _flat(spark, d):
    f = findings(spark, d)
    return T.traceability_flat(trace_rows(spark, d, f), f).select("run_id", *T.FLAT_COLUMNS)


@query(
    "traceability_summary",
    """SELECT run_id, 'Metrics' AS sheet, label AS name, '' AS group_kind, numerator || '|' || denominator || '|' || coalesce(percent::VARCHAR, 'n/a') AS cells FROM x_cov
UNION ALL SELECT run_id, 'Coverage', group_key, group_kind, requirement_count || '|' || with_rule || '|' || determined || '|' || compliant || '|' || unreviewed_findings FROM x_groups""",
)
def _summary(spark, d):
    return T.traceability_summary(trace_rows(spark, d))
