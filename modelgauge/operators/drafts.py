"""Candidate requirements mined from fragments, and the edits reviewers make to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.functions.skew import CHUNK_ROWS, chunked_running_count
from modelgauge.operators.fragments import LIKELY, trimmed, word_regex


def slug_id(prefix: str, index: str, text: str) -> str:
    """SQL text: prefix, index padded to three digits, slug of at most 40 characters."""
    slug = f"substring(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9]+', '-'), '^-|-$', ''), 1, 40)"
    number = f"if(length(cast({index} as string)) >= 3, cast({index} as string), lpad(cast({index} as string), 3, '0'))"
    return f"concat({prefix}, '-', {number}, if({slug} = '', '', concat('-', {slug})))"


def title_of(text: str) -> str:
    first = trimmed(f"split({text}, '\\n')[0]")
    return f"coalesce(nullif(substring(coalesce(nullif({first}, ''), {trimmed(text)}), 1, 160), ''), 'Untitled requirement')"


def initial_drafts(fragments: DataFrame, profile: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One draft per fragment: structural, candidate or informational.

    Ids number the candidates of a document in order. docx: a clause takes the next candidate number;
    pdf: candidates start at 2 and clauses use their list position.
    fragments: doc_id, pos, fragment_id, kind, exact_text, numbering_label, language_hints,
    extraction_quality, page_number, revision_content.
    """
    structural = "kind in ('heading', 'subheading', 'metadata')"
    cell = f"kind = 'table_cell' and exact_text rlike '{word_regex(LIKELY)}'" if profile == "pdf" else "kind = 'table_cell'"
    candidate = f"(kind in ('numbered_clause', 'mandatory_candidate', 'bullet_item') or ({cell}))"
    tagged = fragments.withColumns({"_s": F.expr(structural), "_c": F.expr(candidate)})
    run = chunked_running_count(tagged, ["doc_id"], "pos", F.col("_c"), "_run", chunk_rows)
    if profile == "docx":
        index = "case when _s then pos + 1 when _c then _run else _run + 1 end"
        title_text = "if(numbering_label is null, exact_text, concat(numbering_label, ' ', exact_text))"
        warnings = """array_compact(array(if(revision_content, 'Fragment includes Track Changes inserted text.', null),
            if(size(language_hints) > 0, concat('Mandatory phrasing hints: ', array_join(language_hints, ', '), '.'), null)))"""
    else:
        index = "case when _c and not _s then _run + 1 else pos + 1 end"
        title_text = "exact_text"
        warnings = """array_compact(array(case extraction_quality when 'sparse_text' then 'Sparse digital text — verify against the source page preview.'
                when 'table_heuristic' then 'Table cell extracted heuristically — verify column alignment on the source page.'
                when 'unreliable_layout' then 'Layout confidence is low — verify wording on the source page.' end,
            if(size(language_hints) > 0, concat('Mandatory phrasing hints: ', array_join(language_hints, ', '), '.'), null),
            if(page_number > 0, concat('Source page ', page_number, '.'), 'Missing PDF page anchor.')))"""
    pick = lambda s, c, i: f"case when _s then {s} when _c then {c} else {i} end"
    prefix = pick("'STRUCT'", "'REQ'", "'CLAUSE'")
    return run.withColumn("_index", F.expr(index)).selectExpr(
        "doc_id", "pos",
        "concat(if(_s, 'draft-struct-', 'draft-'), fragment_id) as draft_id",
        f"{slug_id(prefix, '_index', 'exact_text')} as requirement_id",
        f"if(_s, {title_of('exact_text')}, {title_of(title_text)}) as title",
        "exact_text as description",
        f"{pick(chr(39) + 'info' + chr(39), chr(39) + 'warning' + chr(39), chr(39) + 'info' + chr(39))} as severity",
        f"{pick(repr('informational'), repr('requires_rule_configuration'), repr('extracted'))} as status",
        "_c and not _s as included",
        f"{pick(repr('accepted'), repr('pending'), repr('accepted'))} as decision",
        f"{pick(repr('structural'), repr('candidate'), repr('informational'))} as kind",
        "if(_s, 'approved', 'pending') as approval",
        "if(_s, 'system', cast(null as string)) as approved_by",
        "array(fragment_id) as fragment_ids",
        "array(struct(fragment_id, 0 as start_offset, length(exact_text) as end_offset, exact_text)) as text_ranges",
        "'deterministic' as origin",
        "page_number",
        "not _c or _s as reviewed",
        f"if(_s, cast(array() as array<string>), {warnings}) as warnings",
        "cast(array() as array<string>) as errors",
        "false as superseded",
    )


def apply_approvals(drafts: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: doc_id, draft_id, approved, approved_by."""
    d = decisions.selectExpr("doc_id", "draft_id", "approved as _ok", "approved_by as _by")
    joined = drafts.join(d, ["doc_id", "draft_id"], "left")
    rejected = "_ok is not null and not _ok"
    changed = {
        "approval": "if(_ok is null, approval, if(_ok, 'approved', 'rejected'))", "approved_by": "coalesce(_by, approved_by)",
        "decision": "if(_ok is null, decision, if(_ok, 'accepted', 'rejected'))", "reviewed": "reviewed or _ok is not null",
        "included": f"included and not ({rejected})", "kind": f"if({rejected}, 'excluded', kind)", "status": f"if({rejected}, 'excluded', status)",
    }
    return joined.selectExpr(*[f"{changed[c]} as {c}" if c in changed else c for c in drafts.columns])


def apply_merges(drafts: DataFrame, merges: DataFrame) -> DataFrame:
    """merges: doc_id, merge_id, draft_id, approved_by. Two or more live drafts become one new draft; the
    listed drafts are superseded. A merge with fewer live drafts changes nothing."""
    wanted = merges.selectExpr("doc_id", "draft_id", "merge_id", "approved_by as merges_by")
    entry = F.struct("pos", "draft_id", "requirement_id", "title", "description", "severity", "fragment_ids", "text_ranges", "page_number", "merges_by")
    groups = (
        drafts.where("not superseded")
        .join(wanted, ["doc_id", "draft_id"])
        .groupBy("doc_id", "merge_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("d"))
        .where("size(d) >= 2")
    )
    merged = groups.selectExpr(
        "doc_id", "d[0].pos as pos",
        "concat('draft-merge-', substring(array_join(transform(d, x -> x.draft_id), '-'), 1, 80)) as draft_id",
        "d[0].requirement_id as requirement_id", "d[0].title as title",
        "array_join(transform(d, x -> x.description), '\\n\\n') as description",
        "case when exists(d, x -> x.severity = 'critical') then 'critical' when exists(d, x -> x.severity = 'warning') then 'warning' else 'info' end as severity",
        "'requires_rule_configuration' as status", "true as included", "'accepted' as decision", "'candidate' as kind", "'approved' as approval",
        "d[0].merges_by as approved_by", "array_distinct(flatten(transform(d, x -> x.fragment_ids))) as fragment_ids",
        "flatten(transform(d, x -> x.text_ranges)) as text_ranges", "'user' as origin", "d[0].page_number as page_number", "true as reviewed",
        "array('Merged from multiple source fragments; verify combined wording.') as warnings", "cast(array() as array<string>) as errors",
        "false as superseded", "transform(d, x -> x.draft_id) as _members",
    )
    gone = merged.selectExpr("doc_id", "explode(_members) as draft_id", "true as _gone")
    kept = _supersede(drafts, gone)
    return kept.unionByName(merged.select(*drafts.columns))


def _supersede(drafts: DataFrame, gone: DataFrame) -> DataFrame:
    joined = drafts.join(gone, ["doc_id", "draft_id"], "left")
    changed = {
        "superseded": "superseded or _gone is not null", "included": "included and _gone is null",
        "decision": "if(_gone is null, decision, 'accepted')", "reviewed": "reviewed or _gone is not null",
    }
    return joined.selectExpr(*[f"{changed[c]} as {c}" if c in changed else c for c in drafts.columns])


def apply_splits(drafts: DataFrame, splits: DataFrame) -> DataFrame:
    """splits: doc_id, draft_id, split_offset, split_by. Two halves with exact character ranges; ignored when the
    draft has several ranges, the offset is outside, or a half would be blank. Offsets count code points."""
    r = "text_ranges[0]"
    cut = (
        drafts.join(splits, ["doc_id", "draft_id"])
        .where(f"not superseded and size(text_ranges) = 1 and split_offset > 0 and split_offset < length({r}.exact_text)")
        .withColumn("_l", F.expr(f"regexp_replace(substring({r}.exact_text, 1, split_offset), '\\\\s+$', '')"))
        .withColumn("_r", F.expr(f"regexp_replace(substring({r}.exact_text, split_offset + 1), '^\\\\s+', '')"))
        .where("_l <> '' and _r <> ''")
    )
    halves = cut.withColumn(
        "_h",
        F.expr(
            f"""explode(array(struct('a' as k, _l as t, {r}.start_offset as s, {r}.start_offset + length(_l) as e),
                struct('b' as k, _r as t, {r}.start_offset + length({r}.exact_text) - length(_r) as s, {r}.end_offset as e)))"""
        ),
    )
    changed = {
        "draft_id": "concat(draft_id, '-', _h.k)", "requirement_id": "concat(requirement_id, '-', _h.k)", "title": title_of("_h.t"),
        "description": "_h.t",
        "text_ranges": f"array(struct({r}.fragment_id as fragment_id, _h.s as start_offset, _h.e as end_offset, _h.t as exact_text))",
        "origin": "'user'", "approval": "'approved'", "approved_by": "split_by", "decision": "'accepted'", "reviewed": "true", "superseded": "false",
        "warnings": "array('Split from a shared source fragment; character ranges are preserved.')",
    }
    new = halves.selectExpr(*[f"{changed[c]} as {c}" if c in changed else c for c in drafts.columns])
    gone = cut.select("doc_id", "draft_id", F.lit(True).alias("_gone"))
    return _supersede(drafts, gone).unionByName(new)


def confirmation_blockers(drafts: DataFrame, profile: str) -> DataFrame:
    """(doc_id, message): distinct reasons why a document's package cannot be confirmed yet."""
    page = "if(included and coalesce(page_number, 0) = 0, 'included requirement must reference a PDF page.', null)," if profile == "pdf" else ""
    active = drafts.where("not superseded and kind <> 'structural'")
    rows = active.selectExpr(
        "doc_id",
        f"""explode(transform(array_compact(array(
            if(kind = 'ai_suggestion' and decision = 'pending', 'AI draft must be accepted or rejected.', null), {page}
            if(included and approval <> 'approved', 'included requirement needs an approved source.', null),
            if(included and decision = 'pending', 'included draft must be accepted.', null),
            if(included and size(errors) > 0, array_join(errors, ' '), null),
            if(not included and kind = 'candidate' and decision = 'pending', 'candidate must be classified, excluded, or deferred.', null))),
            m -> concat(requirement_id, ': ', m))) as message""",
    ).distinct()
    empty = (
        drafts.groupBy("doc_id")
        .agg(F.count_if(F.expr("included and not superseded and kind <> 'structural'")).alias("n"))
        .where("n = 0")
        .selectExpr("doc_id", "'At least one included requirement is required.' as message")
    )
    return rows.unionByName(empty)


def finalize_drafts(drafts: DataFrame, blockers: DataFrame, profile: str, ocr_docs: DataFrame | None = None) -> DataFrame:
    """Textual requirements of the documents without blockers (and, for pdf, without OCR fragments)."""
    blocked = blockers.select("doc_id")
    if ocr_docs is not None:
        blocked = blocked.unionByName(ocr_docs.select("doc_id"))
    section = (
        "if(coalesce(page_number, 0) > 0, concat('page-', page_number), coalesce(fragment_ids[0], 'unspecified'))"
        if profile == "pdf"
        else "coalesce(text_ranges[0].fragment_id, fragment_ids[0], 'unspecified')"
    )
    return (
        drafts.where("included and not superseded")
        .join(blocked.distinct(), "doc_id", "left_anti")
        .selectExpr(
            "doc_id", "requirement_id", "title", "'textual_requirement' as type", "severity", "description",
            "case when status in ('informational', 'valid_requirement') then status else 'requires_rule_configuration' end as automation_status",
            "fragment_ids as source_fragment_ids", "approval", "origin", f"{section} as section", "pos",
        )
    )


def fragment_map(drafts: DataFrame) -> DataFrame:
    """(doc_id, requirement_id, fragment_id, start_offset, end_offset, exact_text) of included live drafts."""
    return drafts.where("included and not superseded").selectExpr("doc_id", "requirement_id", "inline(text_ranges)")


def section_progress(drafts: DataFrame, fragments: DataFrame) -> DataFrame:
    """Total and approved drafts per top heading of each document."""
    top = fragments.selectExpr("doc_id", "fragment_id", "try_element_at(heading_path, 1) as _section")
    active = drafts.where("not superseded and kind <> 'structural' and (included or kind = 'candidate')").withColumn(
        "fragment_id", F.expr("if(size(text_ranges) > 0, fragment_ids[0], null)")
    )
    return (
        active.join(top, ["doc_id", "fragment_id"], "left")
        .groupBy("doc_id", F.coalesce("_section", F.lit("Document")).alias("section"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("approval = 'approved' and decision <> 'pending'")).alias("approved"))
    )


DRAFT_FILTERS = {
    "unreviewed": "not reviewed or decision = 'pending'", "blocked": "included and approval <> 'approved'", "ai": "kind = 'ai_suggestion'",
    "informational": "kind = 'informational' or status = 'informational'", "excluded": "not included or kind = 'excluded'",
    "candidates": "kind = 'candidate' or included", "all": "true",
}


def filter_drafts(drafts: DataFrame, name: str) -> DataFrame:
    return drafts.where("not superseded and kind <> 'structural'").where(DRAFT_FILTERS[name])
