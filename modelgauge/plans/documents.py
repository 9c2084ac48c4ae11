"""Registered queries: fragments, classification, numbering, pages, citations and drafts over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge.operators import drafts as D
from modelgauge.operators import fragments as FR
from modelgauge.plans.oracle import cte
from modelgauge.plans.registry import query
from modelgauge.plans.session import written
from modelgauge.plans.validation import findings
from modelgauge.sources import testbed as tb

# The test documents hold no mandatory wording, so it is put in by line number; every line is kept.
_VARIANTS = (
    ("concat({l}, ' shall be verified.')", "{l} || ' shall be verified.'"),
    ("concat('1.', {i}, ' ', {l})", "'1.' || {i} || ' ' || {l}"),
    ("concat({l}, ' Das MÜSSEN alle.')", "{l} || ' Das MÜSSEN alle.'"),
    ("concat('• ', {l})", "'• ' || {l}"),
    ("concat('SECTION ', {i})", "'SECTION ' || {i}"),
    ("concat({l}, ' nije dopušteno')", "{l} || ' nije dopušteno'"),
    ("concat('Chapter ', {i}, ' scope')", "'Chapter ' || {i} || ' scope'"),
    ("concat('A.', {i}, ' ', {l})", "'A.' || {i} || ' ' || {l}"),
    ("'Das ist so bald wie möglich sicherzustellen'", "'Das ist so bald wie möglich sicherzustellen'"),
)


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with clause wording put into their lines."""
    docs = tb.table(spark, d, "documents")
    cases = " ".join(f"when {n} then {s.format(l='l', i='i')}" for n, (s, _) in enumerate(_VARIANTS))
    lines = f"filter(transform(split(text, '\\n'), l -> {FR.trimmed('l')}), l -> l <> '')"
    return docs.selectExpr(
        "doc_id", "lang", "source",
        f"array_join(transform({lines}, (l, i) -> case (doc_id + i) % 12 {cases} else l end), '\\n') as text",
    )


cte(
    "x_lines0",
    r"""SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '') AS ls FROM documents)""",
)
cte(
    "x_lines",
    "SELECT doc_id, i AS pos, CASE (doc_id + i) % 12 " + " ".join(f"WHEN {n} THEN {s.format(l='l', i='i')}" for n, (_, s) in enumerate(_VARIANTS)) + " ELSE l END AS t, (doc_id + i) % 12 AS m FROM x_lines0",
)


def _any(words: list[str], x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])')" for w in words) + ")"


_IST = r"regexp_matches({x}, '(?is)(^|[^A-Za-z0-9_])ist([^A-Za-z0-9_].{{0,38}}[^A-Za-z0-9_]|[^A-Za-z0-9_])sicherzustellen($|[^A-Za-z0-9_])')"


def _hint(profile: str, lang: str, x: str) -> str:
    out = _any(FR.MANDATORY[profile][lang], x)
    return f"({out} OR {_IST.format(x=x)})" if (profile, lang) == ("docx", "de") else out


def _hints(profile: str, x: str = "t") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_hint(profile, g, x)} THEN '{g}' END" for g in ("en", "de", "hr")) + "], lambda h: h IS NOT NULL)"


_CLASS = r"""CASE WHEN regexp_matches(t, '^[0-9]+(\.[0-9]+)*\s+\S') OR regexp_matches(t, '^[A-Z]\.[0-9]+') THEN 'numbered_clause' WHEN regexp_matches(t, '^[•\-–—]\s+\S') THEN 'bullet_item'
  WHEN len(h) > 0 THEN 'mandatory_candidate' WHEN length(t) <= 80 AND t = upper(t) AND regexp_matches(t, '[A-Z]') THEN 'heading'
  WHEN regexp_matches(t, '(?i)^(section|chapter|teil|abschnitt)($|[^A-Za-z0-9_])') AND length(t) < 120 THEN 'heading' ELSE 'paragraph' END"""
cte("x_dochash", "SELECT doc_id, sha256(string_agg(t, chr(10) ORDER BY pos)) AS doc_hash FROM x_lines GROUP BY 1")
cte(
    "x_pdf",
    f"""SELECT *, {_CLASS} AS kind, nullif(regexp_extract(t, '^([0-9]+(?:\\.[0-9]+)*)', 1), '') AS lbl, pos // 12 + 1 AS page, 'frg-' || doc_id || '-' || pos AS fragment_id
FROM (SELECT *, {_hints('pdf')} AS h FROM x_lines)""",
)


def pdf_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Classified line fragments; twelve lines count as one page."""
    base = FR.read_fragments(documents(spark, d))
    return base.selectExpr(
        "doc_id", "pos", "concat('frg-', doc_id, '-', pos) as fragment_id", "exact_text",
        f"{FR.classify_line()} as kind", f"{FR.numbering_label()} as numbering_label", f"{FR.mandatory_hints('exact_text')} as language_hints",
        "case pos % 5 when 0 then 'sparse_text' when 1 then 'table_heuristic' when 2 then 'unreliable_layout' else 'digital_text' end as extraction_quality",
        "if(pos % 97 = 96, null, floor(pos / 12) + 1) as page_number", "false as revision_content",
        "array(concat('Page ', floor(pos / 12) + 1)) as heading_path",
    )


@query("read_fragments", "SELECT doc_id, pos, t AS exact_text, length(t) AS end_offset FROM x_lines")
def _read(spark, d):
    return FR.read_fragments(documents(spark, d)).select("doc_id", "pos", "exact_text", "end_offset")


@query("mandatory_hints", f"SELECT doc_id, pos, array_to_string({_hints('docx')}, ',') AS docx, array_to_string({_hints('pdf')}, ',') AS pdf FROM x_lines")
def _mandatory(spark, d):
    return FR.read_fragments(documents(spark, d)).selectExpr(
        "doc_id", "pos", f"array_join({FR.mandatory_hints('exact_text', 'docx')}, ',') as docx", f"array_join({FR.mandatory_hints('exact_text', 'pdf')}, ',') as pdf"
    )


@query("classify_lines", "SELECT doc_id, pos, kind, lbl AS numbering_label FROM x_pdf")
def _classify(spark, d):
    return pdf_fragments(spark, d).select("doc_id", "pos", "kind", "numbering_label")


def _score(lang: str) -> str:
    words, weight = FR.COMMON[lang]
    terms = [f"CASE WHEN {_any([w], 's')} THEN 2 ELSE 0 END" for w in FR.MANDATORY["docx"][lang]]
    if lang == "de":
        terms.append(f"CASE WHEN {_IST.format(x='s')} THEN 2 ELSE 0 END")
    return " + ".join([*terms, f"CASE WHEN {_any(words, 's')} THEN {weight} ELSE 0 END"])


@query(
    "detect_language",
    f"""SELECT doc_id, CASE WHEN greatest(en, de, hr) = 0 THEN 'unknown' WHEN en >= de AND en >= hr THEN 'en' WHEN de >= hr THEN 'de' ELSE 'hr' END AS language FROM (
  SELECT doc_id, {', '.join(f'{_score(g)} AS {g}' for g in ('en', 'de', 'hr'))} FROM (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS s FROM x_lines0 WHERE i < 80 GROUP BY 1))""",
)
def _language(spark, d):
    return FR.detect_language(FR.read_fragments(tb.table(spark, d, "documents")), "docx")


cte(
    "x_docx0",
    "SELECT *, CASE WHEN m = 4 THEN pos % 3 + 1 END AS lvl, CASE WHEN m IN (1, 7, 9) THEN doc_id % 3 END AS list_id, (pos // 2) % 4 AS ilvl FROM x_lines",
)


def docx_base(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the paragraph attributes a word processor stores: heading level, list membership, table cells. Written once, as labels,
    paths and fragments are made from them in several passes."""
    build = lambda: FR.read_fragments(documents(spark, d)).drop("doc_hash").withColumn("m", F.expr("(doc_id + pos) % 12")).selectExpr(
        "*", "if(m = 4, cast(pos % 3 + 1 as int), null) as heading_level", "m = 10 as in_table", "m = 3 as bullet",
        "if(m in (1, 7, 9), doc_id % 3, null) as list_id", "cast(floor(pos / 2) % 4 as int) as level",
    )
    return written(spark, f"docx-base:{d}", build)


cte("x_items", "SELECT doc_id, list_id, pos, ilvl FROM x_docx0 WHERE list_id IS NOT NULL")
cte(
    "x_numbered",
    """SELECT a.doc_id, a.list_id, a.pos, any_value(a.ilvl) AS ilvl, array_to_string([""" + ", ".join(
        f"(count(*) FILTER (WHERE b.ilvl = {k} AND b.pos > coalesce(r{k}, -1)))::VARCHAR" for k in range(4)
    ) + """][1:any_value(a.ilvl) + 1], '.') AS label
FROM (SELECT i.*, """ + ", ".join(
        f"max(CASE WHEN ilvl < {k} THEN pos END) OVER (PARTITION BY doc_id, list_id ORDER BY pos) AS r{k}" for k in range(4)
    ) + """ FROM x_items i) a JOIN x_items b ON b.doc_id = a.doc_id AND b.list_id = a.list_id AND b.pos <= a.pos GROUP BY a.doc_id, a.list_id, a.pos, r0, r1, r2, r3""",
)


@query("number_items", "SELECT doc_id, list_id, pos, ilvl AS level, label FROM x_numbered")
def _number(spark, d):
    items = docx_base(spark, d).where("list_id is not null").select("doc_id", "list_id", "pos", "level")
    return FR.number_items(items)


cte(
    "x_paths",
    """SELECT doc_id, pos, array_to_string(list_filter([""" + ", ".join(
        f"CASE WHEN l{k} = {k} THEN t{k} END" for k in (1, 2, 3)
    ) + """], lambda x: x IS NOT NULL), ' > ') AS path FROM (SELECT doc_id, pos, """ + ", ".join(
        f"last_value(CASE WHEN lvl <= {k} THEN lvl END IGNORE NULLS) OVER w AS l{k}, last_value(CASE WHEN lvl <= {k} THEN t END IGNORE NULLS) OVER w AS t{k}" for k in (1, 2, 3)
    ) + """ FROM x_docx0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))""",
)


@query("heading_path", "SELECT doc_id, pos, path FROM x_paths")
def _paths(spark, d):
    return FR.heading_path(docx_base(spark, d)).select("doc_id", "pos", F.array_join("heading_path", " > ").alias("path"))


def docx_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Classified paragraphs with labels and heading paths, written once for drafts, progress and exports."""
    return written(spark, f"docx-fragments:{d}", lambda: _docx_fragments(spark, d))


def _docx_fragments(spark: SparkSession, d: str) -> DataFrame:
    base = docx_base(spark, d)
    labels = FR.number_items(base.where("list_id is not null").select("doc_id", "list_id", "pos", "level")).select("doc_id", "pos", F.col("label").alias("numbering_label"))
    return FR.heading_path(base.join(labels, ["doc_id", "pos"], "left")).selectExpr(
        "doc_id", "pos", "concat('frg-', doc_id, '-', pos) as fragment_id", "exact_text", f"{FR.classify_fragment()} as kind", "numbering_label",
        f"{FR.mandatory_hints('exact_text', 'docx')} as language_hints", "cast(null as string) as extraction_quality", "cast(null as bigint) as page_number",
        "pos % 9 = 0 as revision_content", "heading_path",
    )


cte(
    "x_docx",
    f"""SELECT x.*, n.label AS lbl, 'frg-' || x.doc_id || '-' || x.pos AS fragment_id, CASE WHEN lvl = 1 THEN 'heading' WHEN lvl IS NOT NULL THEN 'subheading' WHEN m = 10 THEN CASE WHEN len(h) > 0 THEN 'mandatory_candidate' ELSE 'table_cell' END
  WHEN m = 3 THEN 'bullet_item' WHEN n.label IS NOT NULL THEN 'numbered_clause' WHEN len(h) > 0 THEN 'mandatory_candidate' ELSE 'paragraph' END AS kind
FROM (SELECT *, {_hints('docx')} AS h FROM x_docx0) x LEFT JOIN x_numbered n ON n.doc_id = x.doc_id AND n.pos = x.pos""",
)


@query("classify_fragments", "SELECT doc_id, pos, kind, lbl AS numbering_label FROM x_docx")
def _classify_docx(spark, d):
    return docx_fragments(spark, d).select("doc_id", "pos", "kind", "numbering_label")


@query(
    "fragment_ids",
    """SELECT x.doc_id, x.pos, 'frag_' || substr(sha256(g.doc_hash || '|{"kind":"paragraph","bodyIndex":' || x.pos || ',"paragraphIndex":' || x.pos || ',"startOffset":0,"endOffset":' || length(x.t) || '}|' || x.t), 1, 24) AS fragment_id FROM x_lines x JOIN x_dochash g USING (doc_id)""",
)
def _ids(spark, d):
    return FR.read_fragments(documents(spark, d)).selectExpr("doc_id", "pos", f"{FR.fragment_id('doc_hash', FR.paragraph_anchor_json(), 'exact_text')} as fragment_id")


# ---- pages ----------------------------------------------------------------------------------


def text_items(spark: SparkSession, d: str) -> DataFrame:
    """Positioned text items: eight lines a page, every third line cut into three columns, one stray column."""
    base = FR.read_fragments(tb.table(spark, d, "documents"))
    third = "cast(greatest(1, floor(end_offset / 3)) as int)"
    return base.selectExpr(
        "doc_id", "cast(floor(pos / 8) + 1 as int) as page", "pos",
        f"""explode(if(pos % 3 = 0, array(struct(0 as c, substring(exact_text, 1, {third}) as str), struct(1 as c, substring(exact_text, {third} + 1, {third}) as str),
            struct(2 as c, substring(exact_text, 2 * {third} + 1) as str)), array(struct(0 as c, exact_text as str)))) as p""",
    ).where("trim(p.str) <> ''").selectExpr(
        "doc_id", "page", "cast(3 * pos + p.c as bigint) as item", "p.str as str", "cast(50 + 200 * p.c + if(pos % 15 = 0 and p.c = 1, 40, 0) as double) as x",
        "cast(780 - 20 * (pos % 8) + (p.c % 2) * 2 as double) as y", "cast(60 as double) as width", "cast(10 as double) as height",
    )


_THIRD = "greatest(1, length(t) // 3)"
cte(
    "x_titems",
    rf"""SELECT doc_id, page, str FROM (SELECT doc_id, i // 8 + 1 AS page, unnest(CASE WHEN i % 3 = 0 THEN [substr(t, 1, {_THIRD}), substr(t, {_THIRD} + 1, {_THIRD}), substr(t, 2 * {_THIRD} + 1)] ELSE [t] END) AS str FROM (SELECT doc_id, i, l AS t FROM x_lines0)) WHERE trim(str) <> ''""",
)


def pages_meta(spark: SparkSession, d: str) -> DataFrame:
    """One page more than the text fills; every other page has images."""
    return FR.read_fragments(tb.table(spark, d, "documents")).groupBy("doc_id").agg(F.max("pos").alias("m")).selectExpr(
        "doc_id", "explode(sequence(1, cast(floor(m / 8) + 2 as int))) as page"
    ).withColumn("has_images", F.expr("(doc_id + page) % 2 = 0"))


cte(
    "x_pages",
    r"""SELECT p.doc_id, p.page, (p.doc_id + p.page) % 2 = 0 AS has_images, count(s.str) AS item_count, CAST(coalesce(sum(length(regexp_replace(s.str, '\s+', '', 'g'))), 0) AS BIGINT) AS char_count
FROM (SELECT doc_id, unnest(range(1, max(i) // 8 + 3)) AS page FROM x_lines0 GROUP BY 1) p LEFT JOIN x_titems s USING (doc_id, page) GROUP BY 1, 2""",
)
_QUALITY = "CASE WHEN char_count = 0 AND item_count = 0 THEN CASE WHEN has_images THEN 'likely_scanned' ELSE 'empty' END WHEN char_count < 40 AND has_images THEN 'likely_scanned' WHEN char_count < 120 THEN 'sparse_text' ELSE 'digital_text' END"


@query("page_quality", f"SELECT doc_id, page, has_images, item_count, char_count, {_QUALITY} AS quality FROM x_pages")
def _quality(spark, d):
    return FR.page_quality(text_items(spark, d), pages_meta(spark, d)).select("doc_id", "page", "has_images", "item_count", "char_count", "quality")


cte(
    "x_placed",
    rf"""SELECT doc_id, i, c, str, CAST(50 + 200 * c + CASE WHEN i % 15 = 0 AND c = 1 THEN 40 ELSE 0 END AS DOUBLE) AS x, CAST(780 - 20 * (i % 8) + (c % 2) * 2 AS DOUBLE) AS y FROM (
  SELECT doc_id, i, unnest(CASE WHEN i % 3 = 0 THEN [0, 1, 2] ELSE [0] END) AS c, unnest(CASE WHEN i % 3 = 0 THEN [substr(t, 1, {_THIRD}), substr(t, {_THIRD} + 1, {_THIRD}), substr(t, 2 * {_THIRD} + 1)] ELSE [t] END) AS str
  FROM (SELECT doc_id, i, l AS t FROM x_lines0)) WHERE trim(str) <> ''""",
)


@query(
    "assemble_lines",
    r"""SELECT doc_id, CAST(i // 8 + 1 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id, i // 8 ORDER BY i) - 1 AS INTEGER) AS line, trim(regexp_replace(string_agg(str, ' ' ORDER BY x), '\s+', ' ', 'g')) AS text,
  min(x) AS x, min(y) AS y, max(x) + 60 - min(x) AS width, max(y) + 10 - min(y) AS height, CAST(count(*) AS INTEGER) AS n_items FROM x_placed GROUP BY doc_id, i""",
)
def _assemble(spark, d):
    return FR.assemble_lines(text_items(spark, d))


@query(
    "detect_tables",
    """SELECT doc_id, CAST(i // 8 + 1 AS INTEGER) AS page, CAST(r AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY doc_id, i ORDER BY x) - 1 AS INTEGER) AS cell, trim(str) AS text, x, y, 60.0::DOUBLE AS width, 10.0::DOUBLE AS height, 0 AS rejected
FROM x_placed JOIN (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, i // 8 ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY doc_id, i // 8) AS lines FROM x_placed GROUP BY doc_id, i HAVING count(*) >= 2) USING (doc_id, i) WHERE lines >= 2""",
)
def _tables(spark, d):
    return FR.detect_tables(text_items(spark, d))


@query(
    "page_notices",
    f"""SELECT doc_id, kind, n FROM (SELECT doc_id, 'likely_scanned_page' AS kind, count(*) AS n FROM (SELECT *, {_QUALITY} AS q FROM x_pages) WHERE q IN ('likely_scanned', 'empty') GROUP BY 1
UNION ALL SELECT doc_id, 'image_page', count(*) FROM (SELECT *, {_QUALITY} AS q FROM x_pages) WHERE q IN ('likely_scanned', 'empty') AND has_images GROUP BY 1
UNION ALL SELECT doc_id, 'unreliable_table', count(*) FROM x_lines0 WHERE i % 6 = 5 GROUP BY 1)""",
)
def _notices(spark, d):
    """Every sixth line stands once more on a page of its own, twice beside itself in two rows of one column: not a table."""
    items = text_items(spark, d)
    narrow = FR.read_fragments(tb.table(spark, d, "documents")).where("pos % 6 = 5").selectExpr(
        "doc_id", "cast(1000000 + pos as int) as page", "explode(sequence(0L, 3L)) as item", "exact_text as str"
    )
    narrow = narrow.selectExpr("doc_id", "page", "item", "str", "50D + 5 * (item % 2) as x", "700D - 20 * floor(item / 2) as y", "60D as width", "10D as height")
    pages = FR.page_quality(items, pages_meta(spark, d))
    return FR.page_notices(pages, FR.detect_tables(items.select(*narrow.columns).unionByName(narrow)).where("rejected > 0"))


# ---- search and citations -------------------------------------------------------------------


@query(
    "search_fragments",
    "SELECT fragment_id FROM x_docx x JOIN x_paths p USING (doc_id, pos) WHERE contains(lower(t), 'section 4') OR contains(lower(replace(p.path, ' > ', ' ')), 'section 4') OR coalesce(contains(lower(lbl), 'section 4'), false)",
)
def _search(spark, d):
    return FR.search_fragments(docx_fragments(spark, d), " Section 4 ").select("fragment_id")


cte(
    "x_cites",
    """SELECT 'sug-' || doc_id || '-' || (pos // 2) AS suggestion_id, doc_id, CASE WHEN pos % 23 = 0 THEN 'frg-none' ELSE fragment_id END AS fragment_id, CASE WHEN pos % 19 = 0 THEN -1 ELSE 2 END AS start_offset,
  CASE WHEN pos % 17 = 0 THEN length(t) + 5 ELSE least(length(t), 12) END AS end_offset, CASE WHEN pos % 13 = 0 THEN 'other words' ELSE substr(t, 3, least(length(t), 12) - 2) END AS quote, t, pos FROM x_pdf""",
)
_ERR = """CASE WHEN fragment_id = 'frg-none' THEN 'Unknown fragmentId ''frg-none''.' WHEN start_offset < 0 OR end_offset > length(t) OR start_offset >= end_offset THEN 'Invalid offsets for fragment ''' || fragment_id || '''.'
  WHEN substr(t, start_offset + 1, end_offset - start_offset) <> quote THEN 'Quote text does not match fragment ''' || fragment_id || ''' at the given offsets.' END"""


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Quotes from the fragments of all documents; faults follow from the position."""
    return pdf_fragments(spark, d).selectExpr(
        "concat('sug-', doc_id, '-', floor(pos / 2)) as suggestion_id", "doc_id", "if(pos % 23 = 0, 'frg-none', fragment_id) as fragment_id",
        "if(pos % 19 = 0, -1, 2) as start_offset", "if(pos % 17 = 0, length(exact_text) + 5, least(length(exact_text), 12)) as end_offset",
        "if(pos % 13 = 0, 'other words', substring(exact_text, 3, least(length(exact_text), 12) - 2)) as exact_text",
    )


@query("check_quotes", f"SELECT suggestion_id, fragment_id, start_offset, end_offset, {_ERR} AS error FROM x_cites")
def _quotes(spark, d):
    return FR.check_quotes(citations(spark, d), pdf_fragments(spark, d)).select("suggestion_id", "fragment_id", "start_offset", "end_offset", "error")


@query(
    "triage_suggestions",
    f"SELECT doc_id, suggestion_id, count(e) AS errors, CASE WHEN count(e) > 0 THEN 'rejected' ELSE 'accepted' END AS verdict FROM (SELECT *, {_ERR} AS e FROM x_cites) GROUP BY 1, 2",
)
def _triage(spark, d):
    return FR.triage_suggestions(FR.check_quotes(citations(spark, d), pdf_fragments(spark, d)))


@query(
    "heuristic_suggestions",
    """SELECT doc_id, 'ai-heuristic-' || n AS draft_id, 'AI-' || lpad(n::VARCHAR, 3, '0') AS requirement_id, substr(t, 1, 120) AS title, fragment_id, length(t) AS end_offset FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM x_pdf WHERE doc_id % 3 = 0 AND kind = 'mandatory_candidate') WHERE n <= 20""",
)
def _heuristics(spark, d):
    """Every third document has no suggestions."""
    return FR.heuristic_suggestions(pdf_fragments(spark, d), citations(spark, d).where("doc_id % 3 <> 0")).drop("start_offset")


@query(
    "check_answer_citations",
    """WITH c AS (SELECT c.conv_id || '-' || c.turn AS answer_id, 'run-a-mdl-' || c.conv_id AS run_id, CASE WHEN o_orderkey % 37 = 0 AND turn > 2 THEN 'REQ-NONE' ELSE 'REQ-HAS-DOOR' END AS requirement_id,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN (o_orderkey + turn) % 11 = 0 THEN 'rm-ghost' ELSE 'rm-' || o_orderkey END AS element_id FROM conversations c JOIN orders ON o_custkey = c.conv_id WHERE role = 'assistant')
SELECT answer_id, bool_and(ok) AS valid, count(*) AS citations, count(*) FILTER (WHERE NOT ok) AS bad_citations FROM (SELECT answer_id, requirement_id <> 'REQ-NONE' AND coalesce(element_id, '') <> 'rm-ghost' AS ok FROM c) GROUP BY 1""",
)
def _answers(spark, d):
    """Assistant turns citing the rooms of the customer with the conversation's number."""
    turns = tb.table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    o = tb.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    cites = turns.join(o, turns.conv_id == o.o_custkey).selectExpr(
        "concat(conv_id, '-', turn) as answer_id", "concat('run-a-mdl-', conv_id) as run_id", "if(o_orderkey % 37 = 0 and turn > 2, 'REQ-NONE', 'REQ-HAS-DOOR') as requirement_id",
        "case when o_orderkey % 5 = 0 then null when (o_orderkey + turn) % 11 = 0 then 'rm-ghost' else concat('rm-', o_orderkey) end as element_id",
    )
    return FR.check_answer_citations(cites, findings(spark, d))


# ---- drafts ---------------------------------------------------------------------------------

_SLUG = "substr(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40)"
_PAD = "CASE WHEN n >= 100 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END"
_RID = f"{{p}} || '-' || {_PAD} || CASE WHEN {_SLUG} = '' THEN '' ELSE '-' || {_SLUG} END"


def _draft_cte(name: str, src: str, cell: str, n: str, title: str) -> None:
    cte(name + "0", f"SELECT *, kind IN ('heading', 'subheading', 'metadata') AS s, kind IN ('numbered_clause', 'mandatory_candidate', 'bullet_item') OR {cell} AS c FROM {src}")
    cte(name + "1", f"SELECT *, {n} AS n FROM (SELECT *, count(*) FILTER (WHERE c) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM {name}0)")
    cte(
        name,
        f"""SELECT *, CASE WHEN s THEN 'draft-struct-' ELSE 'draft-' END || fragment_id AS draft_id, {_RID.format(p="CASE WHEN s THEN 'STRUCT' WHEN c THEN 'REQ' ELSE 'CLAUSE' END")} AS requirement_id,
  substr(CASE WHEN s THEN t ELSE {title} END, 1, 160) AS title, CASE WHEN s THEN 'info' WHEN c THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN s THEN 'informational' WHEN c THEN 'requires_rule_configuration' ELSE 'extracted' END AS status, c AND NOT s AS included, CASE WHEN NOT s AND c THEN 'pending' ELSE 'accepted' END AS decision,
  CASE WHEN s THEN 'structural' WHEN c THEN 'candidate' ELSE 'informational' END AS dkind, CASE WHEN s THEN 'approved' ELSE 'pending' END AS approval FROM {name}1""",
    )


_draft_cte("x_pdrafts", "(SELECT *, 1 AS z FROM x_pdf)", f"(kind = 'table_cell' AND {_any(FR.LIKELY, 't')})", "CASE WHEN c AND NOT s THEN r + 1 ELSE pos + 1 END", "t")
_draft_cte("x_ddrafts", "x_docx", "kind = 'table_cell'", "CASE WHEN s THEN pos + 1 WHEN c THEN r ELSE r + 1 END", "coalesce(lbl || ' ', '') || t")
_DC = "doc_id, draft_id, requirement_id, title, severity, status, included, decision, dkind AS kind, approval"
_DCOLS = ("doc_id", "draft_id", "requirement_id", "title", "severity", "status", "included", "decision", "kind", "approval")
_PW = """CASE WHEN s THEN '' ELSE array_to_string(list_filter([CASE pos % 5 WHEN 0 THEN 'Sparse digital text — verify against the source page preview.' WHEN 1 THEN 'Table cell extracted heuristically — verify column alignment on the source page.'
  WHEN 2 THEN 'Layout confidence is low — verify wording on the source page.' END, CASE WHEN len(h) > 0 THEN 'Mandatory phrasing hints: ' || array_to_string(h, ', ') || '.' END,
  CASE WHEN pos % 97 = 96 THEN 'Missing PDF page anchor.' ELSE 'Source page ' || page || '.' END], lambda w: w IS NOT NULL), '~') END"""
_DW = """CASE WHEN s THEN '' ELSE array_to_string(list_filter([CASE WHEN pos % 9 = 0 THEN 'Fragment includes Track Changes inserted text.' END,
  CASE WHEN len(h) > 0 THEN 'Mandatory phrasing hints: ' || array_to_string(h, ', ') || '.' END], lambda w: w IS NOT NULL), '~') END"""


def pdf_drafts(spark, d):
    return D.initial_drafts(pdf_fragments(spark, d), "pdf")


def docx_drafts(spark, d):
    return D.initial_drafts(docx_fragments(spark, d), "docx")


@query("initial_drafts_pdf", f"SELECT {_DC}, {_PW} AS warnings FROM x_pdrafts")
def _pdf_drafts(spark, d):
    return pdf_drafts(spark, d).withColumn("warnings", F.array_join("warnings", "~")).select(*_DCOLS, "warnings")


@query("initial_drafts_docx", f"SELECT {_DC}, {_DW} AS warnings FROM x_ddrafts")
def _docx_drafts(spark, d):
    return docx_drafts(spark, d).withColumn("warnings", F.array_join("warnings", "~")).select(*_DCOLS, "warnings")


def approvals(drafts: DataFrame) -> DataFrame:
    """Decisions on every document not divisible by 4: all candidates, every 7th rejected; others on every third line."""
    return drafts.where("not (kind = 'structural') and (doc_id % 4 <> 0 or pos % 3 = 0)").selectExpr("doc_id", "draft_id", "pos % 7 <> 6 as approved", "concat('usr-', pos % 5) as approved_by")


cte(
    "x_approved",
    """SELECT * REPLACE (CASE WHEN ok IS NULL THEN approval WHEN ok THEN 'approved' ELSE 'rejected' END AS approval, CASE WHEN ok IS NULL THEN decision WHEN ok THEN 'accepted' ELSE 'rejected' END AS decision,
  included AND coalesce(ok, true) AS included, CASE WHEN NOT coalesce(ok, true) THEN 'excluded' ELSE dkind END AS dkind, CASE WHEN NOT coalesce(ok, true) THEN 'excluded' ELSE status END AS status)
FROM (SELECT *, CASE WHEN dkind <> 'structural' AND (doc_id % 4 <> 0 OR pos % 3 = 0) THEN pos % 7 <> 6 END AS ok FROM x_pdrafts)""",
)


def approved_drafts(spark, d):
    drafts = pdf_drafts(spark, d)
    return D.apply_approvals(drafts, approvals(drafts))


@query("apply_approvals", f"SELECT {_DC} FROM x_approved")
def _approve(spark, d):
    return approved_drafts(spark, d).select(*_DCOLS)


@query(
    "apply_merges",
    """WITH p AS (SELECT *, pos // 10 AS g FROM x_pdrafts WHERE pos % 10 IN (2, 3, 4)), q AS (SELECT doc_id, g, list(draft_id ORDER BY pos) AS ids, list(requirement_id ORDER BY pos)[1] AS requirement_id, list(title ORDER BY pos)[1] AS title,
  string_agg(t, chr(10) || chr(10) ORDER BY pos) AS description, CASE WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT doc_id, 'draft-merge-' || substr(array_to_string(ids, '-'), 1, 80) AS draft_id, requirement_id, title, severity, 'accepted' AS decision, true AS included, false AS superseded, n AS ranges, md5(description) AS description FROM q
UNION ALL SELECT x.doc_id, x.draft_id, x.requirement_id, x.title, x.severity, CASE WHEN q.n IS NULL THEN x.decision ELSE 'accepted' END, x.included AND q.n IS NULL, q.n IS NOT NULL, 1, md5(x.t) FROM x_pdrafts x LEFT JOIN q ON q.doc_id = x.doc_id AND x.pos % 10 IN (2, 3, 4) AND q.g = x.pos // 10""",
)
def _merge(spark, d):
    drafts = pdf_drafts(spark, d)
    merges = drafts.where("pos % 10 in (2, 3, 4)").selectExpr("doc_id", "draft_id", "floor(pos / 10) as merge_id", "'usr-1' as approved_by")
    return D.apply_merges(drafts, merges).selectExpr(
        "doc_id", "draft_id", "requirement_id", "title", "severity", "decision", "included", "superseded", "size(text_ranges) as ranges", "md5(description) as description"
    )


cte(
    "x_cut",
    r"""SELECT * FROM (SELECT *, regexp_replace(substr(t, 1, 12), '\s+$', '') AS lt, regexp_replace(substr(t, 13), '^\s+', '') AS rt FROM x_pdrafts WHERE pos % 10 = 5 AND length(t) > 12) WHERE lt <> '' AND rt <> ''""",
)


@query(
    "apply_splits",
    """SELECT doc_id, draft_id || '-a' AS draft_id, requirement_id || '-a' AS requirement_id, substr(lt, 1, 160) AS title, false AS superseded, included, 0 AS start_offset, length(lt) AS end_offset, lt AS exact_text FROM x_cut
UNION ALL SELECT doc_id, draft_id || '-b', requirement_id || '-b', substr(rt, 1, 160), false, included, length(t) - length(rt), length(t), rt FROM x_cut
UNION ALL SELECT x.doc_id, x.draft_id, x.requirement_id, x.title, c.pos IS NOT NULL, x.included AND c.pos IS NULL, 0, length(x.t), x.t FROM x_pdrafts x LEFT JOIN x_cut c USING (doc_id, pos)""",
)
def _split(spark, d):
    drafts = pdf_drafts(spark, d)
    splits = drafts.where("pos % 10 = 5").selectExpr("doc_id", "draft_id", "12 as split_offset", "'usr-2' as split_by")
    return D.apply_splits(drafts, splits).selectExpr(
        "doc_id", "draft_id", "requirement_id", "title", "superseded", "included", "text_ranges[0].start_offset as start_offset", "text_ranges[0].end_offset as end_offset",
        "text_ranges[0].exact_text as exact_text",
    )


cte(
    "x_blockers",
    """SELECT DISTINCT doc_id, requirement_id || ': ' || m AS message FROM (SELECT doc_id, requirement_id, unnest(list_filter([CASE WHEN included AND pos % 97 = 96 THEN 'included requirement must reference a PDF page.' END,
  CASE WHEN included AND approval <> 'approved' THEN 'included requirement needs an approved source.' END, CASE WHEN included AND decision = 'pending' THEN 'included draft must be accepted.' END,
  CASE WHEN NOT included AND dkind = 'candidate' AND decision = 'pending' THEN 'candidate must be classified, excluded, or deferred.' END], lambda b: b IS NOT NULL)) AS m FROM x_approved WHERE dkind <> 'structural')
UNION ALL SELECT doc_id, 'At least one included requirement is required.' FROM x_approved GROUP BY 1 HAVING count(*) FILTER (WHERE included AND dkind <> 'structural') = 0""",
)


@query("confirmation_blockers", "SELECT * FROM x_blockers")
def _blockers(spark, d):
    return D.confirmation_blockers(approved_drafts(spark, d), "pdf")


@query(
    "finalize_drafts",
    """SELECT doc_id, requirement_id, title, severity, CASE WHEN status IN ('informational', 'valid_requirement') THEN status ELSE 'requires_rule_configuration' END AS automation_status, approval,
  CASE WHEN pos % 97 = 96 THEN fragment_id ELSE 'page-' || page END AS section FROM x_approved WHERE included AND doc_id NOT IN (SELECT doc_id FROM x_blockers) AND doc_id % 10 <> 9""",
)
def _finalize(spark, d):
    drafts = approved_drafts(spark, d)
    ocr = tb.table(spark, d, "documents").where("doc_id % 10 = 9").select("doc_id")
    return D.finalize_drafts(drafts, D.confirmation_blockers(drafts, "pdf"), "pdf", ocr).select(
        "doc_id", "requirement_id", "title", "severity", "automation_status", "approval", "section"
    )


@query("fragment_map", "SELECT doc_id, requirement_id, fragment_id, 0 AS start_offset, length(t) AS end_offset, t AS exact_text FROM x_approved WHERE included")
def _map(spark, d):
    return D.fragment_map(approved_drafts(spark, d))


@query(
    "section_progress",
    """SELECT x.doc_id, coalesce(nullif(split_part(p.path, ' > ', 1), ''), 'Document') AS section, count(*) AS total, count(*) FILTER (WHERE approval = 'approved' AND decision <> 'pending') AS approved
FROM x_ddrafts x JOIN x_paths p USING (doc_id, pos) WHERE dkind <> 'structural' AND (included OR dkind = 'candidate') GROUP BY 1, 2""",
)
def _progress(spark, d):
    return D.section_progress(docx_drafts(spark, d), docx_fragments(spark, d))


@query(
    "filter_drafts",
    "SELECT 'blocked' AS filter, draft_id FROM x_approved WHERE dkind <> 'structural' AND included AND approval <> 'approved' UNION ALL SELECT 'excluded', draft_id FROM x_approved WHERE dkind <> 'structural' AND (NOT included OR dkind = 'excluded')",
)
def _filter(spark, d):
    drafts = approved_drafts(spark, d)
    return D.filter_drafts(drafts, "blocked").selectExpr("'blocked' as filter", "draft_id").unionByName(
        D.filter_drafts(drafts, "excluded").selectExpr("'excluded' as filter", "draft_id")
    )
