"""Registered queries: readers over documents rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelgauge.plans.registry import query
from modelgauge.sources import readers as RD
from modelgauge.sources import testbed as tb


@query(
    "parse_spec_json",
    """SELECT o_orderkey AS spec_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Imported requirements' ELSE 'Pack ' || o_orderkey END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'Unspecified' ELSE 'R1' END AS revision,
  'A-' || o_orderkey AS requirement_id, 'minimum_room_area' AS type, floor(o_totalprice / 500) / 10 AS min_value FROM orders WHERE o_orderkey % 7 <> 0""",
)
def _spec_json(spark, d):
    """One package document per order; every third is a bare array, every seventh is broken."""
    req = "concat('[{\"id\":\"A-', o_orderkey, '\",\"title\":\"T\",\"type\":\"minimum_room_area\",\"severity\":\"info\",\"roomType\":\"office\",\"minAreaSqm\":', floor(o_totalprice / 500) / 10, '}]')"
    docs = tb.table(spark, d, "orders").selectExpr(
        "o_orderkey as spec_id",
        f"case when o_orderkey % 7 = 0 then '{{\"name\":' when o_orderkey % 3 = 0 then concat(' ', {req}) else concat('{{\"name\":\"Pack ', o_orderkey, '\",\"revision\":\"R1\",\"requirements\":', {req}, '}}') end as text",
    )
    packages, req_rows = RD.parse_spec_json(docs)
    return packages.where("error is null").select("spec_id", "name", "revision").join(req_rows, "spec_id").select(
        "spec_id", "name", "revision", "requirement_id", "type", "min_value"
    )


@query(
    "read_models",
    """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'broken' WHEN o_orderkey % 13 = 0 THEN 'typed' WHEN o_orderkey % 7 = 0 THEN 'bare' ELSE 'sound' END AS shape FROM orders)
SELECT k AS model_id, 'level' AS kind, 'l' AS id, 'Level ' || k AS name, NULL AS detail, 0 AS pos FROM o WHERE shape IN ('sound', 'bare')
UNION ALL SELECT k, 'room', 'r' || i, 'Room "' || i || '"', CASE i WHEN 0 THEN (k % 40) || '.5 ' || CASE WHEN k % 3 = 0 THEN 'null' ELSE 'd,e' END ELSE 'null ' END, i FROM o, (VALUES (0), (1)) t(i) WHERE shape IN ('sound', 'bare')
UNION ALL SELECT k, 'door', 'd', 'Tür', '0.9 null', 0 FROM o WHERE shape = 'sound'
UNION ALL SELECT k, 'violation', NULL, CASE shape WHEN 'bare' THEN 'Model schema error: levels, rooms and doors are required.' ELSE 'Invalid JSON. Please upload a valid JSON file.' END, NULL, NULL FROM o WHERE shape <> 'sound'""".join(("SELECT * FROM (", ")")),
)
def _models(spark, d):
    """A model document per order: sound ones, ones without doors, ones with a text for a list, ones cut off."""
    rooms = """concat('[{"id":"r0","name":"Room \\\\"0\\\\"","levelId":"l","roomType":"office","areaSqm":', o_orderkey % 40, '.5', if(o_orderkey % 3 = 0, '', ',"connectedDoorIds":["d","e"]'),
        '},{"id":"r1","name":"Room \\\\"1\\\\"","extra":[1],"connectedDoorIds":[]}]')"""
    doors = """case when o_orderkey % 13 = 0 then ',"doors":"none"}' when o_orderkey % 7 = 0 then '}' else ',"doors":[{"id":"d","name":"Tür","widthM":0.9}],"more":{}}' end"""
    whole = f"""concat('{{"levels":[{{"id":"l","name":"Level ', o_orderkey, '"}}],\n "rooms":', {rooms}, {doors})"""
    docs = tb.table(spark, d, "orders").selectExpr("o_orderkey as model_id", f"{whole} as text").selectExpr("model_id", "if(model_id % 11 = 0, left(text, 30), text) as text")
    found = RD.parse_models(docs)
    listed = lambda number, ids: f"concat(coalesce(cast({number} as string), 'null'), ' ', coalesce(array_join({ids}, ','), 'null')) as detail"
    shown = lambda df, kind, *columns: df.selectExpr("model_id", f"'{kind}' as kind", *columns)
    out = shown(found["levels"], "level", "level_id as id", "name", "cast(null as string) as detail", "cast(pos as int) as pos")
    out = out.unionByName(shown(found["rooms"], "room", "room_id as id", "name", listed("area_sqm", "door_ids"), "cast(pos as int) as pos"))
    out = out.unionByName(shown(found["doors"], "door", "door_id as id", "name", listed("width_m", "room_ids"), "cast(pos as int) as pos"))
    return out.unionByName(shown(found["violations"], "violation", "cast(null as string) as id", "message as name", "cast(null as string) as detail", "cast(null as int) as pos"))


def csv_texts(spark, d):
    text = (
        "concat(if(c_custkey % 2 = 0, '\\uFEFF', ''), case c_custkey % 11 when 1 then 'id,title,ID,type,severity' when 2 then 'id,title,type' else 'ID,Title,type, severity ,notes' end, '\\r\\n',"
        " if(c_custkey % 11 = 3, '', concat('R-', c_custkey, ', \"Door, \"\"', c_mktsegment, '\"\"\" ,door_width,warning,\"line one\\nline two\"\\n\\n ,,\\n')),"
        " if(c_custkey % 11 = 4, 'X,short\\n', ''), if(c_custkey % 11 = 5, '\"open', ''))"
    )
    return tb.table(spark, d, "customer").selectExpr("c_custkey as file", f"{text} as text")


@query(
    "check_spec_csv",
    """SELECT c_custkey AS file, CASE c_custkey % 11 WHEN 1 THEN 'Invalid CSV: duplicate header ''id''.' WHEN 2 THEN 'Invalid CSV: missing required header ''severity''.' WHEN 3 THEN 'Invalid CSV: at least one requirement row is required.'
  WHEN 4 THEN 'Invalid CSV: row 3 has 2 fields; expected 5.' ELSE 'Invalid CSV: a quoted field is not closed.' END AS message FROM customer WHERE c_custkey % 11 BETWEEN 1 AND 5""",
)
def _check_csv(spark, d):
    return RD.check_spec_csv(RD.parse_csv(csv_texts(spark, d)))


@query(
    "read_spec_csv",
    """SELECT c_custkey AS file, 2 AS source_row, 'R-' || c_custkey AS id, 'Door, "' || c_mktsegment || '"' AS title, 'warning' AS severity, 'line one' || chr(10) || 'line two' AS notes FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 11 > 5""",
)
def _csv(spark, d):
    parsed = RD.parse_csv(csv_texts(spark, d))
    sound = parsed.join(RD.check_spec_csv(parsed).select("file"), "file", "left_anti")
    return RD.csv_records(sound, ["id", "title", "severity", "notes"])


@query(
    "sanitize_file_names",
    r"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'upload.bin' WHEN 1 THEN p_name || '.ifc' WHEN 2 THEN 'a_b_' || p_partkey || '.pdf' WHEN 3 THEN repeat('n', 155) || '.docx' ELSE 'hidden' || p_partkey END AS safe FROM part""",
)
def _sanitize(spark, d):
    names = tb.table(spark, d, "part").selectExpr(
        "p_partkey",
        "case p_partkey % 5 when 0 then '../..' when 1 then concat('C:\\\\tmp/', p_name, '.ifc ') when 2 then concat('x/a<b>', p_partkey, '\\u0007.pdf') when 3 then concat(repeat('n', 200), '.docx') else concat('..hidden', p_partkey) end as n",
    )
    return names.selectExpr("p_partkey", f"{RD.sanitize_file_name('n')} as safe")


_UPLOADED = """SELECT doc_id, ['csv', 'model_json', 'pdf', 'ifc', 'tar'][doc_id // 8 % 5 + 1] AS kind, ['.csv', '.json', '.pdf', '.ifc', '.tar'][doc_id // 8 % 5 + 1] AS ext, [10, 5, 20, 20, 0][doc_id // 8 % 5 + 1] AS mb,
  ['zip', 'pdf', 'step', 'json', 'empty', 'unknown', 'text', 'text'][doc_id % 8 + 1] AS container FROM documents"""


@query(
    "screen_files",
    f"""SELECT doc_id, kind, container, CASE WHEN kind = 'tar' THEN 'Unknown upload kind.' WHEN doc_id % 11 = 0 THEN 'Only ' || ext || ' files are accepted.' WHEN doc_id % 13 = 0 THEN 'The declared content type is not allowed for this upload.'
  WHEN container = 'empty' THEN 'The uploaded file is empty.' WHEN doc_id % 17 = 0 THEN 'The file exceeds the ' || mb || ' MB limit.'
  WHEN NOT (kind = 'csv' AND container IN ('text', 'json') OR kind = 'model_json' AND container = 'json' OR kind = 'pdf' AND container = 'pdf' OR kind = 'ifc' AND container = 'step') THEN 'File content does not match its declared format.' END AS reason
FROM ({_UPLOADED})""",
)
def _screen(spark, d):
    """Documents as uploads of eight shapes and five kinds; some with another extension, content type or size than their kind allows."""
    of = lambda *names: f"element_at(array({', '.join(repr(n) for n in names)}), cast(floor(doc_id / 8) % 5 + 1 as int))"
    files = tb.table(spark, d, "documents").selectExpr(
        "doc_id", f"concat('up/', doc_id, if(doc_id % 11 = 0, '.txt', {of('.csv', '.json', '.PDF', '.ifc', '.tar')})) as file_name", f"{of('csv', 'model_json', 'pdf', 'ifc', 'tar')} as kind",
        "case when doc_id % 13 = 0 then 'image/png' when doc_id % 2 = 0 then 'application/octet-stream; q=1' end as mime",
        """case doc_id % 8 when 0 then concat(unhex('504B0304'), encode(text, 'UTF-8')) when 1 then encode(concat('%PDF-1.7 ', text), 'UTF-8') when 2 then encode(concat('iso-10303-21; ', text), 'UTF-8')
            when 3 then encode(concat(' {', text), 'UTF-8') when 4 then cast('' as binary) when 5 then concat(encode('x', 'UTF-8'), unhex('00'), encode(text, 'UTF-8')) else encode(concat('x', text), 'UTF-8') end as content""",
    ).withColumn("length", F.expr("if(doc_id % 17 = 0 and octet_length(content) > 0, 22020096, octet_length(content))"))
    out = RD.screen_files(files)
    return out.selectExpr("cast(regexp_extract(file_name, '([0-9]+)', 1) as bigint) as doc_id", "kind", "container", "reason")
