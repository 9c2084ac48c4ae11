import json
import random
from collections import Counter

import fixtures as fx
from modelgauge.operators import exports, importer, ifc, lifecycle, trace
from modelgauge.sources import readers, step
from modelgauge.sources.heads import read_heads

HEADER = "ISO-10303-21;\nHEADER;\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n"
# Three small buildings of our own: an annex in millimetres, a tower whose doors sit in wall openings, a shed with a typed door.
ANNEX = r"""#900=IFCRELDEFINESBYPROPERTIES('ra',$,$,$,(#210,#211),#300);
#300=IFCPROPERTYSET('pa',$,'Pset_Space',$,(#301,#302));
#301=IFCPROPERTYSINGLEVALUE('Remark',$,IFCTEXT('as /* built */'),$);
#302=IFCPROPERTYSINGLEVALUE('NetFloorArea',$,IFCAREAMEASURE(27450000.),$);
/* #212=IFCSPACE('ghost',$,'ghost',$,$,$,$,'Office',.ELEMENT.,.INTERNAL.,0.); */
#210=IFCSPACE('sp-7',$,'0.07',$,$,$,$,'B\X\FCro 7; (west), d''Or',.ELEMENT.,.INTERNAL.,0.);
#211=IFCSPACE('sp-8',$,'0.08',$,$,$,$,'Meeting \S\D \X4\0001F600\X0\',.ELEMENT.,.INTERNAL.,0.);
#901=IFCRELDEFINESBYPROPERTIES('rb',$,$,$,(#77),#310);
#310=IFCPROPERTYSET('pb',$,'Pset_Door',$,(#311));
#311=IFCPROPERTYSINGLEVALUE('ClearWidth',$,IFCLENGTHMEASURE(1180.),$);
#77=IFCDOOR('dw',$,'Glass door west',$,$,$,$,$,$,$,.DOOR.,.DOUBLE_DOOR.,$);
#920=IFCRELSPACEBOUNDARY('x1',$,$,$,#210,#77,$,.PHYSICAL.,.INTERNAL.);
#921=IFCRELSPACEBOUNDARY('x2',$,$,$,#211,#77,$,.PHYSICAL.,.INTERNAL.);
#930=IFCRELCONTAINEDINSPATIALSTRUCTURE('x3',$,$,$,(#77,
  #211,#210),#4);
#4=IFCBUILDINGSTOREY('eg',$,'Erdgeschoss',$,$,$,$,$,.ELEMENT.,-150.);
#2=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.);
"""
TOWER = """#1=IFCBUILDINGSTOREY('t5',$,'Fifth',$,$,$,$,$,.ELEMENT.,17.5);
#2=IFCRELCONTAINEDINSPATIALSTRUCTURE('k1',$,$,$,(#61,#62,#81),#1);
#61=IFCSPACE('lab',$,'5.01',$,$,$,$,'Corridor east',.ELEMENT.,.INTERNAL.,0.);
#62=IFCSPACE('loo',$,'5.02',$,$,$,$,'Stockroom',.ELEMENT.,.INTERNAL.,0.);
#81=IFCDOOR('fire',$,'Fire door',$,$,$,$,$,2.3,1.27,.DOOR.,.Y.,$);
#5=IFCRELFILLSELEMENT('g1',$,$,$,#500,#81);
#6=IFCRELSPACEBOUNDARY('g2',$,$,$,#62,#500,$,.PHYSICAL.,.INTERNAL.);
#7=IFCRELSPACEBOUNDARY('g3',$,$,$,#61,#500,$,.PHYSICAL.,.INTERNAL.);
#8=IFCRELDEFINESBYPROPERTIES('g4',$,$,$,(#61),#9);
#9=IFCELEMENTQUANTITY('g5',$,'Qto',$,$,(#11,#10));
#10=IFCQUANTITYAREA('NetFloorArea',$,$,63.25,$);
#12=IFCRELDEFINESBYPROPERTIES('g6',$,$,$,(#1),#13);
#13=IFCELEMENTQUANTITY('g7',$,'Qto',$,$,(#14));
#14=IFCQUANTITYAREA('GrossFloorArea',$,$,410.,$);
#11=IFCQUANTITYAREA('GrossFloorArea',$,$,70.,$);
"""
SHED = """#11=IFCDOORTYPE('sliding',$,'Sliding',$,$,$,$,$,$,$,.DOOR.,.Z.,.F.,$);
#12=IFCRELDEFINESBYTYPE('m1',$,$,$,(#21,#22),#11);
#13=IFCRELDEFINESBYPROPERTIES('m2',$,$,$,(#11),#14);
#14=IFCPROPERTYSET('m3',$,'Pset_Type',$,(#15));
#15=IFCPROPERTYSINGLEVALUE('ClearWidth',$,IFCLENGTHMEASURE(2.4),$);
#21=IFCDOOR('front',$,'Front gate',$,$,$,$,$,3.,$,.DOOR.,.Z.,$);
#22=IFCDOOR('back',$,'Back gate',$,$,$,$,$,3.,$,.DOOR.,.Z.,$);
#31=IFCSPACE('hall',$,'H',$,$,$,$,'Stockroom hall',.ELEMENT.,.INTERNAL.,0.);
#32=IFCSPACE('loft',$,'L',$,$,$,$,'Loft',.ELEMENT.,.INTERNAL.,0.);
#41=IFCRELSPACEBOUNDARY('m4',$,$,$,#31,#21,$,.PHYSICAL.,.EXTERNAL.);
#42=IFCRELCONTAINEDINSPATIALSTRUCTURE('m5',$,$,$,(#31),#43);
#43=IFCBUILDINGSTOREY('yard',$,'Yard level',$,$,$,$,$,.ELEMENT.,0.);
"""


def test_ifc_files(spark, tmp_path):
    for name, body in {"annex": ANNEX, "tower": TOWER, "shed": SHED}.items():
        (tmp_path / f"{name}.ifc").write_text(HEADER + body + "ENDSEC;\nEND-ISO-10303-21;\n")
    (tmp_path / "bad.ifc").write_text("hello #1=IFCSPACE('x');")
    e = step.read_step_entities(spark, str(tmp_path)).cache()
    assert e.select("model_id").distinct().count() == 3
    levels, rooms, doors = ifc.normalize_model(e)
    room = {r.room_id: r for r in rooms.collect()}
    door = {r.door_id: r for r in doors.collect()}
    assert set(room) == {f"ifc:space:{n}" for n in ("sp-7", "sp-8", "lab", "loo", "hall", "loft")}
    west = room["ifc:space:sp-7"]
    assert (west.area_sqm, west.area_source, west.room_type, west.name) == (27.45, "property", "office", "Büro 7; (west), d'Or")
    assert room["ifc:space:sp-8"].name == "Meeting Ä 😀"
    assert list(west.door_ids) == ["ifc:door:dw"] and sorted(door["ifc:door:dw"].room_ids) == ["ifc:space:sp-7", "ifc:space:sp-8"]
    assert abs(door["ifc:door:dw"].width_m - 1.18) < 1e-12 and door["ifc:door:dw"].width_source == "property"
    assert (room["ifc:space:lab"].area_sqm, room["ifc:space:lab"].area_source) == (63.25, "quantity")
    assert sorted(door["ifc:door:fire"].room_ids) == ["ifc:space:lab", "ifc:space:loo"]
    assert door["ifc:door:front"].width_m == 2.4 == door["ifc:door:back"].width_m
    diag = {r.model_id.split("/")[-1]: r for r in ifc.ifc_diagnostics(e).collect()}
    assert (diag["tower.ifc"].direct_boundaries, diag["tower.ifc"].opening_boundaries) == (0, 2)
    assert (diag["tower.ifc"].area_quantities, diag["annex.ifc"].area_properties) == (2, 2)  # the storey's own area counts too
    t = diag["shed.ifc"]
    assert (t.width_types, t.inferred_door_storeys, t.unassigned_spaces, t.unassigned_doors, t.assumed) == (2, 1, 1, 1, True)
    assert {r.name for r in levels.collect()} == {"Erdgeschoss", "Fifth", "Yard level", "Unassigned IFC storey"}
    e.unpersist()


def test_large_step_file_feeds_many_tasks(spark, tmp_path):
    """Blocks of 300 bytes: borders fall into quotes and comments that hold ";", records span blocks; entities stay those of the whole text."""
    rng = random.Random(2)
    odd = ["'a;b'", "'it''s; /* no'", "/* c; '; */ $", "(1,(2,';'))", "'" + "; " * 400 + "'", "$", "/*" + ";'" * 301 + "*/ 7", "'*/'", "''", "'x'/* */"]
    body = "".join(f"#{n}={rng.choice(['IFCSPACE', 'IfcDoor'])}({','.join(rng.choices(odd, k=rng.randint(1, 6)))}){rng.choice(['', ' ', chr(10)])};{rng.choice(['', chr(10), '/* ; */'])}" for n in range(400))
    (tmp_path / "large.ifc").write_text(HEADER + body + "ENDSEC;\nEND-ISO-10303-21;\n")
    (tmp_path / "small.ifc").write_text(HEADER + "#1=IFCSPACE('s');ENDSEC;")
    (tmp_path / "other.ifc").write_text("#1=IFCSPACE('no header');" * 40)
    texts = [(n, (tmp_path / n).read_text()) for n in ("large.ifc", "small.ifc")]
    want = sorted((r.model_id, r.express_id, r.type, tuple(r.args)) for r in step.parse_step(spark.createDataFrame(texts, "model_id string, text string")).collect())
    assert len(want) == 401
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "64")
            got = step.read_step_entities(spark, str(tmp_path)).collect()
            assert sorted((r.model_id.split("/")[-1], r.express_id, r.type, tuple(r.args)) for r in got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_landing_zone_reads_heads_only(spark, tmp_path):
    files = {"a.csv": b"id,title\n", "b.csv": b"PK\x03\x04....", "c.csv": b"", "_tmp.csv": b"x", "d.json": b" {}", "e.csv": b"y" * 5000 + b"\0"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "sub").mkdir()
    with open(tmp_path / "sub" / "huge.csv", "wb") as f:  # sparse: 3 GB that nobody could hold in a row
        f.write(b"id,title\n")
        f.truncate(3 << 30)
    found = {r.file_name: (r.container, r.reason) for r in readers.screen_files(readers.landing_zone(spark, str(tmp_path), "csv")).collect()}
    assert found == {
        "a.csv": ("text", None), "b.csv": ("zip", "File content does not match its declared format."), "c.csv": ("empty", "The uploaded file is empty."), "d.json": ("json", "Only .csv files are accepted."),
        "e.csv": ("text", None), "huge.csv": ("unknown", "The file exceeds the 10 MB limit."),
    }
    heads = read_heads(spark, f"file://{tmp_path}", head=2, files=2)
    assert heads.rdd.getNumPartitions() == 3 and {len(r.head) for r in heads.collect()} == {0, 2}


def test_model_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"levels": [{"id": "l", "name": "L"}], "rooms": [{"id": "r", "name": "R", "levelId": "l", "roomType": "office"}, {"id": "q", "name": "Q", "levelId": "l", "roomType": "office", "connectedDoorIds": []}], "doors": [], "extra": 1}))
    (tmp_path / "b.json").write_text("{nope")
    got = readers.read_models(spark, str(tmp_path))
    rooms = {r.room_id: r.door_ids for r in got["rooms"].collect()}
    assert rooms == {"r": None, "q": []}
    assert [r.message for r in got["violations"].collect()] == ["Invalid JSON. Please upload a valid JSON file."]


def test_csv_parsing(spark):
    text = '﻿ID,Title,type,severity\r\nA, "x, ""y"" " ,t,info\n\nB,"two\nlines",t,info\n'
    df = spark.createDataFrame([("f", text), ("g", "id,title,type,severity\nA,b\n"), ("h", 'id,title,type,severity\n"A')], "file string, text string")
    parsed = readers.parse_csv(df)
    rows = [tuple(r) for r in readers.csv_records(parsed.where("file = 'f'"), ["id", "title"]).orderBy("source_row").collect()]
    assert rows == [("f", 2, "A", 'x, "y"'), ("f", 3, "B", "two\nlines")]
    more = [("e", ""), ("b", " \n\r\n"), ("c", 'id,title,type,severity\nA,"x\r\ny\x01z",t,info\r\nB,b,t,info')]
    parsed = parsed.union(readers.parse_csv(spark.createDataFrame(more, df.schema)))
    kept = readers.csv_records(parsed.where("file = 'c'"), ["title"]).orderBy("source_row").collect()
    assert [r.title for r in kept] == ["x\r\nyz", "b"]
    faults = {r.file: r.message for r in readers.check_spec_csv(parsed).collect()}
    assert faults == {"e": "Invalid CSV: the file is empty.", "b": "Invalid CSV: the file is empty.", "g": "Invalid CSV: row 2 has 2 fields; expected 4.", "h": "Invalid CSV: a quoted field is not closed."}


def test_numbers(spark):
    cases = {"12,5": 12.5, "90,0": 90.0, "1.234,5": 1234.5, "1,234.5": 1234.5, "1,234,567": None, "1e3": 1000.0, "0x10": None, "": None, " 1 000 ": 1000.0, ".5": 0.5}
    df = spark.createDataFrame([(k,) for k in cases], "x string").selectExpr("x", f"{importer.parse_number('x')} as v")
    assert {r.x: r.v for r in df.collect()} == cases


def test_import_units(spark):
    rows = [("f", 2, "A", "Office", "room area", "warning", "office", "12,5", None, "m2"), ("f", 3, "B", "Door", "door width", "warning", "office", "90,0", None, "cm"), ("f", 4, "C", "Door", "door width", "warning", "office", "900", "800", "mm")]
    df = spark.createDataFrame(rows, "file string, source_row long, id string, title string, type string, severity string, target_type string, minimum string, maximum string, unit string")
    got = {r.requirement_id: r for r in importer.normalize_rows(df).collect()}
    assert (got["A"].min_value, got["B"].min_value) == (12.5, 0.9)
    assert got["A"].errors == [] and "maxDoorWidthM" in got["C"].errors[0]


def test_traceability_metrics(spark):
    rows = fx.demo()
    q = fx.requirements(spark, rows)
    r, d = fx.models(spark, fx.DEMO_ROOMS, fx.DEMO_DOORS)
    from modelgauge.operators import rules

    f = rules.evaluate(r, d, q)
    reviews = spark.createDataFrame([("run", "A-STOCK", "waived", "ok", None), ("run", "HAS", "open", "", None)], "run_id string, requirement_id string, status string, comment string, decided_at timestamp")
    rows = trace.traceability(q, f, reviews)
    got = {m.metric: (m.numerator, m.denominator, m.percent) for m in trace.coverage_metrics(rows).collect()}
    assert got["rule_coverage"] == (4, 6, 67)
    assert got["evaluation_coverage"] == (4, 5, 80)
    assert got["review_completion"] == (1, 5, 20)
    assert got["source_traceability_coverage"] == (0, 6, 0)
    flat = trace.traceability_flat(rows, f)
    assert flat.count() == 14
    lines = exports.findings_csv(f)
    assert lines.count() == 14


def test_manifest(spark):
    import hashlib

    a = spark.createDataFrame([("b", "z", "1"), ("b", "a", "22")], "bundle_id string, path string, content string")
    entries = lifecycle.checksums(a)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sha(f"{sha('22')}:a:2|{sha('1')}:z:1")
    assert lifecycle.checksum_manifest(entries).first().package_sha256 == want
    changed = spark.createDataFrame([("b", "z", "9"), ("b", "n", "1")], a.schema)
    assert Counter(r.status for r in lifecycle.verify_manifest(changed, entries).collect()) == {"changed": 1, "missing": 1, "unexpected": 1}


def test_redaction_reaches_nested_values(spark):
    deep = json.dumps({"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}})
    fields = {"password": "p", "user": json.dumps({"name": "n", "password": "hunter2", "tags": [1, {"apiKey": "k"}]}), "list": json.dumps(list(range(51))), "few": "[1,2]", "long": "x" * 600, "odd": "{no json", "deep": deep, "none": None}
    got = lifecycle.redact(spark.createDataFrame([(1, fields), (2, None), (3, {})], "id long, m map<string,string>"), "m").orderBy("id").collect()
    one = got[0].m
    assert json.loads(one["user"]) == {"name": "n", "password": "[redacted]", "tags": [1, {"apiKey": "[redacted]"}]}
    assert (one["password"], one["list"], one["few"], one["odd"], one["none"]) == ("[redacted]", "[array of 51]", "[1,2]", "{no json", None)
    assert one["long"] == "x" * 500 + "…[truncated]" and "[truncated]" in one["deep"]
    assert got[1].m is None and got[2].m == {}


def test_blocks_are_cut_where_they_are_read(spark, tmp_path):
    body = "".join(f"#{i}=IFCSPACE('a;{i}',/* ; ' */$,'it''s\n{i}');\n" for i in range(4000))
    (tmp_path / "large.ifc").write_text(HEADER + body + "ENDSEC;\n")
    (tmp_path / "bad.ifc").write_text("x" * 50_000 + ";" + body)
    (tmp_path / "small.ifc").write_text(HEADER + "#1=IFCDOOR('d');")
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "60000")
    try:
        found = step.read_step_entities(spark, str(tmp_path))
        plan = step.whole_records(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset(key)
    assert "RepartitionByExpression" not in plan and spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    for name in ("large", "bad"):
        (tmp_path / f"{name}.ifc").unlink()  # what was cut is written: nothing reads the files any more
    rows = {(r.type, r.express_id): r.args for r in found.collect()}
    assert len(rows) == 4001 and rows["IFCDOOR", 1] == ["'d'"] and rows["IFCSPACE", 3999] == ["'a;3999'", "$", "'it''s\n3999'"]
