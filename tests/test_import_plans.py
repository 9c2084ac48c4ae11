"""Plans of the import stay small, whatever the number of their parts: rows are normalised once and letters are one literal."""

import unicodedata

from pyspark.sql import functions as F

from __spark_entry__ import queries
from modelgauge.operators import importer as IM

ROW = ("f", 1, "R-1", "Title", "room area", "critical", "office", "1,5", "m2", "Brief", "1")
NAMES = "file string, source_row long, id string, title string, type string, severity string, target_type string, minimum string, unit string, source_document string, source_section string"


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_finalize_normalises_once(spark):
    rows = [ROW, ("f", 2, *ROW[2:]), ("f", 3, "", *ROW[3:]), ("g", 4, "R-9", "T", "foo", *ROW[5:])]
    out = IM.finalize_package(IM.normalize_rows(spark.createDataFrame(rows, NAMES)))
    assert len(logical(out)) < 20_000
    assert sorted((r.file, r.source_row or 0, r.message) for r in out.collect()) == [
        ("f", 0, "Duplicate requirement ID: R-1"), ("f", 3, "Row 3: Requirement ID is required."), ("g", 4, "Row 4: warnings must be explicitly reviewed."),
    ]


def test_header_letters_are_one_literal(spark):
    words = ["Ⅷ Ärea", "ĳ", "½ m²", "㎡", "ﬁnal", "Quantité", None, "", "№ 5", "plain", "Σ"]
    df = IM.norm_headers(spark.createDataFrame([(w,) for w in words], "h string"), "h", "n")
    assert "str_to_map" in df._jdf.queryExecution().analyzed().toString()
    assert [r.n for r in df.collect()] == [IM.normalize_header_text(w) for w in words]
    assert unicodedata.normalize("NFKD", "㎡") == "m2"


def test_header_cells_meet_their_fields_where_they_are(spark):
    cells = [(f, "s", 1, c, h) for f in range(50) for c, h in enumerate(["ID", "req id", " ", None, "Title", "zzz"])]
    out = IM.suggest_mappings(spark.createDataFrame(cells, "file long, sheet string, row int, col int, header string"))
    assert "Generate" not in logical(out)
    got = {(r.col, r.field, r.confidence, r.accepted) for r in out.collect()}
    assert got == {(0, "id", "high", True), (1, None, "unmapped", False), (2, None, "unmapped", False), (3, None, "unmapped", False), (4, "title", "high", True), (5, None, "unmapped", False)}


def test_cells_meet_what_is_known_of_their_sheet_in_one_join(spark):
    cells = [(f, s, r, c, f"{f}{s}{r}{c}", c == 1, c == 1) for f in (1, 2, None) for s in ("A", "B") for r in (1, 2, 3) for c in (0, 1, 2)] + [(1, "A", 3, 1, "twice", True, False)]
    cells = spark.createDataFrame(cells, "file long, sheet string, row int, col int, display string, derived boolean, missing_formula_result boolean")
    fields = [(1, "A", 0, "id"), (1, "A", 2, "unit"), (1, "B", 1, "id"), (2, "A", 1, None), (None, "A", 0, "id")]
    fields = spark.createDataFrame(fields, "file long, sheet string, col int, field string")
    chosen = spark.createDataFrame([(1, "A", 1), (2, "A", 2), (None, "A", 1)], "file long, sheet string, header_row int")
    out = IM.grid_to_rows(cells, fields, chosen)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    got = sorted((r.file, r.source_row, r.empty, tuple(sorted(r["values"].items())), r.derived, r.formula_errors) for r in out.collect())
    assert got == [
        (1, 2, False, (("id", "1A20"), ("unit", "1A22")), [], []), (1, 3, False, (("id", "1A30"), ("unit", "1A32")), [], []), (2, 3, False, (), [], []),
    ]
    error = IM.grid_to_rows(cells.where("row < 3"), fields, chosen.withColumn("sheet", F.lit("B"))).where("file = 1").collect()
    assert [(r["values"], r.derived, r.formula_errors) for r in error] == [({"id": "1B21"}, ["id"], ["id: formula has no cached result."])]


def test_headers_are_detected_and_mapped_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(4,), (5,), (6,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 4), (2, 4), (8, 5), (9, 5), (11, None), (None, 6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    calls = []
    for name in ("detect_header", "suggest_mappings"):
        monkeypatch.setattr(IM, name, lambda df, f=getattr(IM, name), name=name: calls.append(name) or f(df))
    out = queries()["grid_to_rows"](spark, str(tmp_path))
    assert sorted(calls) == ["detect_header", "suggest_mappings", "suggest_mappings"]
    assert {(r.file, r.source_row, r.id) for r in out.collect()} == {(4, 5, "R-2"), (5, 12, "R-9")}
