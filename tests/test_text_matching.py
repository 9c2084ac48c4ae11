"""Texts are matched in folded form, and paragraphs are made once."""

import re

import pytest

from modelgauge.operators import fragments as FR
from modelgauge.plans import documents as docs
from modelgauge.sources import testbed as tb

TEXTS = [
    "shall", "SHALL not", "ſhall", "muſt.", "must_", "xmust", "1must", "MÜSSEN", "müssenx", "DARF NICHT", "darf  nicht", "İst erforderlich", "i", "ı", "İ̇ te", "TE",
    "Ki", "iK", "NIJE DOPUŠTENO", "is required to", "ist " + "x" * 40 + " sicherzustellen", "IST " + "x" * 38 + " sicherzustellen", "istx sicherzustellen", "", None, "und", "häund", "das\nDAS",
]
TRIMMED = [" \t\x0b\x0c\r a b \x0c", "fxf", "a \u0085", "a  ", " ", "  ", "", None, " a ", "a\x1c ", "   a  "]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("words", [*FR.MANDATORY["docx"].values(), *(w for w, _ in FR.COMMON.values())])
def test_folded_words_answer_as_the_pattern(spark, words):
    rows = frame(spark, TEXTS).selectExpr("text", f"text rlike '{FR.word_regex(words)}' as a", f"exists(array({FR.folded('text')}), f -> {FR.mentions(words)}) as b").collect()
    assert [r.text for r in rows if r.a != r.b] == [] and any(r.a for r in rows)


def test_hints_and_likely_words(spark):
    found = {r.text: r.h for r in frame(spark, TEXTS).selectExpr("text", f"{FR.mandatory_hints('text', 'docx')} as h").collect()}
    assert found["ſhall"] == ["en"] and found["IST " + "x" * 38 + " sicherzustellen"] == ["de"] and found["ist " + "x" * 40 + " sicherzustellen"] == []
    assert found[None] == [] and found["istx sicherzustellen"] == [] and found["NIJE DOPUŠTENO"] == ["hr"]


def test_trimmed_answers_as_the_pattern(spark):
    rows = frame(spark, TRIMMED).selectExpr("text", "regexp_replace(text, '^\\\\s+|\\\\s+$', '') as a", f"{FR.trimmed('text')} as b").collect()
    assert [r for r in rows if r.a != r.b] == []


def test_no_pattern_runs_where_no_word_can_be(spark):
    text = FR.mandatory_hints("text", "docx")
    assert "(?iu)" not in text and len(re.findall("contains\\(", text)) >= len(re.findall(" rlike ", text))


def test_paragraphs_are_made_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(n, "en", "s", "\n".join(f"line {i}" for i in range(14))) for n in (0, 1, 2)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    reads, plain = [], FR.read_fragments
    monkeypatch.setattr(FR, "read_fragments", lambda *a: reads.append(1) or plain(*a))
    assert docs._progress(spark, str(tmp_path)).count() > 0
    assert docs.docx_fragments(spark, str(tmp_path)).count() == 42 and len(reads) == 1


def test_doors_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, 8)], "o_orderkey long, o_custkey long").selectExpr(
        "*", "1.0d as o_totalprice", "'F' as o_orderstatus", "'2-HIGH' as o_orderpriority", "'1996-01-01' as o_orderdate"
    ).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 5, 1), (2, None, 2), (3, 4, 1), (4, 4, 1), (4, 97, 2)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(5, 30), (4, 40), (97, 1)], "p_partkey long, p_size long").write.parquet(f"{d}/part.parquet")
    monkeypatch.setattr(tb, "DOOR_ROWS", 2)
    doors = tb.doors(spark, d)
    assert "hashpartitioning(o_custkey" in (plan := doors._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan and ", 4), REPARTITION_BY_NUM" in plan
    assert sorted((str(r.model_id), r.door_id) for r in doors.collect()) == [("None", "dr-4"), ("mdl-7", "dr-5"), ("mdl-8", "dr-4")]
