"""Chunked and multi-stage operators against brute force, with chunks small enough to matter."""

import random

import pandas as pd
from pyspark.sql import functions as F

from modelgauge.functions.skew import chunked_running_count, salted_join, top_per_key
from modelgauge.operators import fragments as FR
from modelgauge.operators import quota as Q


def test_list_numbering(spark):
    rng = random.Random(3)
    rows = [(d, ls, p, rng.randrange(4)) for d in (1, 2) for ls in (0, 1) for p in range(ls, 60, 2)]
    want, state = {}, {}
    for d, ls, p, lvl in sorted(rows):
        c = state.setdefault((d, ls), [])
        c.extend([0] * (lvl + 1 - len(c)))
        c[lvl] += 1
        c[lvl + 1:] = [0] * len(c[lvl + 1:])
        want[d, ls, p] = ".".join(map(str, c[: lvl + 1]))
    df = spark.createDataFrame(rows, "doc_id long, list_id long, pos long, level int")
    got = {(r.doc_id, r.list_id, r.pos): r.label for r in FR.number_items(df, chunk_rows=5).collect()}
    assert got == want


def test_heading_path(spark):
    rng = random.Random(5)
    rows = [(1, p, f"t{p}", rng.choice([None, None, 1, 2, 3, 4])) for p in range(50)]
    path, want = {}, {}
    for _, p, t, lvl in rows:
        if lvl:
            path = {k: v for k, v in path.items() if k < lvl} | {lvl: t}
        want[p] = [path[k] for k in sorted(path)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, exact_text string, heading_level int")
    got = {r.pos: list(r.heading_path) for r in FR.heading_path(df, chunk_rows=7).collect()}
    assert got == want


def test_running_count(spark):
    df = spark.range(200).selectExpr("id % 3 as k", "id as pos")
    got = chunked_running_count(df, ["k"], "pos", F.col("pos") % 5 == 0, "n", 10).collect()
    assert all(r.n == sum(1 for p in range(r.k, r.pos + 1, 3) if p % 5 == 0) for r in got) and len(got) == 200


def test_top_per_key_is_exact(spark):
    df = spark.range(500).selectExpr("'hot' as k", "id", "id % 7 as v")
    got = [r.id for r in top_per_key(df, ["k"], [F.col("v").desc(), F.col("id").desc()], 9, salts=4).collect()]
    want = sorted(range(500), key=lambda i: (-(i % 7), -i))[:9]
    assert sorted(got) == sorted(want)


def test_salted_join_matches_plain_join(spark):
    big = spark.range(100).selectExpr("id", "if(id < 60, 1, id) as k")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (70, "c")], "k long, t string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, salted_join(big, small, ["k"], ["id"], 4, how).select("id", "k", "t").collect()), key=str)
        assert got == sorted(map(tuple, big.join(small, "k", how).select("id", "k", "t").collect()), key=str)


def test_unsalted_join_copies_nothing(spark):
    big = spark.range(100).selectExpr("id", "if(id < 60, 1, id) as k")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (70, "c")], "k long, t string")
    for how in ("inner", "left", "left_anti"):
        df = salted_join(big, small, ["k"], ["id"], how=how)
        assert sorted(df.collect(), key=str) == sorted(big.join(small, "k", how).select(*df.columns).collect(), key=str)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def fold_quota(rows, width, limit):
    state, out = {}, {}
    for key, eid, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start, n = state.get(key, (None, 0))
        if start is None or ts >= start + width:
            start, n = ts, 0
        n += 1
        state[key] = (start, n)
        wait = 0 if n <= limit else max(1, -int(-(start + width - ts).total_seconds() // 1))
        out[eid] = (start, n, n <= limit, wait)
    return out


def quota_rows():
    rng = random.Random(11)
    base = pd.Timestamp("2024-01-01")
    return [(k, k * 1000 + i, base + pd.Timedelta(seconds=rng.randrange(4000) if i % 3 else rng.randrange(300))) for k in (1, 2, 3) for i in range(80)]


def test_quota_flags(spark):
    """Segments of a few events: windows that span segments, keys of one segment, events of one moment, a null key."""
    rows = quota_rows()
    rng = random.Random(12)
    base = pd.Timestamp("2024-02-01")
    rows += [(7, 7000 + i, base + pd.Timedelta(seconds=i // 3)) for i in range(200)]  # dense: 180 events a window
    rows += [(8, 8000 + i, base + pd.Timedelta(seconds=61 * i)) for i in range(50)]  # a window for each event
    rows += [(9, 9000 + i, base) for i in range(40)]
    rows += [(None, 9900 + i, base + pd.Timedelta(seconds=rng.choice([0, 59, 60, 61, 119, 120, 121, 400]) + 500 * (i // 30))) for i in range(90)]
    rows += [(10, 9999, base)]
    want = fold_quota([(k or 0, e, t) for k, e, t in rows], pd.Timedelta(seconds=60), 2)
    df = spark.createDataFrame([(k, e, t.to_pydatetime(), "x") for k, e, t in rows], "pos long, event_id long, us timestamp, seg string")
    for size in (5, Q.SEGMENT_EVENTS):
        found = Q.quota_flags(df, "pos", "us", 60, 2, segment_events=size).collect()
        assert {r.event_id: (pd.Timestamp(r.window_start), r.position, r.allowed, r.retry_after) for r in found} == want and len(found) == len(rows)
    assert Q.quota_flags(df.limit(0), "pos", "us", 60, 2).count() == 0


def page(spark, items):
    rows = [(1, 1, n, t, float(x), float(y), 60.0, 10.0) for n, (t, x, y) in enumerate(items)]
    return spark.createDataFrame(rows, "doc_id long, page int, item long, str string, x double, y double, width double, height double")


def test_page_lines_and_table(spark):
    items = [("1.1 Doors", 50, 700), ("Room", 50, 600), ("Width", 250, 601), ("Office", 50, 580), ("0.9", 250, 582), ("stray", 400, 500), ("x", 50, 502)]
    lines = FR.assemble_lines(page(spark, items)).orderBy("line").collect()
    assert [(r.line, r.text, r.n_items) for r in lines] == [(0, "1.1 Doors", 1), (1, "Room Width", 2), (2, "Office 0.9", 2), (3, "x stray", 2)]
    cells = FR.detect_tables(page(spark, items)).orderBy("row", "cell").collect()
    assert [(c.row, c.cell, c.text) for c in cells] == [(0, 0, "Room"), (0, 1, "Width"), (1, 0, "Office"), (1, 1, "0.9"), (2, 0, "x"), (2, 1, "stray")]
    assert FR.detect_tables(page(spark, items[:3])).count() == 0
    lost = FR.detect_tables(page(spark, [("a", 50, 10), ("b", 55, 10), ("c", 52, 30), ("d", 58, 30)])).collect()
    assert [(r.row, r.rejected) for r in lost] == [(None, 1)]
    mixed = FR.detect_tables(page(spark, [*items, ("p", 50, 300), ("q", 51, 301)])).orderBy("row", "cell").collect()
    assert [r.rejected for r in mixed] == [1, 0, 0, 0, 0, 0, 0]


def test_lines_on_pages(spark):
    rows = [(1, 1, 0, "b", 60.0, 700.0, 5.0, 10.0), (1, 1, 1, "a", 10.0, 702.0, 5.0, 10.0), (1, 2, 0, " ", 10.0, 5.0, 5.0, 5.0), (2, 1, 1, "second", 5.0, 5.0, 1.0, 1.0), (2, 1, 0, "first", 5.0, 5.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, item long, str string, x double, y double, width double, height double")
    assert sorted((r.doc_id, r.page, r.text, r.x, r.width) for r in FR.assemble_lines(df).collect()) == [(1, 1, "a b", 10.0, 55.0), (2, 1, "first second", 5.0, 1.0)]


def test_line_classes_and_hints(spark):
    cases = {
        "1.2 Doors are wide": "numbered_clause", "A.3 Text": "numbered_clause", "• item": "bullet_item", "Walls shall be solid": "mandatory_candidate",
        "Türen MÜSSEN breit sein": "mandatory_candidate", "émora": "mandatory_candidate", "GENERAL": "heading", "Section four": "heading", "Sectional view": "paragraph", "plain words": "paragraph",
    }
    df = spark.createDataFrame([(t,) for t in cases], "exact_text string").selectExpr("exact_text", f"{FR.classify_line()} as kind")
    assert {r.exact_text: r.kind for r in df.collect()} == cases
