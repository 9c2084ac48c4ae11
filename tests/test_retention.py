"""Cascading deletion against a plain closure."""

import random

from modelgauge.operators.retention import Reference, cascade, walk

REFERENCES = [
    Reference("run", ("project", "owner"), "project", ("id", "owner")), Reference("review", ("run",), "run", ("id",)), Reference("evidence", ("run",), "run", ("id",)),
    Reference("evidence", ("review",), "review", ("id",)), Reference("run", ("base",), "run", ("id",)), Reference("hook", ("log",), "log", ("id",)), Reference("log", ("hook",), "hook", ("id",)),
    Reference("hook", ("project",), "project", ("id",)),
]


def test_walk_puts_parents_first():
    groups = walk(["evidence", "review", "run", "project", "hook", "log", "other"], REFERENCES)
    at = {t: i for i, g in enumerate(groups) for t in g}
    assert at["project"] < at["run"] < at["review"] < at["evidence"] and at["hook"] == at["log"] > at["project"] and len(groups) == 6


def test_cascade(spark):
    rng = random.Random(1)
    pick = lambda n: rng.choice([None, *range(n)])
    rows = {
        "project": ("id long, owner string", [(i, rng.choice("ab")) for i in range(12)]),
        "run": ("id long, project long, owner string, base long", [(i, pick(12), rng.choice(["a", "b", None]), pick(60)) for i in range(60)]),
        "review": ("id long, run long", [(i, pick(60)) for i in range(80)]),
        "evidence": ("id long, run long, review long", [(i, pick(60), pick(80)) for i in range(90)]),
        "hook": ("id long, project long, log long", [(i, pick(12) if i % 4 == 0 else None, pick(30)) for i in range(30)]),
        "log": ("id long, hook long", [(i, pick(30)) for i in range(30)]),
    }
    names = {t: [c.split()[0] for c in schema.split(", ")] for t, (schema, _) in rows.items()}
    value = lambda t, r, cs: tuple(r[names[t].index(c)] for c in cs)
    want = {t: set() for t in rows} | {"project": {2, 5}, "review": {7}}
    before = None
    while before != {t: len(s) for t, s in want.items()}:
        before = {t: len(s) for t, s in want.items()}
        for ref in REFERENCES:
            gone = {value(ref.parent, r, ref.to) for r in rows[ref.parent][1] if r[0] in want[ref.parent]}
            want[ref.child] |= {r[0] for r in rows[ref.child][1] if None not in value(ref.child, r, ref.columns) and value(ref.child, r, ref.columns) in gone}
    frames = {t: spark.createDataFrame(data, schema) for t, (schema, data) in rows.items()}
    roots = {"project": frames["project"].where("id in (2, 5)"), "review": frames["review"].where("id = 7")}
    got = cascade(frames, {t: ("id",) for t in rows}, REFERENCES, roots)
    assert {t: sorted(r.id for r in df.collect()) for t, df in got.items()} == {t: sorted(s) for t, s in want.items()}
    assert all(len(s) for s in want.values())
