"""Deletion that follows foreign keys: which rows go when given rows go."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelgauge.functions.ordered import stored


@dataclass(frozen=True)
class Reference:
    """Rows of `child` whose `columns` equal a parent row's `to` go with it; a NULL among them refers to nothing."""

    child: str
    columns: tuple[str, ...]
    parent: str
    to: tuple[str, ...]


def walk(tables: Sequence[str], references: Sequence[Reference]) -> list[list[str]]:
    """Tables in groups, parents before children; tables that refer to each other in a circle (or to themselves) form one group."""
    below: dict[str, set[str]] = {t: set() for t in tables}
    for r in references:
        below[r.parent].add(r.child)

    def reach(start: str) -> set[str]:
        seen, open_ = set(), [start]
        while open_:
            for child in below[open_.pop()] - seen:
                seen.add(child)
                open_.append(child)
        return seen

    reached = {t: reach(t) for t in tables}
    groups: list[list[str]] = []
    for t in sorted(tables, key=lambda t: (-len(reached[t]), t)):  # a parent reaches all that its children reach, and them
        home = next((g for g in groups if t in reached[g[0]] and g[0] in reached[t]), None)
        groups.append([t]) if home is None else home.append(t)
    return groups


def cascade(tables: dict[str, DataFrame], ids: dict[str, Sequence[str]], references: Sequence[Reference], roots: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows of each table that go with the rows `roots` (by the id columns of their table).

    Every table is joined once for each of its references, parents first. A circle of tables is repeated with the rows found last
    until none is new, in as many rounds as the longest chain has rows. What is found is written, so that a row found over
    several references is one, and a child reads keys only.
    """
    doomed: dict[str, DataFrame] = {}
    needed = {t: sorted({*ids[t], *(c for r in references if r.parent == t for c in r.to)}) for t in tables}

    def hit(r: Reference, parents: DataFrame) -> DataFrame:
        named = parents.select(*(F.col(b).alias(a) for a, b in zip(r.columns, r.to, strict=True))).distinct()
        return tables[r.child].join(named, list(r.columns), "left_semi").select(*needed[r.child])

    def union(parts: list[DataFrame], table: str) -> DataFrame:
        out = tables[table].select(*needed[table]).limit(0)
        for p in parts:
            out = out.unionByName(p)
        return stored(out.dropDuplicates(list(ids[table])))

    for group in walk(list(tables), references):
        outside = [r for r in references if r.child in group and r.parent not in group]
        inside = [r for r in references if r.child in group and r.parent in group]
        fresh = {}
        for t in group:
            own = [tables[t].join(roots[t].select(*ids[t]), list(ids[t]), "left_semi").select(*needed[t])] if t in roots else []
            fresh[t] = doomed[t] = union(own + [hit(r, doomed[r.parent]) for r in outside if r.child == t], t)
        while inside and any(not f.isEmpty() for f in fresh.values()):
            found = {t: union([hit(r, fresh[r.parent]) for r in inside if r.child == t], t) for t in group}
            fresh = {t: stored(found[t].join(doomed[t].select(*ids[t]), list(ids[t]), "left_anti")) for t in group}
            doomed.update({t: doomed[t].unionByName(fresh[t].select(*doomed[t].columns)) for t in group})
    return {t: df.select(*ids[t]) for t, df in doomed.items()}
