"""Scalar column helpers shared by every operator.

Everything here is a native column expression, so it stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("pass", "fail", "unknown", "not_applicable")


def fmt_num_sql(x: str) -> str:
    """Render a double with all its digits: 15, 18.2, 0.00012345678901234, 1e-7, 1e+21.

    The shortest digits and the exponent come from the double's own text; this places the point. Exponent form is used below 1e-6 and from 1e21 on.
    """
    text = f"cast(abs({x}) as string)"
    part = lambda n: f"regexp_extract({text}, '^([0-9])[.]([0-9]+)E(-?[0-9]+)$', {n})"
    exponent, rest = f"try_cast({part(3)} as int)", f"if({part(2)} = '0', '', {part(2)})"
    digits = f"concat({part(1)}, {rest})"
    scientific = f"concat({part(1)}, if({part(2)} = '0', '', concat('.', {part(2)})), 'e', if({exponent} > 0, '+', ''), {exponent})"
    large = f"if(length({digits}) <= {exponent} + 1, rpad({digits}, {exponent} + 1, '0'), concat(left({digits}, {exponent} + 1), '.', substring({digits}, {exponent} + 2)))"
    placed = f"case when {exponent} < -6 or {exponent} >= 21 then {scientific} when {exponent} < 0 then concat('0.', repeat('0', -{exponent} - 1), {digits}) else {large} end"
    return (
        f"case when {x} = floor({x}) and abs({x}) < 1e15 then cast(try_cast({x} as bigint) as string)"
        f" when instr({text}, 'E') = 0 then cast({x} as string)"
        f" else concat(if({x} < 0, '-', ''), {placed}) end"
    )


def fmt_num(column: str) -> Column:
    return F.expr(fmt_num_sql(column))


def percent(numerator: Column, denominator: Column) -> Column:
    """Integer percent, half-up; NULL when the denominator is zero."""
    return F.when(
        denominator > 0,
        F.floor(numerator.cast("double") / denominator * F.lit(100.0) + F.lit(0.5)),
    ).cast("bigint")


def sorted_ids(ids: Column) -> Column:
    return F.array_sort(ids)


def finding_key(requirement_id: Column, rule_id: Column, ids: Column) -> Column:
    """Identity of a finding: requirement | rule | sorted element ids (not de-duplicated)."""
    return F.concat_ws("|", requirement_id, rule_id, F.array_join(sorted_ids(ids), ","))


def within(value: Column, low: Column, high: Column) -> Column:
    return (value >= low) & (high.isNull() | (value <= high))


def quantify(quantifier: Column, n_pass: Column, n_fail: Column, n_missing: Column) -> Column:
    """Three-valued decision of an `any` / `all` quantifier over element counts."""
    any_of = quantifier == "any"
    return (
        F.when(any_of & (n_pass > 0), "pass")
        .when(any_of & (n_missing == 0), "fail")
        .when(~any_of & (n_fail > 0), "fail")
        .when(~any_of & (n_missing == 0), "pass")
        .otherwise("unknown")
    )


def combine(operator: Column, statuses: Column) -> Column:
    """Three-valued AND / OR over an array of branch statuses."""
    has = lambda s: F.array_contains(statuses, s)
    every = lambda s: F.forall(statuses, lambda x: x == s)
    return (
        F.when((operator == "and") & has("fail"), "fail")
        .when((operator == "and") & every("pass"), "pass")
        .when(operator == "and", "unknown")
        .when(has("pass"), "pass")
        .when(every("fail"), "fail")
        .otherwise("unknown")
    )


def is_problem(status: Column) -> Column:
    return status.isin("fail", "unknown")


def outcome(n: Column, n_pass: Column, n_fail: Column, n_unknown: Column, n_na: Column) -> Column:
    """Requirement outcome from its result counts."""
    return (
        F.when(n == 0, "unknown")
        .when(n_fail > 0, "violation")
        .when(n_unknown > 0, "unknown")
        .when(n_na == n, "not_applicable")
        .when(n_pass == n, "compliant")
        .otherwise("unknown")
    )


def classify_finding(before: Column, after: Column) -> Column:
    """Delta kind of a finding; `before` and `after` are structs (NULL = absent)."""
    b, a = before["status"], after["status"]
    same = (b == a) & (before["severity"] == after["severity"]) & (before["summary"] == after["summary"])
    return (
        F.when(before.isNull(), "new")
        .when(after.isNull(), F.when(is_problem(b), "resolved").otherwise("unchanged"))
        .when(same, "unchanged")
        .when(is_problem(b) & ~is_problem(a), "resolved")
        .when(~is_problem(b) & (a == "fail"), "reopened")
        .when((b == "pass") & (a == "unknown"), "changed")
        .when((b != "fail") & (a == "fail"), "reopened")
        .otherwise("changed")
    )


def classify_outcome(before: Column, after: Column) -> Column:
    """Delta kind of a requirement outcome; NULL means the requirement is missing on that side."""
    return (
        F.when(before.isNull(), "added")
        .when(after.isNull(), "removed")
        .when(before == after, "unchanged")
        .when((before == "violation") & (after == "compliant"), "resolved")
        .when((before == "compliant") & (after == "violation"), "regressed")
        .otherwise("changed")
    )


def plural(n: Column, word: str) -> Column:
    """`1 word` / `2 words`."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def blank_to_null(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def iso_ts(c: Column) -> Column:
    """ISO-8601 text with milliseconds, UTC session zone assumed."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
