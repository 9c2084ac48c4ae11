"""Explicit schemas of the domain tables; readers never infer."""

from __future__ import annotations

import re

CONDITION = "struct<type:string,min:double,max:double,quantifier:string>"
SOURCE = "struct<document:string,section:string,revision:string>"
EVIDENCE = "struct<message:string,observed:string,expected:string,field:string>"

LEVELS = "model_id string, level_id string, name string, pos bigint"
ROOMS = (
    "model_id string, room_id string, name string, level_id string, room_type string,"
    " area_sqm double, door_ids array<string>, pos bigint"
)
DOORS = (
    "model_id string, door_id string, name string, level_id string, width_m double,"
    " room_ids array<string>, pos bigint"
)
REQUIREMENTS = (
    "spec_id string, requirement_id string, title string, type string, severity string, pos bigint,"
    " room_type string, min_value double, max_value double, quantifier string, operator string,"
    f" conditions array<{CONDITION}>, automation_status string, description string,"
    f" discipline string, unit string, quantity_type string, source {SOURCE},"
    " source_fragment_ids array<string>"
)
FINDINGS = (
    "run_id string, requirement_id string, rule_id string, requirement_title string,"
    " element_type string, status string, severity string, summary string,"
    f" affected_element_ids array<string>, evidence array<{EVIDENCE}>,"
    " req_pos bigint, element_pos bigint"
)
RUNS = "run_id string, project_id string, model_id string, spec_id string"
REVIEWS = (
    "run_id string, requirement_id string, decision_id string, status string, comment string,"
    " waiver_reason string, waiver_expires_at timestamp, reviewer_id string, decided_at timestamp"
)
POLICY = (
    "project_id string, block_on_new_critical boolean, block_on_decreased_coverage boolean,"
    " warn_on_new_unknown boolean, allow_waived_critical boolean,"
    " max_high_findings bigint, max_medium_findings bigint"
)


def names(ddl: str) -> list[str]:
    """Top-level column names of a DDL string; needs no session."""
    flat = ddl
    while "<" in flat:
        flat = re.sub(r"<[^<>]*>", "", flat)
    return [part.split()[0] for part in flat.split(",")]
