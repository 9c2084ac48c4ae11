"""Audit, usage, plans, jobs, redaction and quota operators."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from modelgauge.functions.columns import finding_key, fmt_num_sql
from modelgauge.functions.skew import salted_join

MB, GB = 1024 * 1024, 1024 * 1024 * 1024
# Plan limits.
PLANS = {
    "starter": ("Starter", 2, 3, 25, 200 * MB, 10 * MB, 5, False, 30),
    "professional": ("Professional", 15, 15, 250, 5 * GB, 50 * MB, 100, True, 365),
    "enterprise": ("Enterprise", 500, 200, 10_000, 200 * GB, 100 * MB, 5_000, True, 2555),
}
PLAN_COLUMNS = "plan string, plan_name string, max_projects long, max_members long, max_runs long, max_storage long, max_file long, max_exports long, api_access boolean, retention_days long"
# Progress shown per job phase.
PROGRESS = {"queued": 5, "parsing": 40, "validating": 70, "persisting": 90, "completed": 100}
# Fixed value: keys whose values never reach a log.
SENSITIVE = "(?i)token|secret|password|authorization|api[-_]?key|cookie|session|email|content|base64|body|text|fragments|quote|snippet|comment|note"
_COVERED = re.compile(SENSITIVE)


def engine_notes(findings: DataFrame) -> DataFrame:
    """Engine evidence as technical notes, one row per evidence item."""
    return findings.select(
        "run_id", "requirement_id", "rule_id",
        finding_key(F.col("requirement_id"), F.col("rule_id"), F.col("affected_element_ids")).alias("finding_key"),
        F.posexplode("evidence").alias("i", "e"),
    ).selectExpr(
        "run_id", "requirement_id", "rule_id", "finding_key", "'technical_note' as kind", "concat('Engine evidence ', i + 1) as title", "'' as comment",
        "concat_ws(' · ', nullif(e.message, ''), concat('field=', e.field), concat('observed=', e.observed), concat('expected=', e.expected)) as technical_note",
    )


def normalize_decisions(rows: DataFrame) -> DataFrame:
    """Decision rows with coalesced ids, reviewer and time. Missing columns may be absent."""
    have = set(rows.columns)
    pick = lambda *cs: "coalesce(" + ", ".join([c for c in cs if c in have] + ["null"]) + ")"
    return rows.selectExpr(
        "run_id", "requirement_id", f"{pick('decision_id', 'id')} as decision_id", "status", f"coalesce({pick('comment')}, '') as comment",
        f"nullif({pick('waiver_reason')}, '') as waiver_reason", f"{pick('updated_by', 'reviewer_id')} as reviewer_id", f"{pick('decided_at', 'updated_at')} as decided_at",
        f"{pick('superseded_at')} is not null as superseded",
    )


def normalize_evidence(rows: DataFrame) -> DataFrame:
    empty = ("rule_id", "link_url", "technical_note", "model_element_id", "model_element_type", "file_name", "file_content_hash")
    return rows.selectExpr(
        "id", "run_id", "requirement_id", *[f"nullif({c}, '') as {c}" for c in empty], "kind", "coalesce(comment, '') as comment",
        "file_size_bytes", "created_by as author_id", "created_at",
    )


def audit_timeline(runs: DataFrame, history: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per audit event. Sort by (run_id, at) when written; no global sort here."""
    done = runs.selectExpr("run_id", "created_at as at", "'validation.completed' as type", "run_id as subject_id", "cast(null as string) as detail", "cast(null as string) as actor_id")
    decisions = history.selectExpr(
        "run_id", "decided_at as at", "if(superseded_at is null, 'review.decision.current', 'review.decision.superseded') as type",
        "decision_id as subject_id", "concat(requirement_id, ':', status) as detail", "reviewer_id as actor_id",
    )
    attached = evidence.selectExpr("run_id", "created_at as at", "'evidence.attached' as type", "id as subject_id", "kind as detail", "created_by as actor_id")
    return done.unionByName(decisions).unionByName(attached)


def checksums(artefacts: DataFrame) -> DataFrame:
    """(bundle_id, path, sha256, bytes) of artefacts (bundle_id, path, content)."""
    content = F.col("content").cast("binary")
    return artefacts.select("bundle_id", "path", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("bytes"))


def checksum_manifest(entries: DataFrame) -> DataFrame:
    """Package hash per bundle over `sha:path:bytes` in path order. Only the short entries are grouped,
    never the contents; a bundle's manifest is one document by definition."""
    return (
        entries.groupBy("bundle_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("path", "sha256", "bytes"))).alias("_e"),
            F.count(F.lit(1)).alias("files"),
            F.sum("bytes").alias("total_bytes"),
        )
        .withColumn("package_sha256", F.expr("sha2(array_join(transform(_e, e -> concat(e.sha256, ':', e.path, ':', e.bytes)), '|'), 256)"))
        .drop("_e")
    )


def verify_manifest(artefacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """ok / changed / missing / unexpected per path."""
    now = checksums(artefacts).withColumnsRenamed({"sha256": "_now", "bytes": "_bytes"})
    status = (
        F.when(F.col("_now").isNull(), "missing")
        .when(F.col("sha256").isNull(), "unexpected")
        .when((F.col("_now") == F.col("sha256")) & (F.col("_bytes") == F.col("bytes")), "ok")
        .otherwise("changed")
    )
    return manifest.join(now, ["bundle_id", "path"], "full").select("bundle_id", "path", status.alias("status"))


def usage_by_month(events: DataFrame) -> DataFrame:
    """Runs, exports and stored bytes per (user, month)."""
    return events.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.sum(F.when(F.col("kind") == "run", F.col("amount")).otherwise(0)).alias("validation_runs"),
        F.sum(F.when(F.col("kind") == "export", F.col("amount")).otherwise(0)).alias("audit_exports"),
        F.sum(F.when(F.col("kind") == "bytes", F.col("amount")).otherwise(0)).alias("storage_bytes"),
    )


def model_json_bytes(levels: DataFrame, rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """Size of each model's JSON document, summed from its elements; the document is never assembled."""
    size = lambda fields: f"octet_length(to_json(named_struct({fields})))"
    opt = lambda name, value: f"coalesce(octet_length(concat(',\"{name}\":', {value})), 0)"
    parts = (
        levels.selectExpr("model_id", "0 as k", f"{size(chr(39) + 'id' + chr(39) + ', level_id, ' + chr(39) + 'name' + chr(39) + ', name')} as n")
        .unionByName(
            rooms.selectExpr(
                "model_id", "1 as k",
                size("'id', room_id, 'name', name, 'levelId', level_id, 'roomType', room_type")
                + f" + {opt('areaSqm', fmt_num_sql('area_sqm'))} + {opt('connectedDoorIds', 'to_json(door_ids)')} as n",
            )
        )
        .unionByName(
            doors.selectExpr(
                "model_id", "2 as k", size("'id', door_id, 'name', name, 'levelId', level_id") + f" + {opt('widthM', fmt_num_sql('width_m'))} as n"
            )
        )
    )
    # Elements of one array are separated by commas.
    per_kind = [F.count_if(F.col("k") == k) for k in range(3)]
    commas = sum((F.greatest(c - 1, F.lit(0)) for c in per_kind), F.lit(0))
    return parts.groupBy("model_id").agg((F.sum("n") + commas + F.lit(len('{"levels":[],"rooms":[],"doors":[]}'))).alias("bytes"))


def storage_usage(projects: DataFrame, models: DataFrame, evidence: DataFrame, jobs: DataFrame, counters: DataFrame) -> DataFrame:
    """Bytes per owner over live projects: models + evidence + live jobs; at least the stored counter.

    Inputs: models(project_id, bytes), evidence(project_id, bytes), jobs(project_id, status, bytes),
    counters(user_id, storage_bytes)."""
    rows = (
        models.select("project_id", "bytes")
        .unionByName(evidence.select("project_id", "bytes"))
        .unionByName(jobs.where(F.col("status").isin("queued", "processing")).select("project_id", "bytes"))
        .groupBy("project_id")
        .agg(F.sum("bytes").alias("bytes"))
    )
    live = projects.where(F.col("deleted_at").isNull()).select(F.col("owner_id").alias("user_id"), "project_id")
    estimate = live.join(rows, "project_id", "left").groupBy("user_id").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("estimate"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return estimate.join(counters, "user_id", "full").select(
        "user_id", F.greatest(zero(F.col("estimate")), zero(F.col("storage_bytes"))).alias("storage_bytes")
    )


def plan_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PLANS.items()], PLAN_COLUMNS)


def plan_violations(usage: DataFrame, accounts: DataFrame, plans: DataFrame) -> DataFrame:
    """Exceeded limits per user. `usage`: user_id, projects, seats, runs, exports, storage, file_bytes, wants_api.
    Users without an account row, or with an unknown plan, are on the starter plan."""
    named = usage.join(accounts.select("user_id", "plan"), "user_id", "left")
    known = ", ".join(f"'{p}'" for p in PLANS)
    judged = named.withColumn("plan", F.expr(f"if(plan in ({known}), plan, 'starter')")).join(plans, "plan")
    checks = [
        ("projects", "projects >= max_projects", "max_projects"), ("seats", "seats >= max_members", "max_members"),
        ("validation_runs", "runs >= max_runs", "max_runs"), ("audit_exports", "exports >= max_exports", "max_exports"),
        ("file_size", "file_bytes > max_file", "max_file"), ("storage", "storage + file_bytes > max_storage", "max_storage"),
        ("api_access", "wants_api and not api_access", "cast(0 as bigint)"),
    ]
    items = ", ".join(f"if({c}, struct('{n}' as limit_name, {lim} as limit_value), null)" for n, c, lim in checks)
    return judged.selectExpr("user_id", "plan", f"inline(array_compact(array({items})))")


def format_bytes(n: str) -> str:
    """SQL text of a byte count as B / KB / MB / GB."""
    return (
        f"case when {n} < 1024 then concat({n}, ' B') when {n} < {MB} then concat(format_string('%.0f', {n} / 1024D), ' KB')"
        f" when {n} < {GB} then concat(format_string('%.1f', {n} / {MB}D), ' MB') else concat(format_string('%.1f', {n} / {GB}D), ' GB') end"
    )


# Limits of a logged value.
LOGGED_CHARS, LOGGED_ITEMS, LOGGED_DEPTH = 500, 50, 6


def masked(value, level: int):
    """A logged JSON value `level` steps inside its record: texts cut, long arrays counted, sensitive keys covered at any depth."""
    if level > LOGGED_DEPTH:
        return "[truncated]"
    match value:
        case str() if len(value) > LOGGED_CHARS:
            return value[:LOGGED_CHARS] + "…[truncated]"
        case list() if len(value) > LOGGED_ITEMS:
            return f"[array of {len(value)}]"
        case list():
            return [masked(v, level + 1) for v in value]
        case dict():
            return {k: "[redacted]" if _COVERED.search(k) else masked(v, level + 1) for k, v in value.items()}
    return value


def _masked_text(text: str | None) -> str | None:
    """A field's text; JSON objects and arrays are walked, anything else is a plain text."""
    if text is None:
        return None
    try:
        value = json.loads(text) if text.lstrip()[:1] in ("{", "[") else text
    except ValueError:
        value = text
    shown = masked(value, 1)
    return shown if isinstance(shown, str) else json.dumps(shown, ensure_ascii=False, separators=(",", ":"))


def redact(rows: DataFrame, map_col: str) -> DataFrame:
    """Values of sensitive keys are replaced, also inside values that are JSON objects or arrays; texts are capped at 500 characters and arrays
    of more than 50 items become a count. Map values without brackets stay in the JVM."""

    @pandas_udf("map<string,string>")
    def walk(fields: pd.Series) -> pd.Series:
        return fields.map(lambda m: None if m is None else {k: _masked_text(v) for k, v in (m.items() if isinstance(m, dict) else m)})

    nested = F.expr(f"map_filter({map_col}, (k, v) -> not k rlike '{SENSITIVE}' and ltrim(v) rlike '^[\\\\[{{]')")
    plain = F.expr(
        f"""transform_values({map_col}, (k, v) -> case when k rlike '{SENSITIVE}' then '[redacted]'
            when length(v) > {LOGGED_CHARS} then concat(substring(v, 1, {LOGGED_CHARS}), '…[truncated]') else v end)"""
    )
    walked = rows.withColumn("_nested", F.when(F.size(nested) > 0, nested)).withColumn("_nested", walk("_nested")).withColumn("_plain", plain)
    return walked.withColumn(
        map_col, F.when(F.col("_nested").isNull(), F.col("_plain")).otherwise(F.expr("transform_values(_plain, (k, v) -> coalesce(_nested[k], v))"))
    ).drop("_nested", "_plain")


def retry_plan(rows: DataFrame) -> DataFrame:
    """Delay and state after the `attempts`-th failed attempt. kind: job (with max_attempts, retryable) or delivery."""
    return rows.selectExpr(
        "*",
        """case when kind = 'job' then if(retryable and attempts < max_attempts, 'queued', 'failed') else if(attempts >= 8, 'failed', 'pending') end as next_state""",
        """case when kind = 'job' then if(retryable and attempts < max_attempts, cast(15 * pow(2, attempts - 1) as bigint), null)
             else cast(least(3600, 30 * pow(2, attempts - 1)) as bigint) end as delay_seconds""",
        "kind = 'job' and retryable and attempts >= max_attempts as dead_lettered",
    )


def classify_error(status: str, message: str) -> tuple[str, str]:
    """SQL texts (retryable, shown message): 429 and 5xx retry; without a status, network-like messages retry."""
    network = f"{message} rlike '(?i)fetch failed|network|ECONNRESET|ETIMEDOUT|socket'"
    retry = f"case when {status} is not null then {status} = 429 or {status} >= 500 else coalesce({network}, false) end"
    shown = (
        f"case when {status} is not null then {message} when {network} then 'A transient network error interrupted the job.'"
        f" else coalesce({message}, 'The job failed unexpectedly.') end"
    )
    return retry, shown


def job_backlog(jobs: DataFrame, now: str) -> DataFrame:
    """Backlog state and progress of each job; `now` is a SQL timestamp expression."""
    cases = " ".join(f"when '{p}' then {v}" for p, v in PROGRESS.items())
    return jobs.selectExpr(
        "*",
        f"""case when status = 'queued' and next_run_at <= {now} then 'due'
            when status = 'processing' and lease_expires_at < {now} then if(attempts + 1 >= max_attempts, 'dead_letter', 'stale_lease')
            when status = 'processing' and started_at is not null and timestampdiff(SECOND, started_at, {now}) > timeout_seconds then 'timed_out'
            else status end as backlog""",
        f"case phase {cases} end as progress_percent",
    )


def cleanup_candidates(jobs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    return jobs.where(
        f"status in ('failed', 'cancelled', 'completed') and finished_at < timestampadd(HOUR, -{hours}, {now}) and (has_payload or has_state)"
    )


def fan_out(events: DataFrame, subs: DataFrame, now: str) -> DataFrame:
    """One delivery per (event, enabled, unrevoked, unexpired subscription of the event type), met by project and event type; events of a
    busy project are salted by their id."""
    live = subs.where(f"enabled and revoked_at is null and (expires_at is null or expires_at > {now})")
    wanted = live.selectExpr("webhook_id", "project_id", "explode(array_distinct(events)) as event_type")
    return salted_join(events, wanted, ["project_id", "event_type"], ["event_id"]).select("event_id", "webhook_id", "project_id", "event_type")
