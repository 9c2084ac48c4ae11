"""File readers: model and package JSON, specification CSV, and the intake screening of a landing zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgauge import schemas
from modelgauge.sources.heads import read_heads

_LEVEL = "struct<id:string,name:string>"
_ROOM = "struct<id:string,name:string,levelId:string,roomType:string,areaSqm:double,connectedDoorIds:array<string>>"
_DOOR = "struct<id:string,name:string,levelId:string,widthM:double,connectedRoomIds:array<string>>"
MODEL_JSON = f"levels array<{_LEVEL}>, rooms array<{_ROOM}>, doors array<{_DOOR}>, _corrupt_record string"
_CONDITION = "struct<type:string,minAreaSqm:double,maxAreaSqm:double,minDoorWidthM:double,maxDoorWidthM:double,quantifier:string>"
_REQUIREMENT = (
    "struct<id:string,title:string,type:string,severity:string,roomType:string,minAreaSqm:double,maxAreaSqm:double,minDoorWidthM:double,"
    f"maxDoorWidthM:double,quantifier:string,operator:string,conditions:array<{_CONDITION}>,automationStatus:string,description:string,"
    f"discipline:string,unit:string,quantityType:string,source:{schemas.SOURCE},sourceFragmentIds:array<string>>"
)

MB = 1024 * 1024
_ANY = "application/octet-stream"
# What each kind of upload may be.
UPLOADS = {
    "ifc": (20 * MB, ".ifc", ["application/x-step", "application/step", "model/ifc", "text/plain", _ANY], ["step"]),
    "model_json": (5 * MB, ".json", ["application/json", "text/json", _ANY], ["json"]),
    "xlsx": (10 * MB, ".xlsx", ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", _ANY], ["zip"]),
    "docx": (15 * MB, ".docx", ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", _ANY], ["zip"]),
    "pdf": (20 * MB, ".pdf", ["application/pdf", _ANY], ["pdf"]),
    "csv": (10 * MB, ".csv", ["text/csv", "application/csv", "text/plain", _ANY], ["text", "json"]),
}


def parse_models(docs: DataFrame) -> dict[str, DataFrame]:
    """levels, rooms, doors and violations of normalised-model documents (model_id, text).

    A missing list stays NULL (unlike an empty one); unknown keys are dropped; a document that is no JSON object, or has a value of
    another type than the model's, becomes a violation row and gives no elements.
    """
    parsed = docs.select("model_id", F.from_json("text", MODEL_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("m"))
    parsed = parsed.select("model_id", F.coalesce(F.col("m._corrupt_record").isNotNull() | F.col("m").isNull(), F.lit(True)).alias("broken"), "m.levels", "m.rooms", "m.doors")

    def rows(column: str, fields: str) -> DataFrame:
        return parsed.where("not broken").selectExpr("model_id", f"posexplode({column}) as (pos, e)").selectExpr("model_id", *fields.split("; "), "cast(pos as bigint) as pos")

    return {
        "levels": rows("levels", "e.id as level_id; e.name as name"),
        "rooms": rows("rooms", "e.id as room_id; e.name as name; e.levelId as level_id; e.roomType as room_type; e.areaSqm as area_sqm; e.connectedDoorIds as door_ids"),
        "doors": rows("doors", "e.id as door_id; e.name as name; e.levelId as level_id; e.widthM as width_m; e.connectedRoomIds as room_ids"),
        "violations": parsed.where("broken or levels is null or rooms is null or doors is null").selectExpr(
            "model_id", "if(broken, 'Invalid JSON. Please upload a valid JSON file.', 'Model schema error: levels, rooms and doors are required.') as message"
        ),
    }


def read_models(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """`parse_models` of the files under `path`; model_id is the file path."""
    return parse_models(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("model_id"), F.col("value").alias("text")))


def parse_spec_json(docs: DataFrame, id_col: str = "spec_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(packages, requirements) of package documents; a bare requirement array is a legacy package."""
    package = f"struct<name:string,revision:string,requirements:array<{_REQUIREMENT}>>"
    trimmed = f"regexp_replace({text_col}, '^\\\\s+', '')"
    parsed = docs.selectExpr(
        f"{id_col} as spec_id",
        f"if({trimmed} like '[%', named_struct('name', 'Imported requirements', 'revision', 'Unspecified', 'requirements',"
        f" from_json({text_col}, 'array<{_REQUIREMENT}>')), from_json({text_col}, '{package}')) as p",
    )
    packages = parsed.selectExpr(
        "spec_id", "trim(p.name) as name", "trim(p.revision) as revision", "size(p.requirements) as n_requirements",
        "case when p.requirements is null then 'Specification package schema error: requirements are missing.'"
        " when coalesce(trim(p.name), '') = '' or coalesce(trim(p.revision), '') = '' then 'Specification package schema error: name and revision are required.' end as error",
    )
    req = parsed.where("p.requirements is not null").selectExpr("spec_id", "posexplode(p.requirements) as (pos, r)").selectExpr(
        "spec_id", "r.id as requirement_id", "r.title as title", "r.type as type", "r.severity as severity", "cast(pos as bigint) as pos", "r.roomType as room_type",
        "coalesce(r.minAreaSqm, r.minDoorWidthM) as min_value", "coalesce(r.maxAreaSqm, r.maxDoorWidthM) as max_value", "r.quantifier as quantifier", "r.operator as operator",
        "transform(r.conditions, c -> struct(c.type as type, coalesce(c.minAreaSqm, c.minDoorWidthM) as min, coalesce(c.maxAreaSqm, c.maxDoorWidthM) as max, c.quantifier as quantifier)) as conditions",
        "r.automationStatus as automation_status", "r.description as description", "r.discipline as discipline", "r.unit as unit", "r.quantityType as quantity_type", "r.source as source",
        "r.sourceFragmentIds as source_fragment_ids",
    )
    return packages, req


def read_spec_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("spec_id"), F.col("value").alias("text"))
    return parse_spec_json(docs)




def read_spec_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, fields): non-blank CSV records with trimmed fields, in file order; the header is the first.

    A specification file holds at most 1,000 rows, so a file is one row until its records are exploded."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_csv(texts)


def parse_csv(texts: DataFrame) -> DataFrame:
    """Records of (file, text): quotes may hold commas, line breaks (kept as they are) and doubled quotes; a BOM and the two
    control characters that serve as marks here are dropped. A file without records has one row with line and fields NULL."""
    # Quoted stretches are masked first: outside quotes commas and breaks become control characters.
    body = "regexp_replace(translate(text, '\\u0001\\u0002', ''), '^\\uFEFF', '')"
    parts = f"split({body}, '\"')"
    outside = "translate(replace(p, '\\r\\n', '\\n'), ',\\r\\n', '\\u0001\\u0002\\u0002')"
    # Even pieces lie outside quotes; an empty piece between two quoted ones is a doubled quote.
    masked = f"array_join(transform({parts}, (p, i) -> if(i % 2 = 1, p, if(p = '' and i > 0 and i < size({parts}) - 1, '\"', {outside}))), '')"
    fields = "transform(split(r, '\\u0001'), f -> regexp_replace(f, '^\\\\s+|\\\\s+$', ''))"
    kept = f"filter(transform(split({masked}, '\\u0002'), r -> {fields}), fs -> exists(fs, f -> f <> ''))"
    return texts.selectExpr("file", f"size({parts}) % 2 = 0 as unclosed", f"posexplode_outer({kept}) as (line, fields)")


def check_spec_csv(records: DataFrame) -> DataFrame:
    """(file, message): structural faults of CSV files read by `parse_csv`. Row numbers count kept records."""
    first = records.groupBy("file").agg(
        F.min_by("fields", "line").alias("header"), F.min("line").alias("header_line"), F.count("line").alias("n"), F.bool_or("unclosed").alias("unclosed")
    )
    heads = "transform(header, h -> lower(h))"
    faults = first.selectExpr(
        "file",
        f"""case when n = 0 then 'Invalid CSV: the file is empty.' when unclosed then 'Invalid CSV: a quoted field is not closed.'
            when size(array_distinct({heads})) < size(header) then concat("Invalid CSV: duplicate header '", filter({heads}, (h, i) -> array_position({heads}, h) <= i)[0], "'.")
            when size(array_except(array('id', 'title', 'type', 'severity'), {heads})) > 0
              then concat("Invalid CSV: missing required header '", array_except(array('id', 'title', 'type', 'severity'), {heads})[0], "'.")
            when n < 2 then 'Invalid CSV: at least one requirement row is required.' end as message""",
    )
    ragged = (
        records.join(first.selectExpr("file", "header_line", "size(header) as width"), "file")
        .where("line > header_line and size(fields) <> width")
        .groupBy("file")
        .agg(F.min(F.struct("line", F.size("fields").alias("got"), "width", "header_line")).alias("r"))
        .selectExpr("file", "concat('Invalid CSV: row ', r.line - r.header_line + 1, ' has ', r.got, ' fields; expected ', r.width, '.') as ragged")
    )
    return faults.join(ragged, "file", "left").selectExpr("file", "coalesce(message, ragged) as message").where("message is not null")


def csv_records(records: DataFrame, columns: list[str]) -> DataFrame:
    """(file, source_row, columns...) of the data rows, fields found by lower-cased header name."""
    heads = records.groupBy("file").agg(F.min("line").alias("_hl"), F.transform(F.min_by("fields", "line"), lambda h: F.lower(h)).alias("_h"))
    body = records.join(heads, "file").where("line > _hl")
    return body.selectExpr(
        "file", "line - _hl + 1 as source_row", *[f"coalesce(get(fields, cast(array_position(_h, '{c}') - 1 as int)), '') as {c}" for c in columns]
    )


def sanitize_file_name(name: str) -> str:
    """SQL text: base name without control or reserved characters, at most 160 characters, extension kept."""
    base = f"element_at(split({name}, '[\\\\\\\\/]'), -1)"
    c = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({base}, '[\\\\x00-\\\\x1f\\\\x7f]', ''), '[<>:\"|?*]', '_'), '^[.]+', ''), '^\\\\s+|\\\\s+$', '')"
    dot = f"length({c}) - instr(reverse({c}), '.')"
    ext = f"if(instr({c}, '.') > 0 and {dot} > 0, left(substring({c}, {dot} + 1), 16), '')"
    return f"case when coalesce({c}, '') = '' then 'upload.bin' when length({c}) <= 160 then {c} else concat(left({c}, 160 - length({ext})), {ext}) end"


def detect_container(content: str) -> str:
    """SQL text: container format from the leading 4096 bytes of a binary expression (all of the content, or only its head)."""
    head = f"decode(substring({content}, 1, 4096), 'ISO-8859-1')"
    return f"""case when octet_length({content}) = 0 then 'empty'
        when hex(substring({content}, 1, 3)) in ('504B03', '504B05', '504B07') and octet_length({content}) >= 4 then 'zip'
        when {head} like '%PDF-%' escape '!' and substring({head}, 1, 5) = '%PDF-' then 'pdf' when contains(upper({head}), 'ISO-10303-21') then 'step'
        when {head} rlike '^[\\\\s\\\\u00EF\\\\u00BB\\\\u00BF]*[\\\\[{{]' then 'json' when instr({head}, '\\u0000') > 0 then 'unknown' else 'text' end"""


def screen_files(files: DataFrame) -> DataFrame:
    """files (file_name, kind, mime, length, content) -> file_name, kind, safe_name, container, reason (NULL = accepted).

    Reads only the head of each content; `length` is the full size, as binaryFile reports it."""
    rules = ", ".join(
        f"'{k}', struct({size}L as max_bytes, '{ext}' as ext, array({', '.join(repr(m) for m in mimes)}) as mimes, array({', '.join(repr(c) for c in kinds)}) as containers)"
        for k, (size, ext, mimes, kinds) in UPLOADS.items()
    )
    staged = files.selectExpr(
        "file_name", "kind", "length", f"{sanitize_file_name('file_name')} as safe_name", f"{detect_container('content')} as container",
        "lower(trim(split(coalesce(mime, ''), ';')[0])) as mime", f"try_element_at(map({rules}), kind) as policy",
    )
    return staged.selectExpr(
        "file_name", "kind", "safe_name", "container",
        """case when policy is null then 'Unknown upload kind.'
            when not endswith(lower(safe_name), policy.ext) then concat('Only ', policy.ext, ' files are accepted.')
            when mime <> '' and not array_contains(policy.mimes, mime) then 'The declared content type is not allowed for this upload.'
            when length = 0 then 'The uploaded file is empty.'
            when length > policy.max_bytes then concat('The file exceeds the ', floor(policy.max_bytes / 1048576), ' MB limit.')
            when not array_contains(policy.containers, container) then 'File content does not match its declared format.' end as reason""",
    )


def landing_zone(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files of a landing folder in the shape `screen_files` takes; of each file its size and its first 4,096 bytes are read."""
    return read_heads(spark, path).selectExpr("element_at(split(path, '/'), -1) as file_name", f"'{kind}' as kind", "cast(null as string) as mime", "length", "head as content")
