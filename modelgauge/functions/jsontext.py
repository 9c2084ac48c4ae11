"""JSON and CSV text as column expressions, with the number and null rules of the exchanged files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgauge.functions.columns import fmt_num_sql


def json_string(x: str) -> str:
    """SQL text: JSON string literal of a string expression."""
    return f"substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2)"


def canonical_json(dtype: T.DataType, x: str, depth: int = 0) -> str:
    """SQL text that renders `x` as JSON with object keys sorted; NULL struct fields are dropped."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        parts = ", ".join(
            f"if({x}.`{f.name}` is null, null, concat('\"{f.name}\":', {canonical_json(f.dataType, f'{x}.`{f.name}`', depth)}))"
            for f in fields
        )
        return f"concat('{{', concat_ws(',', {parts}), '}}')"
    if isinstance(dtype, T.ArrayType):
        v = f"e{depth}"
        item = canonical_json(dtype.elementType, v, depth + 1)
        return f"concat('[', array_join(transform({x}, {v} -> coalesce({item}, 'null')), ','), ']')"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return fmt_num_sql(f"cast({x} as double)")
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.DecimalType)):
        return f"cast({x} as string)"
    return json_string(f"cast({x} as string)")


def with_fingerprint(df: DataFrame, columns: list[str], out: str = "fingerprint") -> DataFrame:
    """sha256 of the canonical JSON of `columns`."""
    schema = T.StructType([df.schema[c] for c in columns])
    packed = df.withColumn("_doc", F.struct(*columns))
    text = F.expr(canonical_json(schema, "_doc"))
    return packed.withColumn("canonical_json", text).withColumn(out, F.sha2("canonical_json", 256)).drop("_doc")


EVIDENCE_JSON = (
    "concat('[', array_join(transform(evidence, e -> concat('{\"message\":', " + json_string("e.message")
    + ", ',\"field\":', " + json_string("e.field")
    + ", ',\"observed\":', case when e.observed is null then 'null'"
    + " when e.field in ('room.areaSqm', 'room.roomType') or (e.field = 'room.connectedDoorIds' and e.expected = '>= 1') then e.observed"
    + " else " + json_string("e.observed") + " end, ',\"expected\":', "
    + "coalesce(" + json_string("e.expected") + ", 'null'), '}')), ','), ']')"
)


def csv_field(c: Column) -> Column:
    """RFC-4180 field: quoted only when it holds a comma, quote or line break."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*columns: str) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(c)) for c in columns])
