"""JSON text columns: schema from the data, bad lines to a quarantine table, nested objects flattened."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import ident, require_columns


def infer_json_schema(df: DataFrame, column: str) -> str:
    """DDL of the union of all objects in the column, from one aggregate with map-side merging."""
    parsed = F.try_parse_json(ident(column))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    found = df.agg(F.schema_of_variant_agg(F.when(is_object, parsed)).alias("s")).first()["s"]
    if found is None or not found.startswith("OBJECT<"):
        raise ValueError(f"no JSON object in column {column!r}")
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", found)
    ddl = re.sub(r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE", ddl)
    return re.sub(r"(: ?|ARRAY<)(VOID|VARIANT)\b", r"\1STRING", ddl)


def parse_json_lines(
    df: DataFrame, column: str, schema: str | T.StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows with one column per top-level key, quarantine). Blank lines are skipped.

    The other columns of ``df`` stay. A given schema saves the inference pass.
    """
    require_columns(df, column)
    others = [ident(c) for c in df.columns if c != column]
    lines = df.where(F.length(F.trim(ident(column))) > 0)
    if schema is None:
        schema = infer_json_schema(lines, column)
    good = F.coalesce(F.schema_of_variant(F.try_parse_json(ident(column))).startswith("OBJECT"), F.lit(False))
    rows = lines.where(good).select(*others, F.from_json(ident(column), schema).alias("__j")).select(*others, "__j.*")
    bad = lines.where(~good).select(*others, ident(column).alias("line"), F.lit("not a JSON object").alias("reason"))
    return rows, bad


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects become columns named ``a.b.c``; lists stay one cell."""
    out = []

    def walk(path: list[str], dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk([*path, f.name], f.dataType)
        else:
            c = F.col(".".join("`" + p.replace("`", "``") + "`" for p in path))
            out.append(c.alias(".".join(path)))

    for f in df.schema.fields:
        walk([f.name], f.dataType)
    return df.select(*out)
