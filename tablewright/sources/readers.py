"""Readers by format, the hand-off to later steps, and the writers."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import NULL_TOKENS, columns_where, ident, is_text, round_half_up
from tablewright.sources import splitcsv
from tablewright.sources.jsonlines import flatten, parse_json_lines

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
_WHOLE = r"^\s*[+-]?\d+\s*$"
_BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """The usual missing-value tokens of text columns become null."""
    texts = set(columns_where(df, is_text))
    return df.select(
        *[
            F.when(~ident(c).isin(*NULL_TOKENS), ident(c)).alias(c) if c in texts else ident(c)
            for c in df.columns
        ]
    )


def _as_double(c: Column) -> Column:
    # The pattern keeps Java's type suffixes out and spares the cast its costly failures.
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def infer_column_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value reads as whole number, number or boolean take that type.

    One aggregate decides for all columns, after missing-value tokens are gone; dates stay text.
    """
    texts = columns_where(df, is_text)
    if not texts:
        return df
    row = df.agg(
        *[F.count(ident(c)).alias(f"n{i}") for i, c in enumerate(texts)],
        *[F.count(F.when(ident(c).rlike(_WHOLE), ident(c).try_cast("bigint"))).alias(f"l{i}") for i, c in enumerate(texts)],
        *[F.count(_as_double(ident(c))).alias(f"d{i}") for i, c in enumerate(texts)],
        *[F.count_if(ident(c).isin(*_BOOLEANS)).alias(f"b{i}") for i, c in enumerate(texts)],
    ).first()
    out = []
    for c in df.columns:
        if c not in texts:
            out.append(ident(c))
            continue
        i = texts.index(c)
        n = row[f"n{i}"]
        if n > 0 and row[f"l{i}"] == n:
            out.append(ident(c).try_cast("bigint").alias(c))
        elif n > 0 and row[f"d{i}"] == n:
            out.append(_as_double(ident(c)).alias(c))
        elif n > 0 and row[f"b{i}"] == n:
            out.append(ident(c).try_cast("boolean").alias(c))
        else:
            out.append(ident(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """CSV with a header. Without a schema the types follow from the values, at the cost of one more pass.

    Quoted values may hold line breaks, and files are read in ranges all the same (``splitcsv``). With other options than
    ``sep`` Spark's reader is used, by one task per file unless ``multiLine=False`` says that no value holds a line break.
    """
    if set(options) <= {"sep"}:
        rows = null_tokens_to_null(splitcsv.read(spark, path, schema, **options))
        return rows if schema is not None else infer_column_types(rows)
    reader = spark.read.option("header", True).option("multiLine", options.pop("multiLine", True)).option("escape", '"').options(**options)
    if schema is not None:
        return null_tokens_to_null(reader.schema(schema).csv(path))
    return infer_column_types(null_tokens_to_null(reader.csv(path)))


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One JSON document (object or list of objects) per file, nested objects flattened."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return flatten((reader.schema(schema) if schema is not None else reader).json(path))


def read_json_lines(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a file with one JSON object per line."""
    return parse_json_lines(spark.read.text(path), "value", schema)


def read_text(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(path, text) per file, or per line; undecodable bytes are dropped."""
    df = spark.read.text(path, wholetext=whole)
    value = F.col("value")
    decoded = F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.make_valid_utf8(value), F.lit("\ufffd"), F.lit("")))
    return df.select(F.col("_metadata.file_path").alias("path"), decoded.alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as rows of features."""
    return image_features(spark.read.format("image").option("dropInvalid", True).load(path))


def image_features(images: DataFrame) -> DataFrame:
    """Size, aspect ratio, channel means and the deviation over all channel values; alpha is left out."""

    @F.pandas_udf("red double, green double, blue double, std double")
    def channels(data: pd.Series, count: pd.Series) -> pd.DataFrame:
        out = []
        for raw, n in zip(data, count):
            px = np.frombuffer(raw, dtype="uint8").reshape(-1, n)
            bgr = px[:, :3] if n >= 3 else np.repeat(px[:, :1], 3, axis=1)
            out.append((bgr[:, 2].mean(), bgr[:, 1].mean(), bgr[:, 0].mean(), bgr.std()))
        return pd.DataFrame(out, columns=["red", "green", "blue", "std"])

    i = F.col("image")
    c = channels(i["data"], i["nChannels"])
    return images.select(
        i["origin"].alias("path"),
        i["width"].alias("image_width"),
        i["height"].alias("image_height"),
        round_half_up(i["width"] / F.greatest(i["height"], F.lit(1)), 3).alias("aspect_ratio"),
        c.alias("c"),
    ).select(
        "path", "image_width", "image_height", "aspect_ratio",
        F.col("c.red").alias("mean_red_channel"),
        F.col("c.green").alias("mean_green_channel"),
        F.col("c.blue").alias("mean_blue_channel"),
        F.col("c.std").alias("brightness_std"),
    )


def json_layout(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """("lines" or "document", lines that are no object, lines that are one) of JSON files.

    A file whose first filled line is an object by itself has one object per line: if it were one document, nothing could follow.
    """
    value = F.col("value")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))
    lines = spark.read.text(path).where(F.length(F.trim(value)) > 0).select(
        is_object.alias("ok"), F.col("_metadata.file_path").alias("f"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"),
    )
    files = lines.groupBy("f").agg(F.min_by("ok", "at").alias("first"), F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("n"))
    row = files.agg(F.count(F.lit(1)).alias("files"), F.count_if("first").alias("firsts"), F.sum("ok").alias("ok"), F.sum("n").alias("n")).first()
    if not row["files"]:
        raise ValueError(f"nothing to read in {path}")
    if 0 < row["firsts"] < row["files"]:
        raise ValueError(f"{path} mixes documents and files with one object per line")
    return "lines" if row["firsts"] else "document", row["n"] - row["ok"], row["ok"]


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows, quarantine) of JSON files of either layout, nested objects flattened; a document has no quarantine.

    A file that starts with no object and is no document either, such as a log with a plain first line, is read by lines.
    """
    layout, bad, good = json_layout(spark, path)
    if layout == "document":
        try:
            whole = F.try_parse_json(F.col("value"))
            broken = spark.read.text(path, wholetext=True).where(whole.isNull()).limit(1).count()
            if not broken:
                return read_json_document(spark, path), None
        except Exception:
            if not good:
                raise
        if not good:
            raise ValueError(f"{path} holds no JSON")
    rows, rejects = read_json_lines(spark, path)
    return flatten(rows), rejects


def _json(spark: SparkSession, path: str) -> DataFrame:
    rows, rejects = read_json(spark, path)
    bad = 0 if rejects is None else rejects.count()
    if bad:
        warnings.warn(f"{bad} lines of {path} are no JSON objects; read_json returns them as its second table", stacklevel=3)
    return rows


READERS = {
    "csv": read_csv,
    "json": _json,
    "log": _json,
    "txt": read_text,
    "text": read_text,
    "png": read_images,
    "jpg": read_images,
    "jpeg": read_images,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def extension(path: str) -> str:
    return path.strip().rstrip("/").split(".")[-1].lower()


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reader by the lower-cased extension; an unknown one is an error."""
    ext = extension(path)
    if ext not in READERS:
        raise ValueError(f"no reader for {ext!r}; known are {', '.join(READERS)}")
    return READERS[ext](spark, path)


def publish(df: DataFrame, view: str, persist: bool = False) -> DataFrame:
    """Hands a table to later steps and to SQL under a name."""
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.createOrReplaceTempView(view)
    return df


def active_table(structured: DataFrame | None, extracted: DataFrame | None) -> DataFrame:
    """The structured table wins over one extracted from unstructured input."""
    if structured is None and extracted is None:
        raise ValueError("no table given")
    return structured if structured is not None else extracted


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with header and without a row index; blanks around values stay."""
    writer = df.write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
