"""CSV files read by many tasks although quoted values hold line breaks.

Spark's text reader cuts a file into byte ranges at line ends; whether a range begins inside a quoted value depends on all
ranges before it. So the first pass finds, for each range, the state it ends in for either state it may begin in; composing these along each
file, one row per range, gives every range's true beginning. The second pass joins lines to records in place. Only the pieces of
records that lie across a range's border move: the head of a range goes to the range in which its record begins.

A quote opens a value at the value's beginning only; inside, two quotes are one. Lines end with a line feed, or a carriage return
and a line feed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import local_table, materialised

QUOTE = '"'
PIECES = "file string, start long, kind string, record string"
WHOLE, HEAD, TAIL, THROUGH = "whole", "head", "tail", "through"


def ends_open(line: str, opened: bool, sep: str) -> bool:
    """Whether a quoted value is open at the line's end, given whether one was at its beginning."""
    if QUOTE not in line:
        return opened
    at = 0
    while True:
        if not opened and line.startswith(QUOTE, at):
            opened, at = True, at + 1
        if opened:
            closing = line.find(QUOTE, at)
            while closing >= 0 and line.startswith(QUOTE, closing + 1):
                closing = line.find(QUOTE, closing + 2)
            if closing < 0:
                return True
            opened, at = False, closing + 1
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value, file, start): every line with its file and the first byte of its range; the lines of a range are in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int] | None, list[str]]]:
    """((file, start), lines) part by part; (None, []) at the end."""
    for batch in batches:
        lines, files, starts = (batch.column(i).to_pylist() for i in range(3))
        a = 0
        while a < len(lines):
            b = a + 1
            while b < len(lines) and starts[b] == starts[a] and files[b] == files[a]:
                b += 1
            yield (files[a], starts[a]), lines[a:b]
            a = b
    yield None, []


def _states(lines: DataFrame, sep: str) -> dict[tuple[str, int], bool]:
    """Whether each range begins inside a quoted value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends = None, [False, True]
        for place, part in _ranges(batches):
            if place != at:
                if at is not None:
                    yield pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "closed": ends[0], "opened": ends[1]}])
                at, ends = place, [False, True]
            for line in part:
                if QUOTE in line:
                    ends = [ends_open(line, ends[0], sep)] * 2 if ends[0] == ends[1] else [ends_open(line, e, sep) for e in ends]

    found = lines.mapInArrow(run, "file string, start long, closed boolean, opened boolean").collect()  # one row per range
    out, file, state = {}, None, False
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, state = r["file"], False
        out[r["file"], r["start"]] = state
        state = r["opened"] if state else r["closed"]
    return out


def records(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """(file, first, record): the records of CSV files as text, read by as many tasks as the files have ranges; ``first`` marks the
    first record of each file. Empty records are left out."""
    lines = _lines(spark, path)
    states = spark.sparkContext.broadcast(_states(lines, sep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, opened, kept, begun_inside, out = None, False, [], False, []

        def row(kind: str) -> dict:
            text = "\n".join(kept)
            return {"file": at[0], "start": at[1], "kind": kind, "record": text.removesuffix("\r") if kind in (WHOLE, HEAD) else text}

        for place, part in _ranges(batches):
            if place != at:
                if at is not None and kept:
                    out.append(row(THROUGH if begun_inside else TAIL))
                at, kept = place, []
                opened = begun_inside = place is not None and states.value[place]
            for line in part:
                kept.append(line)
                opened = ends_open(line, opened, sep)
                if not opened:
                    out.append(row(HEAD if begun_inside else WHOLE))
                    kept, begun_inside = [], False
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("record", pa.string())]))
                out = []

    found = materialised(lines.mapInArrow(run, PIECES).withColumn("place", F.monotonically_increasing_id()))
    broken = found.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "place")  # at most two pieces per range
    begins = broken.withColumn("n", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
    joined = begins.groupBy("file", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "record"))), lambda x: x["record"]), "\n").alias("record"),
        F.min(F.struct("start", "place")).alias("at"),
    )
    whole = found.filter(F.col("kind") == WHOLE).select("file", "record", F.struct("start", "place").alias("at"))
    every = whole.unionByName(joined.select("file", "record", "at"))
    heads = found.groupBy("file").agg(F.min(F.struct("start", "place")).alias("at")).collect()  # one row per file
    marks = local_table(spark, [(r["file"], r["at"]["start"], r["at"]["place"]) for r in heads], "f string, s long, p long")
    marked = every.join(marks, F.col("file") == F.col("f"), "left")
    return marked.select("file", ((F.col("at.start") == F.col("s")) & (F.col("at.place") == F.col("p"))).alias("first"), "record").filter("record <> ''")


def parse(rows: DataFrame, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """The values of CSV records by a schema, as Spark's own reader parses them."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    by_place = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(fields)])
    values = rows.select(F.from_csv("record", by_place.toDDL(), {"sep": sep, "escape": QUOTE, "mode": "PERMISSIVE"}).alias("r"))
    return values.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(fields)])


def read(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None, sep: str = ",") -> DataFrame:
    """CSV files with a header each; all columns are text if no schema is given."""
    if schema is None:
        head = spark.read.option("header", True).option("multiLine", True).option("escape", QUOTE).option("sep", sep).csv(path)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in head.columns])
    return parse(records(spark, path, sep).filter(~F.col("first")), schema, sep)
