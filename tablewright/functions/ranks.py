"""Exact order statistics without sorting a table or gathering it in one task.

A sketch brackets the wanted ranks, the rows inside the bracket are counted by value, and the
counts decide. The sketch only steers the search: the ranks are checked against exact counts, and a
bracket that misses is widened. What reaches the last step is bounded by ``MAX_BRACKET``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import ident

ACCURACY = 10_000
MAX_BRACKET = 2_000_000


@dataclass
class _Bracket:
    """Closed value range that holds the middle ranks of one column; None is an open end."""

    low: float | None = None
    high: float | None = None
    total: int = 0
    below: int = 0
    inside: int = 0

    @property
    def middle(self) -> tuple[int, int]:
        return (self.total - 1) // 2, self.total // 2

    def holds(self) -> bool:
        return self.below <= self.middle[0] and self.middle[1] < self.below + self.inside

    def rows_of(self, c: Column) -> Column:
        keep = c.isNotNull()
        if self.low is not None:
            keep = keep & (c >= F.lit(self.low))
        if self.high is not None:
            keep = keep & (c <= F.lit(self.high))
        return F.when(keep, c)


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    accuracy: int = ACCURACY,
    max_bracket: int = MAX_BRACKET,
) -> dict[str, float | None]:
    """Interpolated median of each numeric column, nulls ignored; None for an all-null column."""
    if not columns:
        return {}
    values = [ident(c).cast("double") for c in columns]
    df = df.select(*[F.when(~F.isnan(v), v).alias(f"c{i}") for i, v in enumerate(values)])
    now = [_Bracket() for _ in columns]
    margin = 2.0 / accuracy
    while True:
        proposed = _sketch(df, now, margin, accuracy)
        width = max(b.inside for b in now) * (2 * margin + 2.0 / accuracy)
        stuck = all((p.low, p.high) == (b.low, b.high) for p, b in zip(proposed, now))
        if width <= max_bracket or stuck:
            found = _values_at_middle(df, proposed)
            if all(f is not None or b.total == 0 for f, b in zip(found, proposed)):
                return dict(zip(columns, found))
            margin = min(10 * margin, 1.0)  # the sketch missed a rank: look wider
            continue
        _count(df, proposed)
        if not all(b.holds() for b in proposed if b.total):
            margin = min(10 * margin, 1.0)
        now = [p if p.holds() else b for p, b in zip(proposed, now)]


def _sketch(df: DataFrame, now: list[_Bracket], margin: float, accuracy: int) -> list[_Bracket]:
    aggs = []
    for i, b in enumerate(now):
        c = b.rows_of(F.col(f"c{i}"))
        span = max(b.inside, 1)
        start, end = (0.5, 0.5) if b.total == 0 else ((b.middle[0] - b.below) / span, (b.middle[1] + 1 - b.below) / span)
        p = [min(max(start - margin, 0.0), 1.0), min(max(end + margin, 0.0), 1.0)]
        aggs += [F.count(c).alias(f"n{i}"), F.percentile_approx(c, p, accuracy).alias(f"p{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, b in enumerate(now):
        if b.low is None and b.high is None:
            b.total = b.inside = row[f"n{i}"]
        low, high = row[f"p{i}"] or (None, None)
        out.append(_Bracket(low, high, b.total))
    return out


def _count(df: DataFrame, brackets: list[_Bracket]) -> None:
    aggs = []
    for i, b in enumerate(brackets):
        c = F.col(f"c{i}")
        aggs.append((F.count_if(c < F.lit(b.low)) if b.low is not None else F.lit(0)).alias(f"b{i}"))
        aggs.append(F.count(b.rows_of(c)).alias(f"m{i}"))
    row = df.agg(F.count(F.lit(1)), *aggs).first()
    for i, b in enumerate(brackets):
        b.below, b.inside = row[f"b{i}"], row[f"m{i}"]


def _values_at_middle(df: DataFrame, brackets: list[_Bracket]) -> list[float | None]:
    """Counts by value inside each bracket (rows below it collapse to one null value), then the middle."""
    cells = []
    for i, b in enumerate(brackets):
        c = F.col(f"c{i}")
        is_below = c < F.lit(b.low) if b.low is not None else F.lit(False)
        is_above = c > F.lit(b.high) if b.high is not None else F.lit(False)
        cells.append(
            F.when(
                c.isNotNull() & ~is_above, F.struct(F.lit(i).alias("pos"), F.when(~is_below, c).alias("v"))
            )
        )
    counts = (
        df.select(F.explode(F.array_compact(F.array(*cells))).alias("x"))
        .groupBy("x.pos", "x.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("pos").orderBy(F.col("v").asc_nulls_first()))
    ranks = df.sparkSession.createDataFrame(
        [(i, *b.middle) for i, b in enumerate(brackets) if b.total] or [(-1, 0, 0)],
        "pos int, first bigint, second bigint",
    )
    rows = (
        counts.withColumn("upto", upto)
        .join(F.broadcast(ranks), "pos")  # one row per column
        .where(F.col("v").isNotNull())
        .where((F.col("upto") > F.col("first")) & (F.col("upto") - F.col("n") <= F.col("second")))
        .select(
            "pos",
            "v",
            ((F.col("upto") - F.col("n") <= F.col("first"))).alias("is_first"),
            (F.col("upto") > F.col("second")).alias("is_second"),
        )
        .where("is_first or is_second")
        .collect()  # at most two rows per column
    )
    first: dict[int, float] = {}
    second: dict[int, float] = {}
    for r in rows:
        if r["is_first"]:
            first[r["pos"]] = r["v"]
        if r["is_second"]:
            second[r["pos"]] = r["v"]
    return [(first[i] + second[i]) / 2 if i in first and i in second else None for i in range(len(brackets))]
