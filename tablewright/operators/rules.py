"""Task, target and cleaning plan from the profile by fixed rules.

The profile has one row per column, so the rules run on the driver over as many rows as columns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.clean import CleaningRecipe

CLUSTERING, CLASSIFICATION, REGRESSION = "Clustering / Segmentation", "Classification", "Regression"

# Goal words that ask for segments, and column-name hints for a target.
SEGMENT_WORDS = ("cluster", "segment")
DISCRETE_HINTS = ("species", "churn", "status", "class", "label", "category", "outcome", "target", "segment", "flag")
CONTINUOUS_HINTS = ("price", "salary", "sales", "revenue", "amount", "cost", "income", "balance", "total")
POSITIVE_HINTS = ("price", "salary", "quantity", "amount", "age", "size", "count")
# Name parts of quantities that can well be negative, whatever else the name says.
SIGNED_PARTS = ("balance", "bal", "change", "delta", "diff", "difference", "net", "gain", "loss", "margin", "growth")

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")
# Thresholds for a continuous numeric target.
MIN_DISTINCT, MIN_DISTINCT_SHARE = 20, 0.05


@dataclass(frozen=True)
class ColumnProfile:
    column: str
    dtype: str
    num_rows: int
    null_count: int
    unique_values: int

    @property
    def numeric(self) -> bool:
        return self.dtype in NUMERIC_TYPES or self.dtype.startswith("decimal")

    @property
    def identifier(self) -> bool:
        """Every row its own value, or a single value: nothing to learn from."""
        every = self.num_rows > 1 and self.unique_values == self.num_rows
        return (every and self.dtype not in ("float", "double")) or self.unique_values <= 1


@dataclass(frozen=True)
class Intent:
    task: str
    target: str | None
    reasoning: str


def name_parts(name: str) -> list[str]:
    """The lower-case words of a name, split at marks, digits and changes of case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]


def _hinted(name: str, hints: Sequence[str]) -> bool:
    """A part of the name is a hint, or a compound that ends in a long one (``orderstatus``)."""
    return any(p in (h, h + "s") or (len(h) >= 5 and p.endswith(h)) for p in name_parts(name) for h in hints)


def never_negative(name: str) -> bool:
    """Whole words only, since acting on a wrong guess would wipe valid values."""
    parts = name_parts(name)
    return any(p in (h, h + "s") for p in parts for h in POSITIVE_HINTS) and not any(p in SIGNED_PARTS for p in parts)


def column_profiles(profile: DataFrame) -> list[ColumnProfile]:
    rows = profile.orderBy("position").select("column", "dtype", "num_rows", "null_count", "unique_values").collect()
    return [ColumnProfile(*r) for r in rows]


def _task_of(c: ColumnProfile) -> str:
    share = c.unique_values / max(c.num_rows, 1)
    return REGRESSION if c.numeric and c.unique_values > MIN_DISTINCT and share > MIN_DISTINCT_SHARE else CLASSIFICATION


def infer_intent(columns: Sequence[ColumnProfile], goal: str = "") -> Intent:
    """Segment words in the goal win; then a column named in the goal; then the name hints.

    The goal is read word by word, and an identifier is never a target.
    """
    names = {c.column.lower() for c in columns}
    words = re.findall(r"[^\s,;:!?()'\"]+", goal.lower())
    words = [w if w in names else w.strip(".`") for w in words]
    if any(w.startswith(SEGMENT_WORDS) and "_" not in w for w in words if w not in names):
        return Intent(CLUSTERING, None, "the goal asks for segments")
    usable = [c for c in columns if not c.identifier]
    spoken = " ".join(words)
    named = [c for c in usable if re.search(rf"(?<!\S){re.escape(c.column.lower())}(?!\S)", spoken)]
    if named:
        best = max(named, key=lambda c: len(c.column))
        return Intent(_task_of(best), best.column, f"the goal names {best.column}")
    for hints, wanted in ((DISCRETE_HINTS, CLASSIFICATION), (CONTINUOUS_HINTS, REGRESSION)):
        for c in usable:
            if _hinted(c.column, hints) and _task_of(c) == wanted:
                return Intent(wanted, c.column, f"the name of {c.column} marks a target")
    return Intent(CLUSTERING, None, "no obvious target")


def resolve_task(task: str | None) -> str:
    """No task means clustering; a name that is none of the three is an error."""
    if task is None:
        return CLUSTERING
    if task not in (CLUSTERING, CLASSIFICATION, REGRESSION):
        raise ValueError(f"unknown task {task!r}")
    return task


def derive_recipe(
    columns: Sequence[ColumnProfile], target: str | None = None, positive: Sequence[str] | None = None
) -> CleaningRecipe:
    """Identifiers and constants go, gaps are filled by type, rows without a target go.

    ``positive`` names the columns that cannot be negative; by default their names decide.
    """
    drop = [c.column for c in columns if c.identifier and c.column != target]
    kept = [c for c in columns if c.column not in drop]
    if positive is None:
        positive = [c.column for c in kept if c.numeric and never_negative(c.column)]
    gaps = [c for c in kept if c.column != target and (c.null_count > 0 or c.column in positive)]
    return CleaningRecipe(
        replace_negatives_with_null=tuple(c.column for c in kept if c.column in positive and c.numeric),
        impute_median=tuple(c.column for c in gaps if c.numeric),
        impute_mode=tuple(c.column for c in gaps if not c.numeric),
        drop_rows_with_nulls_in=(target,) if target else (),
        drop_columns=tuple(drop),
        reasoning=f"{len(drop)} identifier or constant columns, {len(gaps)} columns with gaps",
    )


def intent_table(spark: SparkSession, intent: Intent) -> DataFrame:
    return spark.createDataFrame(
        [(intent.task, intent.target, intent.reasoning)], "task string, target string, reasoning string"
    )


def recipe_table(spark: SparkSession, recipe: CleaningRecipe) -> DataFrame:
    """(action, ordinal, column): one row per planned step."""
    rows = [
        (action, i, c)
        for action in (
            "replace_negatives_with_null",
            "impute_median",
            "impute_mode",
            "drop_rows_with_nulls_in",
            "drop_columns",
        )
        for i, c in enumerate(getattr(recipe, action))
    ]
    return spark.createDataFrame(rows, "action string, ordinal int, column string")
