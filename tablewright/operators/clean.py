"""Cleaning by a recipe: negatives to null, median, mode, row drop, column drop, with a log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import ident, is_calendar, is_numeric_or_bool, normalise
from tablewright.functions.counts import modes
from tablewright.functions.ranks import exact_medians

LOG_SCHEMA = "step int, action string, column string, n_affected bigint, fill_value string, message string"


@dataclass(frozen=True)
class CleaningRecipe:
    """Column lists per action; names that are not in the table are skipped."""

    replace_negatives_with_null: tuple[str, ...] = ()
    impute_median: tuple[str, ...] = ()
    impute_mode: tuple[str, ...] = ()
    drop_rows_with_nulls_in: tuple[str, ...] = ()
    drop_columns: tuple[str, ...] = ()
    reasoning: str = ""


@dataclass(frozen=True)
class FittedCleaning:
    """A recipe with its fill values, ready to be applied as a projection and a filter."""

    recipe: CleaningRecipe
    medians: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, object] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        filled = _filled(normalise(df), self.recipe, self.medians, self.modes)
        required = [c for c in self.recipe.drop_rows_with_nulls_in if c in df.columns]
        if required:
            filled = filled.where(_all_present(required))
        gone = [c for c in self.recipe.drop_columns if c in df.columns]
        return filled.select(*[ident(c) for c in filled.columns if c not in gone])


def _all_present(columns: list[str]) -> Column:
    keep = ident(columns[0]).isNotNull()
    for c in columns[1:]:
        keep = keep & ident(c).isNotNull()
    return keep


def _numeric(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in dict.fromkeys(names) if c in df.columns and is_numeric_or_bool(df.schema[c].dataType)]


def _without_negatives(df: DataFrame, recipe: CleaningRecipe) -> DataFrame:
    hit = set(_numeric(df, recipe.replace_negatives_with_null))
    return df.select(
        *[F.when(~(ident(c).cast("double") < 0), ident(c)).alias(c) if c in hit else ident(c) for c in df.columns]
    )


def _filled(df: DataFrame, recipe: CleaningRecipe, medians: dict, mode_values: dict) -> DataFrame:
    df = _without_negatives(df, recipe)
    out = []
    for f in df.schema.fields:
        c = ident(f.name)
        if medians.get(f.name) is not None:
            c = F.coalesce(c.cast("double"), F.lit(float(medians[f.name])))
        if f.name in mode_values:
            v = mode_values[f.name]
            c = F.coalesce(c, F.lit(str(v) if is_calendar(f.dataType) else v).cast(_filled_type(f, medians)))
        out.append(c.alias(f.name))
    return df.select(*out)


def _filled_type(f: T.StructField, medians: dict) -> T.DataType:
    return T.DoubleType() if medians.get(f.name) is not None else f.dataType


def fit_cleaning(df: DataFrame, recipe: CleaningRecipe) -> FittedCleaning:
    """Fill values in recipe order: medians after the negatives are gone, modes after the medians."""
    df = normalise(df)
    step1 = _without_negatives(df, recipe)
    medians = exact_medians(step1, _numeric(df, recipe.impute_median))
    step2 = _filled(df, recipe, medians, {})
    wanted = [c for c in dict.fromkeys(recipe.impute_mode) if c in df.columns]
    return FittedCleaning(recipe, medians, modes(step2, wanted))


def cleaning_log(df: DataFrame, fitted: FittedCleaning) -> DataFrame:
    """One row per step, all counts from one aggregate."""
    recipe = fitted.recipe
    df = normalise(df)
    negatives = _numeric(df, recipe.replace_negatives_with_null)
    required = [c for c in dict.fromkeys(recipe.drop_rows_with_nulls_in) if c in df.columns]
    gone = [c for c in dict.fromkeys(recipe.drop_columns) if c in df.columns]

    def negative(c: str) -> Column:
        return ident(c).cast("double") < 0 if c in negatives else F.lit(False)

    def null_before_median(c: str) -> Column:
        return ident(c).isNull() | F.coalesce(negative(c), F.lit(False))

    def null_before_mode(c: str) -> Column:
        return F.lit(False) if fitted.medians.get(c) is not None else null_before_median(c)

    def null_at_end(c: str) -> Column:
        return F.lit(False) if c in fitted.modes else null_before_mode(c)

    steps: list[tuple[str, str, str | None, Column]] = []
    for c in negatives:
        steps.append(("negative_to_null", c, None, F.count_if(negative(c))))
    for c, v in fitted.medians.items():
        steps.append(("impute_median", c, None if v is None else str(v), F.count_if(null_before_median(c))))
    for c, v in fitted.modes.items():
        steps.append(("impute_mode", c, str(v), F.count_if(null_before_mode(c))))
    earlier = F.lit(False)
    for c in required:
        steps.append(("drop_rows", c, None, F.count_if(null_at_end(c) & ~earlier)))
        earlier = earlier | null_at_end(c)
    for c in gone:
        steps.append(("drop_column", c, None, F.lit(0)))
    if not steps:
        return df.sparkSession.createDataFrame([], LOG_SCHEMA)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[s[3].cast("bigint").alias(f"k{i}") for i, s in enumerate(steps)])
    messages = {
        "negative_to_null": "negative values set to missing",
        "impute_median": "missing values filled with the median",
        "impute_mode": "missing values filled with the mode",
        "drop_rows": "rows dropped because the column is missing",
        "drop_column": "column dropped",
    }
    cells = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(action).alias("action"),
            F.lit(column).alias("column"),
            F.col(f"k{i}").alias("n_affected"),
            F.lit(fill).cast("string").alias("fill_value"),
            F.concat(F.lit(f"{column}: "), F.col(f"k{i}").cast("string"), F.lit(" " + messages[action])).alias("message"),
        )
        for i, (action, column, fill, _) in enumerate(steps)
    ]
    # A clean column leaves no entry for the negatives; every other step is logged even at zero.
    return (
        counts.select(F.inline(F.array(*cells)))
        .where((F.col("action") != "negative_to_null") | (F.col("n_affected") > 0))
    )


def clean(df: DataFrame, recipe: CleaningRecipe) -> tuple[DataFrame, DataFrame]:
    """Fits the recipe, then returns the cleaned table and the log; both are lazy."""
    fitted = fit_cleaning(df, recipe)
    return fitted.transform(df), cleaning_log(df, fitted)
