"""Report-ready tables from the results of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import ident

SECTION_SCHEMA = "report string, section string, ordinal int, text string"
# Rows kept per table, leaderboard rows and columns, log lines and risks shown.
PRUNED_ROWS, TOP_ROWS, TOP_COLUMNS, LOG_LINES, CONTEXT_LINES, RISKS = 5, 4, 5, 5, 3, 4
# Bulky results that never go into a report payload.
EXCLUDED = ("factor_scores", "labelled", "holdout", "cleaned", "predictions", "probabilities")


def prune_to_json(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], rows: int = PRUNED_ROWS) -> DataFrame:
    """(name, ordinal, json): the first rows of each result table in its order columns."""
    out = None
    for name, (df, order) in tables.items():
        if name in EXCLUDED:
            continue
        keys = [ident(c) for c in (order or df.columns)]
        body = F.to_json(F.struct(*[ident(c) for c in df.columns]), {"ignoreNullFields": "false"})
        part = df.orderBy(*keys).limit(rows).select(F.struct(*keys, body.alias("__j")).alias("r"))
        part = part.agg(F.array_sort(F.collect_list("r")).alias("r")).select(  # at most `rows` entries
            F.lit(name).alias("name"), F.posexplode(F.transform("r", lambda x: x["__j"])).alias("ordinal", "json")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no table left to report")
    return out


def leaderboard_top(leaderboard: DataFrame, rows: int = TOP_ROWS, columns: int = TOP_COLUMNS) -> DataFrame:
    return leaderboard.orderBy("rank").limit(rows).select(*[ident(c) for c in leaderboard.columns[:columns]])


def importances_ascending(importances: DataFrame) -> DataFrame:
    return importances.orderBy(F.asc("importance"), F.asc("feature"))


def report_sections(
    spark: SparkSession,
    task: str,
    champion: str,
    score: float | None,
    score_name: str,
    log: Sequence[str],
    split_counts: Mapping[str, int],
    missing_cells: int,
    gates: Sequence[str],
    drivers: Sequence[str] = (),
) -> DataFrame:
    """Business and technical report as (report, section, ordinal, text), by templates over the results."""
    total = max(sum(split_counts.values()), 1)
    shown = "not available" if score is None else f"{score:.4f}"
    ready = "High Quality" if missing_cells == 0 else "Action Required"
    sections: dict[tuple[str, str], list[str]] = {
        ("business", "executive_verdict"): [f"{task}: {champion} was selected with {score_name} {shown}."],
        ("business", "segment_insights"): [f"{d} is among the strongest drivers." for d in drivers] or ["No single driver stands out."],
        ("business", "data_readiness_score"): [ready],
        ("business", "data_readiness_detail"): [f"{missing_cells} cells are missing after {len(log)} cleaning steps."],
        ("business", "strategic_recommendations"): [
            f"Use {champion} as the reference model.",
            "Confirm the result on data collected after this run.",
        ],
        ("business", "potential_business_risks"): [
            "The distribution of the inputs may change.",
            "Cohorts should be audited for parity before use.",
        ][:RISKS],
        ("technical", "architecture_summary"): [f"{champion} led the ranking on the validation part."],
        ("technical", "data_engineering_audit"): list(log[:LOG_LINES]),
        ("technical", "statistical_quality_gates"): [
            "Parts: "
            + ", ".join(f"{k} {split_counts.get(k, 0)} rows ({100 * split_counts.get(k, 0) / total:.1f}%)" for k in ("train", "val", "test")),
            *gates,
        ],
        ("technical", "production_monitoring_plan"): [
            "Profile every new batch and compare it with this profile.",
            "Retrain when the holdout score falls below the validation score.",
        ],
    }
    rows = [(r, s, i, t) for (r, s), texts in sections.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SECTION_SCHEMA)


def export_sections(report: DataFrame, which: str, names: Sequence[str]) -> DataFrame:
    """The named sections of one report in the given order."""
    order = F.array(*[F.lit(n) for n in names])
    return (
        report.where((F.col("report") == which) & F.col("section").isin(*names))
        .withColumn("place", F.array_position(order, F.col("section")).cast("int"))
        .orderBy("place", "ordinal")
    )


def run_context(
    spark: SparkSession, task: str, split_counts: Mapping[str, int], champion: str, score: float | None, log: Sequence[str]
) -> DataFrame:
    """One row that sums the run up."""
    return spark.createDataFrame(
        [
            (
                task, split_counts.get("train", 0), split_counts.get("val", 0), split_counts.get("test", 0), champion, score,
                list(log[:CONTEXT_LINES]),
            )
        ],
        "task string, train bigint, val bigint, test bigint, champion string, score double, log array<string>",
    )
