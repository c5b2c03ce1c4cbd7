"""From a raw table to profile, cleaning, split, gates, tournament, rules, audit and report in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import require_columns
from tablewright.operators import assoc, clean, cluster, models, parity, profile, report, rules, split, stats, synth


@dataclass(frozen=True)
class Advisory:
    intent: rules.Intent
    profile: DataFrame
    recipe: clean.CleaningRecipe
    cleaned: DataFrame
    log: DataFrame
    grown: bool
    split: DataFrame
    split_counts: DataFrame
    gates: dict[str, DataFrame]
    champion: str
    score: float | None
    leaderboard: DataFrame
    importances: DataFrame | None
    holdout: DataFrame | None
    rules: DataFrame
    parity: DataFrame | None
    report: DataFrame
    context: DataFrame


def run_advisory(
    df: DataFrame,
    goal: str = "",
    key: str | None = None,
    task: str | None = None,
    target: str | None = None,
    sensitive: Sequence[str] = (),
    outcome: str | None = None,
    positive: Sequence[str] | None = None,
    min_rows: int = synth.MIN_ROWS,
    target_rows: int = synth.TARGET_ROWS,
    settings: models.Settings = models.Settings(),
    candidates: Sequence[str] | None = None,
    max_k: int = 6,
    restarts: int = 10,
) -> Advisory:
    """Actions run only for the profile, the fill values, the moments, the fits and the small result tables.

    ``task`` and ``target`` override the rules. The cleaned table is persisted for the steps that
    share it; unpersist ``cleaned`` when done.
    """
    spark = df.sparkSession
    require_columns(df, *([key] if key else []), *sensitive, *([outcome] if outcome else []))
    described = profile.profile(df).persist()
    columns = rules.column_profiles(described)
    if task is None:
        intent = rules.infer_intent(columns, goal)
    else:
        intent = rules.Intent(rules.resolve_task(task), target, "given by the caller")
    if intent.task != rules.CLUSTERING and intent.target not in df.columns:
        raise ValueError(f"the target {intent.target!r} is not a column")
    if sensitive and not (outcome or intent.target):
        raise ValueError("an audit needs an outcome, and segments have no target to stand in for it")
    recipe = rules.derive_recipe([c for c in columns if c.column != key], intent.target, positive)
    cleaned, log = clean.clean(df, recipe)
    cleaned, grown = synth.synthesise(cleaned, min_rows, target_rows, settings.seed)
    cleaned = cleaned.drop("is_synthetic")
    if grown and key:
        cleaned, key = cleaned.drop(key), None  # its copies no longer identify rows and must not become a feature
    cleaned = cleaned.persist(StorageLevel.MEMORY_AND_DISK)
    lines = [r["message"] for r in log.orderBy("step").collect()]  # one line per cleaning step
    if grown:
        lines.append(f"table enlarged to {target_rows} rows")

    parts = split.split_70_15_15(cleaned, key=key, seed=settings.seed)
    counts = split.split_counts(parts)
    sizes = {r["split"]: r["n"] for r in counts.collect()}
    body = cleaned.drop(key) if key else cleaned
    importances = holdout = None
    if intent.task == rules.CLUSTERING:
        factors = stats.fit_factors(body)
        gates = {
            "kmo_bartlett": stats.kmo_bartlett(body), "factors": factors.summary(body), "loadings": factors.loadings(body),
            "scores": factors.scores(body),
        }
        kmo = gates["kmo_bartlett"].first()
        notes = [f"Sampling adequacy {kmo['kmo_score']}: {kmo['kmo_rating']}, {kmo['clustering_suitability']}."]
        result = cluster.clustering_tournament(body, max_k=max_k, restarts=restarts, seed=settings.seed)
        champion, score, score_name, leaderboard = result.best_algorithm, result.silhouette, "silhouette", result.leaderboard
        labelled: DataFrame | None = result.labelled
        holdout = labelled
        drivers: list[str] = []
    else:
        gates = {"significance": stats.feature_significance(body, intent.target)}
        kept = gates["significance"].where("action = 'Retain in Model'").count()
        notes = [f"{kept} numeric features differ between the classes."]
        run = models.classification_tournament if intent.task == rules.CLASSIFICATION else models.regression_tournament
        outcome_of = run(cleaned, intent.target, key=key, models=candidates, settings=settings)
        champion, leaderboard = outcome_of.best_algorithm, outcome_of.leaderboard
        score_name = "f1_score" if intent.task == rules.CLASSIFICATION else "r2_score"
        score = outcome_of.scores[score_name]
        importances, holdout = outcome_of.importances, outcome_of.holdout
        drivers = [r["feature"] for r in importances.orderBy(F.desc("importance"), "feature").limit(2).collect()]
    mined = assoc.mine_rules(body)
    audit = parity.parity_audit_all(cleaned, sensitive, outcome or intent.target) if sensitive else None
    missing = profile.shape(cleaned).first()["missing_cells"]
    return Advisory(
        intent, described, recipe, cleaned, log, grown, parts, counts, gates, champion, score, leaderboard, importances,
        holdout, mined, audit,
        report.report_sections(spark, intent.task, champion, score, score_name, lines, sizes, missing, notes, drivers),
        report.run_context(spark, intent.task, sizes, champion, score, lines),
    )
