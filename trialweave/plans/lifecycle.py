"""The two lifecycles: nested records to flat tables, and nested records to scores and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialweave.operators import flatten, metrics, scoring
from trialweave.plans import report
from trialweave.sources import io


def flatten_run(trials: DataFrame, out: str) -> None:
    """Validate, then write the five flat tables."""
    bad = flatten.violations(trials).first()
    if bad is not None:
        raise ValueError(f"{bad['trial_id']}: {bad['problem']}")
    io.write_flat(flatten.flat_tables(io.check_keys(trials)), out)


def score_run(spark: SparkSession, run_dir: str, profiles: list[str], out: str | None = None, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """Components of all profiles, metric rows, stages and corrections of a run; written with a manifest if ``out`` is given."""
    trials = io.check_keys(io.load_trials(spark, run_dir))
    long = scoring.score_trials(trials, profiles)
    tables = {"trial_components": long}
    if "outcome" in profiles:
        scored = metrics.scored_trials(trials)
        tables |= {"metrics": metrics.metric_rows(scored, reference), "stage_reached": metrics.stage_reached(scored), "corrections": metrics.corrections(scored)}
    if out:
        io.write_with_manifest(tables, out, {"profiles": profiles})
    return tables


def report_run(tables: dict[str, DataFrame]) -> str:
    return report.metrics_markdown(tables["metrics"], tables["stage_reached"], tables["corrections"])
