"""What a plan over records makes, and how often: an array once, a column only where it is asked for, a trial in its own row."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialweave import trial_queries
from trialweave.operators import facts, flatten, metrics, scoring
from trialweave.sources.schema import TRIAL, filled

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attempts_are_made_once(spark):
    """No filter on the size of the attempts makes them another time below the generator."""
    t = trial_queries.trials(spark, SF)
    for df in (flatten.attempts_table(t), facts.trial_facts(t).where("section like 'attempt%'"), trial_queries.applied_scores(spark, SF), trial_queries.attempt_reports(spark, SF), trial_queries.unaligned(spark, SF)):
        assert "Filter (size(" not in plan(df)


def test_only_the_columns_asked_for_are_made(spark):
    text = plan(trial_queries.trials(spark, SF).select("trial_id", "final"))
    assert "watcher" not in text and "system" not in text


def test_all_profiles_come_from_one_pass(spark):
    t = trial_queries.trials(spark, SF)
    for df, aggregates in ((scoring.score_trials(t, ["reward", "outcome"]), 1), (flatten.diagnostics_table(t), 1), (facts.trial_facts(t), 2)):
        assert plan(df).count("Relation [") == aggregates
    assert plan(scoring.attempt_scores(t)).count("array_distinct") == 1


def test_outcomes_and_messages_need_no_exchange(spark):
    t = spark.createDataFrame([], TRIAL)
    for df in (metrics.scored_trials(t), facts.shown_messages(t)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_items_and_messages(spark):
    df = spark.sql("select * from values (1, array('x', null)), (2, array()), (3, null) as t(k, xs)").select("k", F.col("xs").cast("array<string>").alias("xs"))
    assert [tuple(r) for r in flatten.items(df, "xs", "x", "k").collect()] == [(1, 0, "x"), (1, 1, None)]
    one = TRIAL["requests"].dataType.elementType
    said = lambda *hashes: filled(one["messages"].dataType, [{"role": F.lit("user"), "ref": {"sha256": F.lit(h).cast("string")}} for h in hashes])
    later, sooner, none = (filled(one, {"index": F.lit(i), "messages": m}) for i, m in ((1, said("b", "a", None)), (0, said("a", "a")), (2, F.lit(None).cast(one["messages"].dataType))))
    t = spark.range(1).select(F.lit("t").alias("trial_id"), F.array(later, sooner, none).alias("requests"))
    assert [(r["request"], r["ordinal"], r["sha256"], r["first"]) for r in facts.shown_messages(t).collect()] == [(0, 0, "a", True), (0, 1, "a", False), (1, 0, "b", True), (1, 1, "a", False), (1, 2, None, False)]


def test_outcomes_are_those_of_the_long_form(spark):
    t = trial_queries.trials(spark, SF).where("crc32(cast(trial_id as binary)) % 5 = 0")
    own, other = metrics.scored_trials(t), metrics.scored_trials(t, scoring.score_trials(t, ["outcome"]))
    assert own.columns == other.columns and own.exceptAll(other).isEmpty() and other.exceptAll(own).isEmpty()
