"""Run metrics per arm and direction: one wide aggregate for all rates, then rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions import stats
from trialweave.sources.schema import NO_STAGE, STAGES

# Fixed values.
METRICS = ("compile_rate", "run_rate", "correct_rate", "cap_hit_rate", "fence_quirk_rate", "first_try_rate", "sim_t_ge_0.6_rate", "sim_t_tiktoken_ge_0.6_rate", "within_10pct_rate", "pass@1", "pass@3")
CORRECTNESS = ("correct_rate", "first_try_rate", "sim_t_ge_0.6_rate", "sim_t_tiktoken_ge_0.6_rate", "pass@1", "pass@3")
ALIASES = {"sim_t_tiktoken_ge_0.6_rate": "sim_t_ge_0.6_rate"}
GROUP = ("arm", "direction")


def flags() -> dict[str, Column]:
    """The three-valued flag behind each rate; null leaves a trial out and counts it."""
    reached, correct = F.col("compiled").isNotNull(), F.col("correct") == 1.0
    own = lambda c: F.when(reached, c)
    return {
        "compile_rate": F.col("compiled") == 1.0,
        "run_rate": own(F.coalesce(F.col("stage") == "S5", F.lit(False))),
        "correct_rate": correct,
        "cap_hit_rate": own(F.col("cap_hit") == 1.0),
        "fence_quirk_rate": own(F.col("fence_quirk") > 0),
        "first_try_rate": F.when(correct, F.col("first_try") == 1.0),
        "sim_t_ge_0.6_rate": F.when(correct, stats.reaches_threshold(F.col("sim_t"))),
        "sim_t_tiktoken_ge_0.6_rate": F.when(correct, stats.reaches_threshold(F.col("sim_t_tiktoken"))),
    }


def rates(scored: DataFrame) -> DataFrame:
    """One row a group with num, den and excluded of every rate. ``scored`` has a row a trial: arm, direction, scenario,
    stage (of the last attempt, null without one), corrections, device, and the components."""
    among_correct = {"first_try_rate", "sim_t_ge_0.6_rate", "sim_t_tiktoken_ge_0.6_rate"}
    n_correct = F.count_if(F.col("correct") == 1.0)
    aggs = []
    for name, f in flags().items():
        all_ = n_correct if name in among_correct else F.count(F.lit(1))
        aggs += [F.count_if(f).alias(f"{name}_num"), F.count(f).alias(f"{name}_den"), (all_ - F.count(f)).alias(f"{name}_excluded")]
    note = F.lower(F.coalesce("correct_note", F.lit(""))).contains("compile-stage reproduction") & F.col("correct").isNull()
    aggs += [
        F.sum(F.coalesce("fence_quirk", F.lit(0.0))).alias("fence_hits"), F.count(F.lit(1)).alias("trials"), F.array_sort(F.collect_set(F.coalesce("device", F.lit("not recorded")))).alias("devices"),
        (F.bool_or(note) & F.bool_and(note | (F.col("correct").isNull() & F.col("compiled").isNull()))).alias("compile_only"),
    ]
    return scored.groupBy(*GROUP).agg(*aggs)


def pass_rates(scored: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Per group: pass@k summed over scenarios with a known outcome; null where one of them has fewer than k."""
    per = scored.groupBy(*GROUP, "scenario").agg(F.count("correct").alias("n"), F.count_if(F.col("correct") == 1.0).alias("c"), F.count("*").alias("trials"))
    aggs = [F.min("trials").alias("scenario_min"), F.max("trials").alias("scenario_max"), F.count("*").alias("scenarios"), F.count_if(F.col("n") > 0).alias("pass_den"), F.count_if(F.col("n") == 0).alias("empty_scenarios")]
    for k in ks:
        short = F.bool_or((F.col("n") > 0) & (F.col("n") < k))
        aggs.append(F.when(~short & (F.count_if(F.col("n") > 0) > 0), F.sum(F.when(F.col("n") > 0, stats.pass_at_k(F.col("n"), F.col("c"), k)))).alias(f"pass{k}_num"))
    return per.groupBy(*GROUP).agg(*aggs)


def metric_rows(scored: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(arm, direction, ordinal, metric, value, numerator, denominator, wilson_low, wilson_high, excluded, placeholder[, reference columns])."""
    # (A null arm or direction is a group like any other.)
    passes = pass_rates(scored).withColumnsRenamed({g: f"__{g}" for g in GROUP})
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in GROUP]
    wide = rates(scored).join(passes, same).drop(*[f"__{g}" for g in GROUP])
    cells = []
    for i, m in enumerate(METRICS):
        if m == "within_10pct_rate":
            num, den, out = F.lit(None).cast("double"), F.lit(None).cast("long"), F.lit(None).cast("long")
        elif m.startswith("pass@"):
            num = F.col(f"pass{m[5:]}_num")
            den, out = F.when(num.isNotNull(), F.col("pass_den")), F.col("correct_rate_excluded")
        else:
            den = F.nullif(F.col(f"`{m}_den`"), F.lit(0))
            num, out = F.when(den.isNotNull(), F.col(f"`{m}_num`").cast("double")), F.col(f"`{m}_excluded`")
        if m in CORRECTNESS:
            num, den = (F.when(~F.col("compile_only"), x) for x in (num, den))
        cells.append(F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(m).alias("metric"), num.alias("numerator"), den.cast("long").alias("denominator"), out.cast("long").alias("excluded"), F.lit(m == "within_10pct_rate").alias("placeholder")))
    rows = wide.select(*GROUP, "compile_only", "trials", "scenarios", "scenario_min", "scenario_max", "devices", F.inline(F.array(*cells)))
    low, high = stats.wilson(F.col("numerator"), F.col("denominator"))
    rows = rows.withColumns({"value": F.col("numerator") / F.col("denominator"), "wilson_low": low, "wilson_high": high})
    if reference is None:
        return rows
    name = F.expr("CASE metric " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE metric END")
    ref = reference.groupBy(F.col("direction").alias("__d"), F.col("metric").alias("__m")).agg(*[F.max(F.when(F.col("reading") == r, F.struct("count", "denominator"))).alias(r) for r in ("published", "recount", "recount_alternate")], F.max("cite").alias("cite"))
    joined = rows.join(ref, (F.col("direction") == F.col("__d")) & (name == F.col("__m")) & ~F.col("compile_only"), "left")
    return joined.drop("__d", "__m")


def stage_reached(scored: DataFrame) -> DataFrame:
    """Trials by last stage for S0 to S5 and none, zeros included: the counts of all stages come from one aggregate."""
    names = (*STAGES, NO_STAGE)
    got = F.coalesce("stage", F.lit(NO_STAGE))
    wide = scored.groupBy(*GROUP).agg(*[F.count_if(got == s).alias(s) for s in names])
    return wide.select(*GROUP, F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(s).alias("stage"), F.col(s).alias("count")) for i, s in enumerate(names)])))


def corrections(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*GROUP, "corrections").agg(F.count("*").alias("count"))


def scored_trials(trials: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """Trials with their outcome components side by side, as the functions above read them.

    Without ``long`` (components scored elsewhere) they come from the trial's own row, so nothing is shuffled; with it, a
    trial without scores is an error.
    """
    from trialweave.functions import ids
    from trialweave.operators import scoring

    i = ids.parse(F.col("trial_id"))
    of_trial = ["trial_id", F.col("__id.arm").alias("arm"), F.col("__id.direction").alias("direction"), ids.scenario(F.col("__id.bench"), F.col("__id.item")).alias("scenario"), F.try_element_at("attempts", F.lit(-1))["stage_reached"].alias("stage"), F.col("final.corrections").alias("corrections"), F.col("provenance.device").alias("device")]
    if long is None:
        t, cells = scoring.outcome_cells(trials)
        return t.withColumn("__id", i).select(*of_trial, *[x["value"].alias(c) for c, x in cells.items()], cells["correct"]["note"].alias("correct_note"))
    wide = scoring.to_wide(long.where("profile = 'outcome'"), scoring.OUTCOME_COMPONENTS)
    notes = long.where("profile = 'outcome' and component = 'correct'").select("trial_id", F.col("note").alias("correct_note"))
    j = trials.withColumn("__id", i).select(*of_trial).join(wide.withColumn("__scored", F.lit(True)), "trial_id", "left").join(notes, "trial_id", "left")
    return j.withColumn("trial_id", F.when(F.col("__scored"), F.col("trial_id")).otherwise(F.raise_error(F.concat(F.lit("no score of "), "trial_id")))).drop("__scored")
