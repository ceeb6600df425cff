"""Score profiles: from nested trials to components in long form (trial_id, profile, component, value, note, ordinal)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions import stats
from trialweave.operators.flatten import standing_attempt

# Fixed values.
BASELINE_ENDS = ("baseline-compile", "baseline-run", "baseline-disagree", "sim-gap")
COMPILED_STAGES = ("S4", "S5")
OUTCOME_COMPONENTS = ("correct", "correct_paper", "within_10pct", "first_try", "sim_t", "sim_t_c", "sim_t_tiktoken", "sim_l", "self_corr", "cap_hit", "fence_quirk", "compiled", "compiled_first_try")
NOTES = {
    "baseline": "ended at the baseline", "gap": "the run stopped at a simulator gap", "compile_only": "compile-stage reproduction", "not_aligned": "the run was not aligned",
    "correct_paper": "a manual judgment, not computed", "within_10pct": "no timing profiler", "sim": "no candidate or no reference text",
}


@dataclass(frozen=True)
class Weights:
    """Fixed values of the reward: stage bases, warnings, alignment, guards, corrections."""

    stage_base: dict[str, float] = field(default_factory=lambda: {"S0": -1.0, "S1": -0.8, "S2": -0.6, "S3": -0.4, "S4": 0.0, "S5": 0.2})
    warning_weight: float = 0.02
    warning_cap: int = 10
    alignment_weight: float = 0.8
    guard_violation: float = -1.0
    correction_penalty: float = 0.05


def warning_count(stage: Column, diagnostics: Column) -> Column:
    """Distinct places (code, file, line, column; null is a value) of compile and jit warnings; 0 below S4."""
    found = F.filter(diagnostics, lambda d: (d["severity"] == "warning") & d["stage"].isin("compile", "jit"))
    places = F.array_distinct(F.transform(found, lambda d: F.struct(d["code"], d["file"], d["line"], d["column"])))
    return F.when(stage.isin(*COMPILED_STAGES), F.size(places)).otherwise(F.lit(0))


def reward(stage: Column, warnings: Column, mean: Column, guard: Column, w: Weights) -> Column:
    """R of one attempt."""
    base = F.element_at(F.create_map(*[F.lit(x) for kv in w.stage_base.items() for x in kv]), stage)
    term = F.when((stage == "S5") & mean.isNotNull(), F.lit(w.alignment_weight) * mean).otherwise(F.lit(0.0))
    return F.when(guard == 1.0, F.lit(w.guard_violation)).otherwise(base - F.lit(w.warning_weight) * F.least(warnings, F.lit(w.warning_cap)) + term)


def scored(w: Weights | None = None, components: bool = True) -> Column:
    """The attempts' scores, in the trial's own row: an array of (index, components, r, guard), or without components.

    The gap rule leaves the last attempt's R open unless a guard was broken.
    """
    w = w or Weights()
    at_gap, n = F.col("final.end_reason.code").eqNullSafe("sim-gap"), F.size("attempts")

    # What an attempt's score is made of comes first, as an array of its own: inside a lambda an expression is evaluated wherever it stands.
    def known(a: Column) -> Column:
        g, stage = a["guards"], a["stage_reached"]
        guard = stats.any_true_all_false(g["host_compute"], g["harness_tamper"], g["oracle_access"])
        return F.struct(a["index"].alias("index"), stage.alias("stage"), a["alignment"]["mean"].alias("mean"), guard.alias("guard"), warning_count(stage, a["diagnostics"]).alias("warnings"))

    def one(x: Column) -> Column:
        stage, mean, guard, clean = x["stage"], x["mean"], x["guard"], x["stage"] == "S5"
        gap = at_gap & (x["index"] == n - 1) & ~guard.eqNullSafe(F.lit(1.0))
        r = F.when(~gap, reward(stage, x["warnings"], mean, guard, w)).alias("r")
        if not components:
            return F.struct(x["index"].alias("index"), r, guard.alias("guard"))
        parts = {
            "stage_base": F.element_at(F.create_map(*[F.lit(y) for kv in w.stage_base.items() for y in kv]), stage), "warning_count": x["warnings"].cast("double"),
            "alignment_term": F.when(clean & mean.isNotNull(), F.lit(w.alignment_weight) * mean).otherwise(F.lit(0.0)), "guard": guard, "alignment_missing": F.when(clean & mean.isNull(), 1.0).otherwise(0.0),
        }
        return F.struct(x["index"].alias("index"), F.create_map(*[y for k, v in parts.items() for y in (F.lit(k), v)]).alias("components"), r, guard.alias("guard"))

    return F.transform(F.transform("attempts", known), one)


def _turns(s: Column, w: Weights) -> tuple[Column, Column]:
    """A trial's single-turn and multi-turn value from its attempts' scores: first R; and last R, or the guard value where any attempt broke one, less the penalty for corrections."""
    rs = F.transform(s, lambda x: F.struct(x["index"].alias("index"), x["r"].alias("r")))
    broken = F.coalesce(F.exists(s, lambda x: F.coalesce(x["guard"] == 1.0, F.lit(False))), F.lit(False))
    multi = F.when(broken, F.lit(w.guard_violation)).otherwise(F.array_max(rs)["r"]) - F.lit(w.correction_penalty) * F.col("final.corrections")
    return F.array_min(rs)["r"], multi


def attempt_scores(t: DataFrame, w: Weights | None = None) -> DataFrame:
    """(trial_id, attempt_index, components, r, guard)."""
    each = t.select("trial_id", F.explode(scored(w)).alias("s"))
    return each.select("trial_id", F.col("s.index").alias("attempt_index"), "s.components", "s.r", "s.guard")


def trial_scores(t: DataFrame, w: Weights | None = None) -> DataFrame:
    """(trial_id, single_turn, multi_turn): each trial's in its own row, so nothing is shuffled."""
    w = w or Weights()
    single, multi = _turns(F.col("__s"), w)
    return t.withColumn("__s", scored(w, False)).select("trial_id", single.alias("single_turn"), multi.alias("multi_turn"))


def clean_run(run: Column) -> Column:
    return run["exit_code"].eqNullSafe(F.lit(0)) & run["hang"].eqNullSafe(F.lit(False)) & ~run["sim_ub"].eqNullSafe(F.lit(True))


def ran(run: Column) -> Column:
    return run["exit_code"].isNotNull() | run["hang"].eqNullSafe(F.lit(True)) | run["stdout_ref"].isNotNull()


def correct(t_notes: dict[str, str] = NOTES, standing: Column | None = None) -> Column:
    """A struct (value, note) of whether the output that stands is right; the note says why the value is null.

    ``standing`` names a column that holds the standing attempt, which else is looked for in each branch.
    """
    end, standing = F.col("final.end_reason.code"), standing_attempt() if standing is None else standing
    at_baseline = (F.size("attempts") == 0) & F.coalesce(end.isin(*BASELINE_ENDS), F.lit(False))

    def said(value, note):
        return F.struct(F.lit(value).cast("double").alias("value"), (note if isinstance(note, Column) else F.lit(note)).cast("string").alias("note"))

    unclean = ~F.coalesce(standing["stage_reached"].isin(*COMPILED_STAGES), F.lit(False)) | ~clean_run(standing["run"])
    return (
        F.when(at_baseline, said(None, F.concat(F.lit(f"{t_notes['baseline']} ("), end, F.lit(")"))))
        .when(end.eqNullSafe(F.lit("sim-gap")), said(None, t_notes["gap"]))
        .when(standing.isNull() & ran(F.col("reference_run")), said(0.0, None))
        .when(standing.isNull(), said(None, t_notes["compile_only"]))
        .when(unclean, said(0.0, None))
        .when(standing["alignment"]["mean"].isNull(), said(None, t_notes["not_aligned"]))
        .when(standing["alignment"]["mean"] == 1.0, said(1.0, None))
        .otherwise(said(0.0, None))
    )


def outcome_cells(t: DataFrame, similarity: DataFrame | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """The trials with what the outcome components are made of, and each component as a struct (value, note)."""
    end, first = F.col("final.end_reason.code"), F.col("final.corrections") == 0
    at_baseline = (F.size("attempts") == 0) & F.coalesce(end.isin(*BASELINE_ENDS), F.lit(False))
    compiled = F.coalesce(F.try_element_at("attempts", F.lit(-1))["stage_reached"].isin(*COMPILED_STAGES), F.lit(False))
    ended = F.when(at_baseline, F.concat(F.lit(f"{NOTES['baseline']} ("), end, F.lit(")")))
    hits = F.aggregate("attempts", F.lit(0), lambda n, a: n + F.size(F.filter(a["diagnostics"], lambda d: d["code"] == "fence-quirk")))
    sims = ("sim_t", "sim_t_c", "sim_t_tiktoken", "sim_l")
    if similarity is not None:
        t = t.join(similarity.select(F.col("trial_id"), *[F.col(s).alias(f"__{s}") for s in sims if s in similarity.columns]), "trial_id", "left")
    t = t.withColumn("__standing", standing_attempt()).withColumn("__correct", correct(standing=F.col("__standing"))).withColumn("__hits", hits)
    value = F.col("__correct.value")
    cells = {
        "correct": (value, F.col("__correct.note")), "correct_paper": (F.lit(None), F.lit(NOTES["correct_paper"])), "within_10pct": (F.lit(None), F.lit(NOTES["within_10pct"])),
        "first_try": (F.when(value.isNotNull(), ((value == 1.0) & first).cast("double")), F.col("__correct.note")),
        "self_corr": (F.col("final.corrections").cast("double"), F.lit(None)), "cap_hit": (end.eqNullSafe(F.lit("correction-cap")).cast("double"), F.lit(None)), "fence_quirk": (F.col("__hits").cast("double"), F.lit(None)),
        "compiled": (F.when(~at_baseline, compiled.cast("double")), ended), "compiled_first_try": (F.when(~at_baseline, (compiled & first).cast("double")), ended),
    }
    for s in sims:
        v = F.col(f"__{s}") if f"__{s}" in t.columns else F.lit(None).cast("double")
        cells[s] = (v, F.when(v.isNull(), F.lit(NOTES["sim"])))
    return t, {c: F.struct(cells[c][0].cast("double").alias("value"), cells[c][1].cast("string").alias("note")) for c in OUTCOME_COMPONENTS}


def outcomes(t: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """One row a trial with a struct (value, note) for each outcome component; ``similarity`` has (trial_id, sim_t, ...)."""
    t, cells = outcome_cells(t, similarity)
    return t.select("trial_id", *[cell.alias(c) for c, cell in cells.items()])


def long_rows(cells: dict[str, Column], profile: str, scalar: str) -> Column:
    """Components (structs of value and note) as an array of rows in order, the scalar last."""
    each = [*cells.items(), ("scalar", cells[scalar])]
    return F.array(*[F.struct(F.lit(profile).alias("profile"), F.lit(n).alias("component"), x["value"].alias("value"), x["note"].alias("note"), F.lit(i).alias("ordinal")) for i, (n, x) in enumerate(each)])


def to_long(wide: DataFrame, profile: str, scalar: str, components: tuple[str, ...] = OUTCOME_COMPONENTS) -> DataFrame:
    """Components as rows in order, the scalar last."""
    return wide.select("trial_id", F.inline(long_rows({c: F.col(c) for c in components}, profile, scalar))).select("trial_id", "profile", "component", "value", "note", "ordinal")


def to_wide(long: DataFrame, components: tuple[str, ...]) -> DataFrame:
    """One column a component; the names are given, so no job looks for them."""
    return long.groupBy("trial_id").pivot("component", list(components)).agg(F.first("value"))


def _reward_rows(t: DataFrame) -> tuple[DataFrame, Column]:
    w = Weights()
    single, multi = _turns(F.col("__s"), w)
    t = t.withColumn("__s", scored(w, False)).withColumns({"__single": single, "__multi": multi}).drop("__s")
    cell = lambda c: F.struct(F.col(c).alias("value"), F.when(F.col(c).isNull(), F.lit("not computed")).alias("note"))
    return t, long_rows({"single_turn": cell("__single"), "multi_turn": cell("__multi")}, "reward", "multi_turn")


def _outcome_rows(t: DataFrame) -> tuple[DataFrame, Column]:
    t, cells = outcome_cells(t)
    return t, long_rows(cells, "outcome", "correct")


#: Each profile adds what it needs to the trial's row, and gives the rows that it makes of it.
PROFILES: dict[str, Callable[[DataFrame], tuple[DataFrame, Column]]] = {"reward": _reward_rows, "outcome": _outcome_rows}


def score_trials(t: DataFrame, profiles: list[str]) -> DataFrame:
    """All profiles' components in long form; values are finite or null."""
    unknown = sorted(set(profiles) - PROFILES.keys())
    if unknown or len(set(profiles)) != len(profiles):
        raise ValueError(f"unknown or repeated profiles: {unknown or profiles}")
    rows = []
    for p in profiles:
        t, of_profile = PROFILES[p](t)
        rows.append(of_profile)
    # All profiles come from the trial's one row, so the records are made once.
    out = t.select("trial_id", F.inline(F.concat(*rows)))
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return out.withColumn("value", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a component is not finite")).cast("double")).otherwise(F.col("value")))


def apply_scores(t: DataFrame, w: Weights | None = None) -> DataFrame:
    """The nested records with attempt and final scores written back, row by row."""
    w = w or Weights()
    _, multi = _turns(F.col("__s"), w)
    put = lambda a, x: a.withField("score", F.struct(x["components"].alias("components"), x["r"].alias("scalar")))
    return t.withColumn("__s", scored(w)).withColumn("attempts", F.zip_with("attempts", "__s", put)).withColumn("final", F.col("final").withField("score", multi)).select(*t.columns)


def reference_end(run: Column) -> Column:
    """Why a reference run ends a trial: gap, hang, undefined behaviour, exit status, in this order."""
    return F.when(run["gap"].isNotNull(), F.concat(F.lit("gap "), run["gap"])).when(run["hang"].eqNullSafe(F.lit(True)), F.lit("hang")).when(run["sim_ub"].eqNullSafe(F.lit(True)), F.lit("undefined behavior")).when(~run["exit_code"].eqNullSafe(F.lit(0)), F.concat(F.lit("exit "), F.coalesce(run["exit_code"].cast("string"), F.lit("unknown"))))


def return_code(code: Column) -> Column:
    """A shell status of 129 to 192 is a signal."""
    return F.when((code > 128) & (code <= 192), F.lit(128) - code).otherwise(code)


def time_limit(reference_s: Column, factor: float = 10.0, least: float = 30.0) -> Column:
    return F.greatest(F.lit(factor) * reference_s, F.lit(least))


def run_stage(diagnostics: Column, run: Column) -> Column:
    jit = F.exists(diagnostics, lambda d: (d["stage"] == "jit") & (d["severity"] == "error"))
    return F.when(jit, F.lit("S1")).when(clean_run(run), F.lit("S5")).otherwise(F.lit("S4"))
