"""What becomes of replies, runs and trials: stages, predicates, messages and final records, as Column expressions.

All of them read one nested record, so nothing here shuffles but ``previous_diffs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import exact, text
from trialweave.operators import flatten, scoring

# Codes, messages, limits.
GUARD_PREFIX, MISSING_FILE, WATCHER = "guard-", "missing-file", "watcher"
STALE_OUTPUT, UPSTREAM_CRASH, REFERENCE_TRUNCATED, REFERENCE_INCOMPLETE = "stale-output", "upstream-crash", "reference-stdout-truncated", "reference-workdir-incomplete"
TIMEOUT_CODES, KILLED_CODE = (124, 137, 143, -1), 137
GATE_CORRECTIONS, FIRST_ERRORS = 7, 2
UB_FINDING = "the simulator reported undefined behavior"
HANG_FINDING = "a hang on a simulator most likely means a deadlock: a circular buffer or a semaphore that a core waits on and that is never filled or signalled"
FLAG_WARNINGS = {
    "stdout_truncated": ("stdout-truncated", "the run's stdout passed the executor's output cap, so only the part kept is recorded and aligned"),
    "stderr_truncated": ("stderr-truncated", "the run's stderr passed the executor's output cap, so only the part kept is fed back"),
    "workdir_incomplete": ("workdir-incomplete", "the executor returned only part of what the run wrote in its workdir, because the run passed a cap or limit"),
}
REFERENCE_NOTES = {
    REFERENCE_TRUNCATED: "the reference run's stdout was truncated at the executor's output cap, so this run's stdout was not aligned against it and its alignment stays unset",
    REFERENCE_INCOMPLETE: "the target reference run's workdir came back incomplete, so its output files may have been cut; this run's output files were not aligned against them and its alignment stays unset",
}


def classify_exit(code: Column, wall_s: Column, limit_s: Column) -> Column:
    """A struct (hang, killed): a timeout's status counts from the wall limit on; before it, a kill is a kill."""
    hang = code.isin(*TIMEOUT_CODES) & (wall_s >= limit_s)
    return F.struct(F.coalesce(hang, F.lit(False)).alias("hang"), F.coalesce((code == KILLED_CODE) & ~hang, F.lit(False)).alias("killed"))


def has_error(diagnostics: Column) -> Column:
    return F.exists(diagnostics, lambda d: d["severity"] == "error")


def prompt_diagnostics(diagnostics: Column) -> Column:
    """Those that may enter a prompt: a guard's never do."""
    return F.filter(diagnostics, lambda d: ~F.startswith(F.coalesce(d["code"], F.lit("")), F.lit(GUARD_PREFIX)))


def reply_stage(files: Column, problems: Column) -> Column:
    """S1 where a reply's blocks gave a file and no problem but missing files (codes in ``problems``), else S0."""
    usable = (F.size(files) > 0) & F.forall(problems, lambda code: code == MISSING_FILE)
    return F.when(usable, "S1").otherwise("S0")


def fenced_stage(reply: Column) -> Column:
    """S1 where a reply read as one fenced block has one, else S0."""
    return F.when(text.first_fence(reply)["found"], "S1").otherwise("S0")


def needs_correction(attempt: Column) -> Column:
    return (attempt["stage_reached"] != "S4") & has_error(attempt["diagnostics"])


def buildable(attempt: Column, fence_tag: bool = True) -> Column:
    """No error, and parsed; without the ``fence_tag`` fix an unparsed attempt is built too."""
    stage = attempt["stage_reached"]
    return ~has_error(attempt["diagnostics"]) & ((stage == "S1") if fence_tag else stage.isin("S0", "S1"))


def run_findings(run: Column, diagnostics: Column, simulator: bool) -> Column:
    """What a failed run's simulator said, in order: undefined behaviour; for a hang what it means, and the watcher's notes."""
    hung = run["hang"].eqNullSafe(F.lit(True)) & F.lit(simulator)
    notes = F.filter(diagnostics, lambda d: (d["stage"] == "run") & (d["severity"] == "note") & (d["code"] == WATCHER))
    ub = F.when(run["sim_ub"].eqNullSafe(F.lit(True)), F.array(F.lit(UB_FINDING))).otherwise(F.array().cast("array<string>"))
    return F.concat(ub, F.when(hung, F.concat(F.array(F.lit(HANG_FINDING)), F.transform(notes, lambda d: d["message"]))).otherwise(F.array().cast("array<string>")))


def run_status(run: Column, diagnostics: Column, limit_s: Column, simulator: bool = False) -> Column:
    """How a run ended, then its findings."""
    limit = F.regexp_replace(F.format_string("%.6f", limit_s.cast("double")), r"\.?0+$", "")
    ended = (
        F.when(run["hang"].eqNullSafe(F.lit(True)), F.concat(F.lit("the program was stopped at its wall limit of "), limit, F.lit(" s")))
        .when(run["exit_code"].isNull(), "the program ended with no exit status")
        .otherwise(F.concat(F.lit("the program exited with status "), run["exit_code"].cast("string")))
    )
    return F.concat_ws("; ", ended, run_findings(run, diagnostics, simulator))


def run_error_text(status: Column, stderr: Column) -> Column:
    err = F.regexp_replace(F.coalesce(stderr, F.lit("")), "\r\n?", "\n")
    return F.when(err != "", F.concat(status, F.lit("; its standard error follows:\n"), err)).otherwise(status)


def flag_warnings(run: Column) -> Column:
    """One (code, message) for each flag of a run that is set, in the flags' order."""
    rows = [F.when(run[flag].eqNullSafe(F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))) for flag, (code, message) in FLAG_WARNINGS.items()]
    return F.array_compact(F.array(*rows))


def status_text(attempt: Column) -> Column:
    """An attempt's stage, its first errors, and how many more there are."""
    errors = F.filter(attempt["diagnostics"], lambda d: d["severity"] == "error")
    shown = F.transform(F.slice(errors, 1, FIRST_ERRORS), lambda d: F.concat(d["stage"], F.lit(" error: "), d["message"]))
    more = F.when(F.size(errors) > FIRST_ERRORS, F.concat((F.size(errors) - FIRST_ERRORS).cast("string"), F.lit(" more error(s)")))
    return F.concat_ws("; ", attempt["stage_reached"], shown, more)


def final_record(attempts: str = "attempts") -> Column:
    """A trial's final block from its attempts: last stage, alignment of the output that stands, corrections."""
    return F.struct(
        flatten.last_attempt(attempts)["stage_reached"].alias("stage_reached"),
        flatten.standing_attempt(attempts)["alignment"]["mean"].alias("alignment"),
        F.greatest(F.size(attempts) - 1, F.lit(0)).cast("long").alias("corrections"),
    )


def past_gate(trials: DataFrame) -> DataFrame:
    """(trial_id, code, standing): trials whose last attempt compiled past the execution gate and so was not run.

    Where an earlier attempt ran, its output stands and is stale; where none did, the trial ends.
    """
    last, standing = flatten.last_attempt(), flatten.standing_attempt()
    gated = trials.where((last["index"] > GATE_CORRECTIONS) & (last["stage_reached"] == "S4") & last["run"]["stdout_ref"].isNull())
    return gated.select("trial_id", F.when(standing.isNull(), UPSTREAM_CRASH).otherwise(STALE_OUTPUT).alias("code"), standing["index"].alias("standing"))


def unaligned_warnings(trials: DataFrame) -> DataFrame:
    """(trial_id, index, code, message): attempts that may not be aligned, as the reference they would be held against was cut."""
    a = flatten.items(trials, "attempts", "a", "trial_id", F.col("reference_run").alias("r"))
    cut = F.when(F.col("r.stdout_truncated").eqNullSafe(F.lit(True)) & F.col("a.run.stdout_ref").isNotNull(), REFERENCE_TRUNCATED)
    cut = cut.when(F.col("r.workdir_incomplete").eqNullSafe(F.lit(True)) & F.col("a.run.outputs").isNotNull(), REFERENCE_INCOMPLETE)
    said = F.element_at(F.create_map(*[F.lit(x) for pair in REFERENCE_NOTES.items() for x in pair]), F.col("code"))
    return a.select("trial_id", F.col("a.index").alias("index"), cut.alias("code")).where("code is not null").withColumn("message", said)


def alignment_means(attempts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean of the inputs' alignments of each attempt, by exact sums; null where one is null."""
    return exact.exact_means(attempts, keys, value)


def previous_diffs(attempts: DataFrame, keys: list[str], order: str, files: str) -> DataFrame:
    """Each attempt with the unified diff from the attempt before it (``files``: a JSON map); empty for the first."""
    before = F.lag(files).over(Window.partitionBy(*keys).orderBy(order))
    d = attempts.withColumn("__before", before)
    return d.withColumn("diff_from_previous", F.when(F.col("__before").isNull(), "").otherwise(text.unified_diff("__before", files))).drop("__before")


def appended(attempts: Column, attempt: Column) -> Column:
    """The attempts with one more, whose index has to be their number."""
    n = F.size(attempts)
    ok = F.when(attempt["index"] == n, attempt).otherwise(F.raise_error(F.concat(F.lit("an attempt's index is not "), n.cast("string"))))
    return F.concat(attempts, F.array(ok))


def over_limit(results: DataFrame, reference: DataFrame, keys: list[str], factor: float = 10.0, least: float = 30.0) -> DataFrame:
    """Results (keys, runtime) above the time limit that the reference's runtime (keys, reference) sets."""
    j = results.join(reference, keys).withColumn("time_limit", scoring.time_limit(F.col("reference"), factor, least))
    return j.where(F.col("runtime") > F.col("time_limit"))
