"""Nested trial records to five flat tables; each is one lazy select over the same parent. Null stays apart from empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions import ids
from trialweave.sources import schema


def sorted_json(m: Column) -> Column:
    """A map as JSON text with sorted keys; null stays null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))), {"ignoreNullFields": "false"})


def struct_columns(prefix: str, base: str, fields: list[str]) -> list[Column]:
    return [F.col(f"{base}.{f}").alias(f"{prefix}_{f}") for f in fields]


def run_columns(prefix: str, base: str) -> list[Column]:
    refs = [F.col(f"{base}.{r}.{p}").alias(f"{prefix}_{r}_{p}") for r in ("stdout_ref", "outputs_ref") for p in ("sha256", "path")]
    return [*struct_columns(prefix, base, ["exit_code", "hang", "sim_ub", "wall_s"]), *refs, *struct_columns(prefix, base, list(schema.RUN_FLAGS)), sorted_json(F.col(f"{base}.outputs")).alias(f"{prefix}_outputs")]


def _keys() -> list[Column]:
    return [*[F.col(f"__id.{p}").alias(p) for p in schema.PARTITIONS], F.col("trial_id")]


def trials_table(t: DataFrame) -> DataFrame:
    t = t.withColumn("__id", ids.parse(F.col("trial_id")))
    return t.select(
        *_keys(), F.col("__id.item").alias("item"), F.col("__id.run").alias("run"), "recipe_hash",
        *struct_columns("toolchain_pins", "toolchain_pins", list(schema.PINS)),
        *struct_columns("provenance", "provenance", ["commit", "dirty", "device", "sdk", "date"]),
        *struct_columns("bench_item", "bench_item", ["suite", "item", "split", "direction"]),
        *struct_columns("model", "model", ["backend", "id"]),
        *struct_columns("model_sampling", "model.sampling", ["temperature", "top_p", "max_tokens"]),
        *run_columns("reference_run", "reference_run"),
        *struct_columns("context", "context", ["knowledge_summary", "source_description"]),
        *struct_columns("final", "final", ["stage_reached", "alignment", "score", "corrections", "wall_s"]),
        *struct_columns("final_end_reason", "final.end_reason", ["code", "message"]),
        F.size("attempts").cast("long").alias("attempt_count"),
    )


def items(t: DataFrame, of: str | Column, name: str, *keep: str | Column, at: str = "__at") -> DataFrame:
    """The columns ``keep`` with each item of an array and its place; empty and null arrays give no row.

    The outer form, as Spark puts a filter on the size of the array below the plain one, and makes the array once more for it.
    """
    return t.select(*keep, F.posexplode_outer(of).alias(at, name)).where(F.col(at).isNotNull())


def _attempts(t: DataFrame, *more: str) -> DataFrame:
    return items(t.withColumn("__id", ids.parse(F.col("trial_id"))), "attempts", "a", "__id", "trial_id", *more)


def attempts_table(t: DataFrame) -> DataFrame:
    return _attempts(t).select(
        *_keys(), F.col("a.index").alias("index"), *struct_columns("prompt_ref", "a.prompt_ref", ["sha256", "path"]), F.col("a.response_text.sha256").alias("response_sha256"),
        sorted_json(F.col("a.files")).alias("files"), F.col("a.diff_from_previous").alias("diff_from_previous"), F.col("a.stage_reached").alias("stage_reached"), F.size("a.diagnostics").cast("long").alias("diagnostic_count"),
        *run_columns("run", "a.run"), F.col("a.alignment.per_input").alias("alignment_per_input"), F.col("a.alignment.mean").alias("alignment_mean"),
        *struct_columns("profile", "a.profile", ["runtime_s", "avg_power_w", "energy_j"]), *struct_columns("guards", "a.guards", ["host_compute", "harness_tamper", "oracle_access"]),
        sorted_json(F.col("a.score.components")).alias("score_components"), F.col("a.score.scalar").alias("score_scalar"),
    )


def _listed(t: DataFrame, own: str, of_attempt: Callable[[Column], Column]) -> DataFrame:
    """Rows of a trial's own list (attempt_index null) and of each attempt's, with their places; the trial's row is read once."""
    mine = F.array(F.struct(F.lit(None).cast("long").alias("attempt_index"), F.col(own).alias("xs")))
    theirs = F.transform("attempts", lambda a: F.struct(a["index"].alias("attempt_index"), of_attempt(a).alias("xs")))
    lists = items(t.withColumn("__id", ids.parse(F.col("trial_id"))), F.concat(mine, F.coalesce(theirs, F.slice(mine, 1, 0))), "l", "__id", "trial_id")
    rows = items(lists, "l.xs", "x", *_keys(), F.col("l.attempt_index").alias("attempt_index"), at="ordinal")
    return rows.withColumn("ordinal", F.col("ordinal").cast("long")).select("*", "x.*").drop("x")


def diagnostics_table(t: DataFrame) -> DataFrame:
    return _listed(t, "baseline_diagnostics", lambda a: a["diagnostics"])


def output_stats_table(t: DataFrame) -> DataFrame:
    return _listed(t, "reference_agreement", lambda a: a["alignment"]["outputs"])


def requests_table(t: DataFrame) -> DataFrame:
    r = items(t.withColumn("__id", ids.parse(F.col("trial_id"))), "requests", "r", "__id", "trial_id")
    return r.select(
        *_keys(), F.col("r.index").alias("index"), F.col("r.stage").alias("stage"), F.col("r.attempt_index").alias("attempt_index"),
        F.transform("r.messages", lambda m: m["role"]).alias("message_roles"), F.transform("r.messages", lambda m: m["ref"]["sha256"]).alias("message_sha256"),
        *struct_columns("reply_ref", "r.reply_ref", ["sha256", "path"]), F.size("r.diagnostics").cast("long").alias("diagnostic_count"),
    )


def flat_tables(t: DataFrame) -> dict[str, DataFrame]:
    return {"trials": trials_table(t), "attempts": attempts_table(t), "diagnostics": diagnostics_table(t), "requests": requests_table(t), "output_stats": output_stats_table(t)}


def violations(t: DataFrame) -> DataFrame:
    """(trial_id, problem) of records that break a rule; a write is allowed only where this is empty."""
    index_ok = F.transform("attempts", lambda a: a["index"]).eqNullSafe(F.when(F.size("attempts") > 0, F.transform(F.sequence(F.lit(0), F.size("attempts") - 1), lambda i: i.cast("long"))).otherwise(F.array().cast("array<long>")))
    outside = F.exists(F.coalesce("requests", F.array().cast(dict(t.dtypes)["requests"])), lambda r: r["attempt_index"].isNotNull() & ~F.exists("attempts", lambda a: a["index"] == r["attempt_index"]))
    hex64 = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike("^[0-9a-f]{64}$")
    rules = {
        "malformed trial id": ~F.coalesce(F.col("trial_id").rlike(ids.VALID), F.lit(False)),
        "attempt indices are not 0..n-1": ~index_ok,
        "a request names no attempt": outside,
        "unknown stage": F.exists("attempts", lambda a: ~F.coalesce(a["stage_reached"].isin(*schema.STAGES), F.lit(False))),
        "unknown severity": F.exists(F.flatten(F.transform("attempts", lambda a: a["diagnostics"])), lambda d: ~F.coalesce(d["severity"].isin(*schema.SEVERITIES), F.lit(False))),
        "unknown end reason": F.col("final.end_reason.code").isNotNull() & ~F.col("final.end_reason.code").isin(*schema.END_REASONS),
        "negative corrections": F.col("final.corrections") < 0,
        "bad hash": hex64("reference_run.stdout_ref.sha256"),
        "number is not finite": F.isnan("final.score") | (F.abs("final.score") == float("inf")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return t.select("trial_id", F.explode(found).alias("problem"))


def last_attempt(attempts: str = "attempts") -> Column:
    return F.try_element_at(F.col(attempts), F.lit(-1))


def standing_attempt(attempts: str = "attempts") -> Column:
    """The last attempt whose output was kept."""
    return F.try_element_at(F.filter(F.col(attempts), lambda a: a["run"]["stdout_ref"].isNotNull()), F.lit(-1))


def append_diagnostic(condition: Column, stage: str, severity: str, code: str, message: str, diagnostics: str = "diagnostics") -> Column:
    """The list with one more entry where a condition holds."""
    one = F.struct(F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("column"), F.lit(message).alias("message"))
    return F.when(F.coalesce(condition, F.lit(False)), F.concat(F.col(diagnostics), F.array(one))).otherwise(F.col(diagnostics))
