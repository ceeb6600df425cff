"""What a trial's page and a review packet show, as rows: facts by section, messages once each, flags that were not recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators.flatten import items
from trialweave.sources.schema import PINS, RUN_FLAGS

RUN_FACTS = ("exit_code", "hang", "sim_ub", "wall_s", *RUN_FLAGS)


def _stacked(base: DataFrame, keys: list[str], section: Column, facts: dict[str, Column]) -> DataFrame:
    """(keys, section, ordinal, key, value): facts as rows in their order; null values stay."""
    return base.select(*keys, F.inline(_facts(section, facts))).select(*keys, "section", "ordinal", "key", "value")


def _facts(section: Column, facts: dict[str, Column]) -> Column:
    return F.array(*[F.struct(section.alias("section"), F.lit(i).alias("ordinal"), F.lit(k).alias("key"), v.cast("string").alias("value")) for i, (k, v) in enumerate(facts.items())])


def trial_facts(trials: DataFrame) -> DataFrame:
    """(trial_id, section, ordinal, key, value): summary, pins that are set, the reference run, and each attempt."""
    key = ["trial_id"]
    final, model = F.col("final"), F.col("model")
    summary = {
        "model": F.concat_ws(" ", model["backend"], model["id"]), "item": F.concat_ws("/", F.col("bench_item.suite"), F.col("bench_item.item")), "direction": F.col("bench_item.direction"), "stage reached": final["stage_reached"],
        "alignment": final["alignment"], "score": final["score"], "corrections": final["corrections"], "end": final["end_reason"]["code"], "attempts": F.size("attempts"),
    }
    pins = F.filter(_facts(F.lit("pins"), {p: F.col("toolchain_pins")[p] for p in PINS}), lambda x: x["value"].isNotNull())
    once = F.concat(_facts(F.lit("summary"), summary), pins, _facts(F.lit("reference run"), {f: F.col("reference_run")[f] for f in RUN_FACTS}))
    out = trials.select("trial_id", F.inline(once)).select("trial_id", "section", "ordinal", "key", "value")
    a = items(trials, "attempts", "a", "trial_id")
    of = {"stage reached": F.col("a.stage_reached"), "diagnostics": F.size("a.diagnostics"), **{f: F.col("a.run")[f] for f in RUN_FACTS}, "alignment": F.col("a.alignment.mean"), "score": F.col("a.score.scalar")}
    return out.unionByName(_stacked(a, key, F.concat(F.lit("attempt "), F.col("a.index").cast("string")), of))


def shown_messages(trials: DataFrame) -> DataFrame:
    """(trial_id, request, ordinal, role, sha256, first): each message of each request; ``first`` where its text is shown."""
    of = lambda r: F.transform(r["messages"], lambda m, i: F.struct(r["index"].alias("request"), i.alias("ordinal"), m["role"].alias("role"), m["ref"]["sha256"].alias("sha256")))
    every = F.flatten(F.filter(F.transform("requests", of), lambda ms: ms.isNotNull()))
    # In their order, so that the first of each text is where its hash is found first: all within the trial's own row.
    m = trials.select("trial_id", F.sort_array(every).alias("ms")).select("trial_id", "ms", F.transform("ms", lambda m: m["sha256"]).alias("__all"))
    m = items(m, "ms", "m", "trial_id", "__all", at="__n")
    first = F.coalesce(F.array_position("__all", F.col("m.sha256")) == F.col("__n") + 1, F.lit(False))
    return m.select("trial_id", "m.request", "m.ordinal", "m.role", "m.sha256", first.alias("first"))


def missing_flags(trials: DataFrame) -> DataFrame:
    """(trial_id, flag, missing): how many runs of a trial have no value of a flag; flags that all runs have give no row."""
    run = F.explode(F.concat(F.array("reference_run"), F.transform("attempts", lambda a: a["run"])))
    runs = trials.select("trial_id", run.alias("r"))
    wide = runs.groupBy("trial_id").agg(*[F.count_if(F.col("r")[f].isNull()).alias(f) for f in RUN_FLAGS])
    rows = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("missing")) for f in RUN_FLAGS])
    return wide.select("trial_id", F.inline(rows)).where("missing > 0")


def pages(facts: DataFrame) -> DataFrame:
    """(trial_id, page): the facts as Markdown, a table for each section; bars are escaped, one line a fact."""
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("-")), r"\|", r"\\|"), r"\s+", " "))
    line = F.concat(F.lit("| "), text(F.col("key")), F.lit(" | "), text(F.col("value")), F.lit(" |"))
    order = F.when(F.col("section") == "summary", 0).when(F.col("section") == "pins", 1).when(F.col("section") == "reference run", 2).otherwise(3 + F.substring("section", 9, 18).try_cast("int"))
    part = facts.groupBy("trial_id", "section", order.alias("place")).agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("ls"))
    part = part.withColumn("text", F.concat_ws("\n", F.concat(F.lit("## "), F.initcap("section")), F.lit(""), F.lit("| Fact | Value |"), F.lit("| --- | --- |"), F.col("ls.line"), F.lit("")))
    whole = part.groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("ps"))
    return whole.select("trial_id", F.concat(F.lit("# "), "trial_id", F.lit("\n\n"), F.concat_ws("\n", F.col("ps.text"))).alias("page"))
