"""Queries that run the library's operators over nested trial records.

Orders with their lineitems are made into records of the schema in ``sources.schema``: a lineitem is an attempt, its
flags its stage and run, its numbers its warnings, alignment and guards. The SQL beside each query starts from the flat
tables, so it knows nothing of the record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions import exact, ids, stats, text
from trialweave.operators import attempts, compare, facts, flatten, lists, metrics, parsers, recordings, scoring, simulator, store, tasks, text_tables
from trialweave.queries import ORACLE_SQL, QUERIES, query, rounded, table
from trialweave.sources import generator
from trialweave.sources.schema import TRIAL, filled

#: The attempts of all orders: index i of n, stage, guard, whether the output was kept, first diagnostic's severity.
_A = """a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n,
CASE WHEN l_linestatus = 'F' THEN 'S5' WHEN l_returnflag = 'R' THEN 'S1' ELSE 'S4' END AS stage, (l_returnflag = 'R' AND l_discount > 0.08) AS broken, l_returnflag <> 'N' AS kept, (l_linestatus <> 'F') AS failed, (l_partkey % 4) AS w,
CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_tax * 10 END AS mean, 'suite/arm' || (l_orderkey % 3) || '/bench/a-to-b/item' || (l_orderkey % 5) || '/run' || CASE WHEN l_orderkey < 100 THEN lpad(l_orderkey::VARCHAR, 2, '0') ELSE l_orderkey::VARCHAR END AS trial_id FROM lineitem)"""


def trial_id(key: Column) -> Column:
    return ids.make(F.lit("suite"), F.concat(F.lit("arm"), F.pmod(key, F.lit(3)).cast("string")), F.lit("bench"), F.lit("a-to-b"), F.concat(F.lit("item"), F.pmod(key, F.lit(5)).cast("string")), key)


def trials(spark: SparkSession, d: str) -> DataFrame:
    """One nested record for each order that has lineitems; each column by itself, so that unused ones are not made."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    every = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("ls"))
    key = F.col("l_orderkey")
    cells = {
        "trial_id": trial_id(key), "recipe_hash": F.sha2(key.cast("string"), 256),
        "final": {"corrections": F.size("ls") - 1, "end_reason": {"code": F.when(F.pmod(key, F.lit(7)) == 0, "sim-gap").when(F.pmod(key, F.lit(7)) == 1, "correction-cap")}},
        "reference_run": {"exit_code": F.lit(0), "hang": F.lit(False), "stdout_truncated": F.pmod(key, F.lit(4)) == 0, "stdout_ref": {"sha256": F.sha2(F.lit("r"), 256)}},
        "provenance": {"device": F.when(F.pmod(key, F.lit(2)) == 0, "host")},
        "baseline_diagnostics": [{"stage": F.lit("compile"), "severity": F.lit("note"), "message": F.lit("base")}],
        "requests": F.transform("ls", _request), "attempts": F.transform("ls", _attempt),
    }
    return every.select(*[(filled(f.dataType, cells[f.name]) if f.name in cells else F.lit(None).cast(f.dataType)).alias(f.name) for f in TRIAL.fields])


def _request(x: Column, i: Column) -> Column:
    ref = lambda role, of: {"role": F.lit(role), "ref": {"sha256": F.sha2(of.cast("string"), 256)}}
    return filled(TRIAL["requests"].dataType.elementType, {"index": i, "stage": F.lit("compile"), "attempt_index": i, "messages": [ref("system", x["l_returnflag"]), ref("user", x["l_partkey"])]})


def _attempt(x: Column, i: Column) -> Column:
    want = TRIAL["attempts"].dataType.elementType
    failed, kept = x["l_linestatus"] != "F", x["l_returnflag"] != "N"
    stage = F.when(~failed, "S5").when(x["l_returnflag"] == "R", "S1").otherwise("S4")
    # The warnings of all lineitems are among the same four.
    warnings = filled(want["diagnostics"].dataType, [{"stage": F.lit("compile"), "severity": F.lit("warning"), "code": F.lit("w"), "file": F.lit("f.cu"), "line": F.lit(j % 3), "message": F.lit(f"m{j}")} for j in range(4)])
    error = {"stage": F.lit("run"), "severity": F.lit("error"), "code": F.lit("run-error"), "message": F.lit("failed")}
    note = {"stage": F.lit("run"), "severity": F.lit("note"), "code": F.lit("watcher"), "message": F.concat(F.lit("core "), x["l_suppkey"].cast("string"))}
    shown = F.slice(warnings, F.lit(1), F.pmod(x["l_partkey"], F.lit(4)).cast("int") + 1)
    found = F.when(failed, F.concat(shown, filled(want["diagnostics"].dataType, [error, note]))).otherwise(shown)
    number, run = x["l_linenumber"].cast("string"), want["run"].dataType
    return filled(want, {
        "index": i, "stage_reached": stage, "diagnostics": found, "files": F.create_map(F.concat(F.lit("f"), number, F.lit(".cu")), x["l_returnflag"]),
        "run": {
            "exit_code": F.when(failed, 1).otherwise(0), "hang": failed & (F.pmod(x["l_partkey"], F.lit(5)) == 0), "sim_ub": F.pmod(x["l_partkey"], F.lit(6)) == 0, "stdout_ref": F.when(kept, filled(run["stdout_ref"].dataType, {"sha256": F.lit("s")})),
            "stdout_truncated": F.pmod(x["l_suppkey"], F.lit(2)) == 0, "workdir_incomplete": F.pmod(x["l_suppkey"], F.lit(5)) == 0,
        },
        "alignment": {"per_input": F.array(x["l_tax"]), "mean": F.when(F.pmod(x["l_suppkey"], F.lit(3)) != 0, x["l_tax"] * 10), "outputs": [{"name": F.concat(F.lit("o"), number), "pcc": x["l_tax"], "max_abs": x["l_discount"], "passed": ~failed}]},
        "guards": {"host_compute": (x["l_returnflag"] == "R") & (x["l_discount"] > 0.08), "harness_tamper": F.lit(False), "oracle_access": F.lit(False)},
    })


@query(f"""WITH {_A} SELECT trial_id, 'suite' AS project, 'arm' || (l_orderkey % 3) AS arm, 'bench' AS bench, 'a-to-b' AS direction, 'item' || (l_orderkey % 5) AS item, l_orderkey AS run, sha256(l_orderkey::VARCHAR) AS recipe_hash,
CASE WHEN l_orderkey % 2 = 0 THEN 'host' END AS provenance_device, 0::BIGINT AS reference_run_exit_code, l_orderkey % 4 = 0 AS reference_run_stdout_truncated, (n - 1) AS final_corrections,
CASE l_orderkey % 7 WHEN 0 THEN 'sim-gap' WHEN 1 THEN 'correction-cap' END AS final_end_reason_code, n AS attempt_count FROM a WHERE i = 0""")
def flat_trials(spark, d):
    cols = "trial_id project arm bench direction item run recipe_hash provenance_device reference_run_exit_code reference_run_stdout_truncated final_corrections final_end_reason_code attempt_count"
    return flatten.flat_tables(trials(spark, d))["trials"].select(*cols.split())


@query(f"""WITH {_A} SELECT trial_id, i AS index, '{{"f' || l_linenumber || '.cu":"' || l_returnflag || '"}}' AS files, stage AS stage_reached, (w + 1 + CASE WHEN failed THEN 2 ELSE 0 END) AS diagnostic_count, CASE WHEN failed THEN 1::BIGINT ELSE 0 END AS run_exit_code,
CASE WHEN kept THEN 's' END AS run_stdout_ref_sha256, mean AS alignment_mean, broken AS guards_host_compute FROM a""")
def flat_attempts(spark, d):
    return flatten.flat_tables(trials(spark, d))["attempts"].select("trial_id", "index", "files", "stage_reached", "diagnostic_count", "run_exit_code", "run_stdout_ref_sha256", "alignment_mean", "guards_host_compute")


@query(f"""WITH {_A} SELECT trial_id, NULL::BIGINT AS attempt_index, 0::BIGINT AS ordinal, 'compile' AS stage, 'note' AS severity, NULL AS code, NULL::BIGINT AS line, 'base' AS message FROM a WHERE i = 0
UNION ALL SELECT trial_id, i, j, 'compile', 'warning', 'w', j % 3, 'm' || j FROM (SELECT *, unnest(range(w + 1)) AS j FROM a) UNION ALL SELECT trial_id, i, w + 1, 'run', 'error', 'run-error', NULL, 'failed' FROM a WHERE failed
UNION ALL SELECT trial_id, i, w + 2, 'run', 'note', 'watcher', NULL, 'core ' || l_suppkey FROM a WHERE failed""")
def flat_diagnostics(spark, d):
    return flatten.flat_tables(trials(spark, d))["diagnostics"].select("trial_id", "attempt_index", "ordinal", "stage", "severity", "code", "line", "message")


@query(f"""WITH {_A} SELECT trial_id, i AS index, 'compile' AS stage, i AS attempt_index, 'system,user' AS roles, sha256(l_returnflag) || ',' || sha256(l_partkey::VARCHAR) AS hashes FROM a""")
def flat_requests(spark, d):
    r = flatten.flat_tables(trials(spark, d))["requests"]
    return r.select("trial_id", "index", "stage", "attempt_index", F.concat_ws(",", "message_roles").alias("roles"), F.concat_ws(",", "message_sha256").alias("hashes"))


@query(f"WITH {_A} SELECT trial_id, i AS attempt_index, 0::BIGINT AS ordinal, 'o' || l_linenumber AS name, l_tax AS pcc, l_discount AS max_abs, NOT failed AS passed FROM a")
def flat_output_stats(spark, d):
    return flatten.flat_tables(trials(spark, d))["output_stats"].select("trial_id", "attempt_index", "ordinal", "name", "pcc", "max_abs", "passed")


@query(f"WITH {_A} SELECT trial_id, 'unknown stage' AS problem FROM a WHERE i = 0 AND l_orderkey % 10 = 3 UNION ALL SELECT trial_id, 'attempt indices are not 0..n-1' FROM a WHERE i = 0 AND l_orderkey % 10 = 4 AND n > 1")
def record_violations(spark, d):
    """Records with a stage or an order of attempts that is against the rules (a single attempt stays in order)."""
    run = F.col("trial_id").substr(F.lit(-1), F.lit(1))
    broken = F.when(run == "3", F.transform("attempts", lambda a: a.withField("stage_reached", F.lit("S9")))).when(run == "4", F.reverse("attempts")).otherwise(F.col("attempts"))
    return flatten.violations(trials(spark, d).withColumn("requests", F.lit(None).cast(TRIAL["requests"].dataType)).withColumn("attempts", broken))


_R = """r AS (SELECT *, least(w + 1, 3) * (stage IN ('S4', 'S5'))::INT AS warnings, CASE WHEN broken THEN -1.0 ELSE CASE stage WHEN 'S1' THEN -0.8 WHEN 'S4' THEN 0.0 ELSE 0.2 END - 0.02 * least(least(w + 1, 3) * (stage IN ('S4', 'S5'))::INT, 10)
+ CASE WHEN stage = 'S5' AND mean IS NOT NULL THEN 0.8 * mean ELSE 0.0 END END AS raw FROM a), g AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 AND i = n - 1 AND NOT broken THEN NULL ELSE raw END AS r FROM r)"""


@query(f"WITH {_A}, {_R} SELECT trial_id, i AS attempt_index, round(r, 9) AS r, broken::INT::DOUBLE AS guard, warnings::DOUBLE AS warning_count FROM g")
def attempt_rewards(spark, d):
    s = scoring.attempt_scores(trials(spark, d))
    return rounded(s.select("trial_id", "attempt_index", "r", "guard", F.col("components")["warning_count"].alias("warning_count")), "r")


@query(f"""WITH {_A}, {_R} SELECT trial_id, round(max(r) FILTER (WHERE i = 0), 9) AS single_turn, round(CASE WHEN bool_or(broken) THEN -1.0 ELSE max(r) FILTER (WHERE i = n - 1) END - 0.05 * (any_value(n) - 1), 9) AS multi_turn FROM g GROUP BY trial_id""")
def trial_rewards(spark, d):
    return rounded(scoring.trial_scores(trials(spark, d)), "single_turn", "multi_turn")


_O = """s AS (SELECT trial_id, max(i) AS at FROM a WHERE kept GROUP BY 1), o AS (SELECT l.trial_id, l.l_orderkey, l.n, l.stage AS last_stage, a.i, a.stage, a.mean, (a.stage IN ('S4', 'S5') AND NOT a.failed AND a.l_partkey % 6 <> 0) AS clean FROM a l LEFT JOIN s USING (trial_id) LEFT JOIN a ON a.trial_id = l.trial_id AND a.i = s.at WHERE l.i = l.n - 1),
c AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN i IS NULL THEN 0.0 WHEN NOT clean THEN 0.0 WHEN mean IS NULL THEN NULL WHEN mean = 1.0 THEN 1.0 ELSE 0.0 END::DOUBLE AS correct FROM o)"""


@query(f"""WITH {_A}, {_O} SELECT trial_id, correct, CASE WHEN correct IS NOT NULL THEN (correct = 1.0 AND n = 1)::INT::DOUBLE END AS first_try, (n - 1)::DOUBLE AS self_corr, (l_orderkey % 7 = 1)::INT::DOUBLE AS cap_hit, 0.0::DOUBLE AS fence_quirk,
(last_stage IN ('S4', 'S5'))::INT::DOUBLE AS compiled, (last_stage IN ('S4', 'S5') AND n = 1)::INT::DOUBLE AS compiled_first_try FROM c""")
def trial_outcomes(spark, d):
    names = ("correct", "first_try", "self_corr", "cap_hit", "fence_quirk", "compiled", "compiled_first_try")
    return scoring.outcomes(trials(spark, d)).select("trial_id", *[F.col(f"{n}.value").alias(n) for n in names])


@query(f"""WITH {_A}, {_R}, {_O}, t AS (SELECT trial_id, round(max(r) FILTER (WHERE i = 0), 9) AS s, round(CASE WHEN bool_or(broken) THEN -1.0 ELSE max(r) FILTER (WHERE i = n - 1) END - 0.05 * (any_value(n) - 1), 9) AS m FROM g GROUP BY 1)
SELECT trial_id, 'reward' AS profile, 'single_turn' AS component, s AS value, 0 AS ordinal FROM t UNION ALL SELECT trial_id, 'reward', 'multi_turn', m, 1 FROM t UNION ALL SELECT trial_id, 'reward', 'scalar', m, 2 FROM t
UNION ALL SELECT trial_id, 'outcome', 'correct', correct, 0 FROM c UNION ALL SELECT trial_id, 'outcome', 'scalar', correct, 13 FROM c""")
def profile_scores(spark, d):
    """Both profiles in long form; of the outcomes, the component that is the scalar too."""
    s = rounded(scoring.score_trials(trials(spark, d), ["reward", "outcome"]), "value")
    return s.where("profile = 'reward' or component in ('correct', 'scalar')").select("trial_id", "profile", "component", "value", "ordinal")


@query(f"WITH {_A}, {_R}, t AS (SELECT trial_id, round(CASE WHEN bool_or(broken) THEN -1.0 ELSE max(r) FILTER (WHERE i = n - 1) END - 0.05 * (any_value(n) - 1), 9) AS m FROM g GROUP BY 1) SELECT trial_id, g.i AS index, round(g.r, 9) AS scalar, t.m AS score FROM g JOIN t USING (trial_id)")
def applied_scores(spark, d):
    s = flatten.items(scoring.apply_scores(trials(spark, d)), "attempts", "a", "trial_id", F.col("final.score").alias("score"))
    return rounded(s.select("trial_id", F.col("a.index").alias("index"), F.col("a.score.scalar").alias("scalar"), "score"), "scalar", "score")


@query(f"""WITH {_A}, {_O}, m AS (SELECT 'arm' || (l_orderkey % 3) AS arm, 'a-to-b' AS direction, 'bench/item' || (l_orderkey % 5) AS scenario, last_stage, correct, n, l_orderkey FROM c),
w AS (SELECT arm, direction, count(*) AS t, count(*) FILTER (WHERE correct = 1) AS ok, count(correct) AS known, count(*) FILTER (WHERE last_stage IN ('S4', 'S5')) AS compiled, count(*) FILTER (WHERE last_stage = 'S5') AS clean, count(*) FILTER (WHERE l_orderkey % 7 = 1) AS caps, count(*) FILTER (WHERE correct = 1 AND n = 1) AS firsts FROM m GROUP BY 1, 2),
p AS (SELECT arm, direction, sum(c1) FILTER (WHERE k > 0) AS p1, count(*) FILTER (WHERE k > 0) AS den FROM (SELECT arm, direction, scenario, count(correct) AS k, count(*) FILTER (WHERE correct = 1)::DOUBLE / nullif(count(correct), 0) AS c1 FROM m GROUP BY ALL) GROUP BY 1, 2),
x AS (SELECT *, w.t - known AS unknown FROM w JOIN p USING (arm, direction))
SELECT arm, direction, 0::BIGINT AS ordinal, 'compile_rate' AS metric, compiled::DOUBLE AS numerator, t AS denominator, 0 AS excluded FROM x UNION ALL SELECT arm, direction, 1, 'run_rate', clean, t, 0 FROM x UNION ALL SELECT arm, direction, 2, 'correct_rate', CASE WHEN known > 0 THEN ok END, nullif(known, 0), unknown FROM x
UNION ALL SELECT arm, direction, 3, 'cap_hit_rate', caps, t, 0 FROM x UNION ALL SELECT arm, direction, 4, 'fence_quirk_rate', 0, t, 0 FROM x UNION ALL SELECT arm, direction, 5, 'first_try_rate', CASE WHEN ok > 0 THEN firsts END, nullif(ok, 0), 0 FROM x
UNION ALL SELECT arm, direction, 6, 'sim_t_ge_0.6_rate', NULL, NULL, ok FROM x UNION ALL SELECT arm, direction, 7, 'sim_t_tiktoken_ge_0.6_rate', NULL, NULL, ok FROM x UNION ALL SELECT arm, direction, 8, 'within_10pct_rate', NULL, NULL, NULL FROM x
UNION ALL SELECT arm, direction, 9, 'pass@1', round(p1, 9), den, unknown FROM x""")
def trial_metrics(spark, d):
    """From nested records to metrics: scores, components side by side, all rows of the table but pass@3."""
    rows = metrics.metric_rows(metrics.scored_trials(trials(spark, d)))
    return rounded(rows.where("ordinal < 10").select("arm", "direction", "ordinal", "metric", "numerator", "denominator", "excluded"), "numerator")


@query(f"WITH {_A}, {_O} SELECT trial_id, last_stage AS stage_reached, o.mean AS alignment, (o.n - 1) AS corrections FROM o")
def final_records(spark, d):
    return trials(spark, d).select("trial_id", attempts.final_record().alias("f")).select("trial_id", "f.*")


@query(f"""WITH {_A} SELECT trial_id, i AS index, CASE WHEN failed AND l_partkey % 5 = 0 THEN 'the program was stopped at its wall limit of 30.5 s' ELSE 'the program exited with status ' || CASE WHEN failed THEN 1 ELSE 0 END END
|| CASE WHEN l_partkey % 6 = 0 THEN '; the simulator reported undefined behavior' ELSE '' END || CASE WHEN failed AND l_partkey % 5 = 0 THEN '; a hang on a simulator most likely means a deadlock: a circular buffer or a semaphore that a core waits on and that is never filled or signalled; core ' || l_suppkey ELSE '' END AS status,
concat_ws(',', CASE WHEN l_suppkey % 2 = 0 THEN 'stdout-truncated' END, CASE WHEN l_suppkey % 5 = 0 THEN 'workdir-incomplete' END) AS flags, stage || CASE WHEN failed THEN '; run error: failed' ELSE '' END AS shown, failed AND stage <> 'S4' AS needs_correction, stage = 'S1' AND NOT failed AS buildable, (w + 1 + CASE WHEN failed THEN 2 ELSE 0 END) AS in_prompt FROM a""")
def attempt_reports(spark, d):
    """What is said of each attempt: how its run ended, the warnings of its flags, its status text, the loop's predicates."""
    a = flatten.items(trials(spark, d), "attempts", "a", "trial_id")
    x = F.col("a")
    return a.select(
        "trial_id", F.col("a.index").alias("index"), attempts.run_status(x["run"], x["diagnostics"], F.lit(30.5), True).alias("status"), F.concat_ws(",", F.transform(attempts.flag_warnings(x["run"]), lambda w: w["code"])).alias("flags"),
        attempts.status_text(x).alias("shown"), attempts.needs_correction(x).alias("needs_correction"), attempts.buildable(x).alias("buildable"), F.size(attempts.prompt_diagnostics(x["diagnostics"])).cast("long").alias("in_prompt"),
    )


@query(f"WITH {_A} SELECT trial_id, i AS index, 'reference-stdout-truncated' AS code FROM a WHERE l_orderkey % 4 = 0 AND kept")
def unaligned(spark, d):
    return attempts.unaligned_warnings(trials(spark, d)).select("trial_id", "index", "code")


@query(f"WITH {_A} SELECT trial_id, CASE WHEN max(i) FILTER (WHERE kept) IS NULL THEN 'upstream-crash' ELSE 'stale-output' END AS code, max(i) FILTER (WHERE kept) AS standing FROM a GROUP BY trial_id HAVING max(n) > 1 AND bool_or(i = n - 1 AND stage = 'S4' AND NOT kept)")
def stale_outputs(spark, d):
    """As if each order's attempts stood past the gate: indices are moved up by seven, so those of one attempt stay below."""
    moved = F.transform("attempts", lambda a: a.withField("index", a["index"] + 7))
    return attempts.past_gate(trials(spark, d).withColumn("attempts", moved)).select("trial_id", "code", (F.col("standing") - 7).alias("standing"))


@query("SELECT o_orderkey, (o_custkey % 6 IN (0, 1, 2, 3)) AND o_totalprice >= 100000 AS hang, o_custkey % 6 = 1 AND o_totalprice < 100000 AS killed FROM orders")
def exit_classes(spark, d):
    code = F.get(F.array(*[F.lit(c) for c in (124, 137, 143, -1, 0, 139)]), F.pmod("o_custkey", F.lit(6)).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", attempts.classify_exit(code, F.col("o_totalprice"), F.lit(100000)).alias("x")).select("o_orderkey", "x.*")


@query("""WITH x AS (SELECT l_orderkey, CASE WHEN l_tax = 0.03 THEN NULL ELSE l_tax END::DOUBLE AS v FROM lineitem)
SELECT l_orderkey, CASE WHEN count(v) = count(*) THEN sum((v * 1152921504606846976)::HUGEINT)::BIGINT::DOUBLE / 1152921504606846976 / count(*) END AS mean FROM x GROUP BY 1""")
def alignment_means(spark, d):
    """Means by exact sums, not rounded: in SQL all values are whole multiples of 2**-60, and are added up as such."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_tax") != 0.03, F.col("l_tax")).alias("v"))
    return attempts.alignment_means(li, ["l_orderkey"], "v")


@query("""WITH m AS (SELECT *, l_extendedprice - sx AS dx, l_quantity - sy AS dy FROM lineitem JOIN (SELECT l_returnflag, avg(l_extendedprice) AS sx, avg(l_quantity) AS sy FROM lineitem GROUP BY 1) USING (l_returnflag)) SELECT l_returnflag, round(sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)), 12) AS pcc FROM m GROUP BY 1""")
def exact_correlations(spark, d):
    """The correlation of price and quantity in each group of lineitems, by exact sums of deviations (SQL rounds its own)."""
    got = exact.correlations(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return got.select("l_returnflag", F.round("pcc", 12).alias("pcc"))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity * 2 AS runtime, greatest(30.0, 10 * p.p_size / 10.0) AS time_limit FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_quantity * 2 > greatest(30.0, 10 * p.p_size / 10.0)")
def over_limit(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("app"), (F.col("l_quantity") * 2).alias("runtime"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("app"), (F.col("p_size") / 10).alias("reference"))
    return attempts.over_limit(r, p, ["app"]).select("l_orderkey", "l_linenumber", "runtime", "time_limit")


def _le(value: Column) -> Column:
    """A 32-bit integer's bytes, least first, in hexadecimal."""
    h = F.lpad(F.hex(value.cast("long")), 8, "0")
    return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS name, [o_orderkey % 1000, o_custkey % 1000, 7] AS v FROM orders WHERE o_orderkey % 5 <> 0), c AS (SELECT o_custkey AS k, o_orderkey AS name, [o_orderkey % 1000, o_custkey % 1000 + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END, 7] AS v FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(r.k, c.k) AS o_custkey, coalesce(r.name, c.name)::VARCHAR AS name, CASE WHEN r.k IS NOT NULL AND c.k IS NOT NULL THEN CASE WHEN r.v = c.v THEN 0.0 ELSE 2.0 END END::DOUBLE AS max_abs, coalesce(r.v = c.v, FALSE) AS passed,
CASE WHEN c.k IS NULL THEN 'missing in the candidate' WHEN r.k IS NULL THEN 'not in the reference' WHEN r.v <> c.v THEN '1 elements differ, the first at 1' END AS note FROM r FULL JOIN c ON r.k = c.k AND r.name = c.name""")
def compared_outputs(spark, d):
    """Integer arrays of a reference and a candidate that each lack some and differ in some."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders")

    def arrays(keep, more):
        data = F.unhex(F.concat(_le(key % 1000), _le(cust % 1000 + more), _le(F.lit(7))))
        return o.where(keep).select("o_custkey", key.cast("string").alias("name"), F.lit("p").alias("path"), F.lit("i32").alias("dtype"), F.array(F.lit(3).cast("long")).alias("shape"), data.alias("data"))

    none = spark.range(0).select(F.lit("").alias("name"), F.lit("").alias("metric"), F.lit(0.0).alias("threshold"))
    got = compare.compare_outputs(arrays(key % 5 != 0, F.lit(0)), arrays(key % 7 != 0, F.when(key % 3 == 0, 2).otherwise(0)), none, ["o_custkey"])
    return got.select("o_custkey", "name", "max_abs", "passed", "note")


@query("""SELECT l_orderkey, i AS ordinal, CASE WHEN l_quantity > 25 THEN 'error' ELSE 'warning' END AS severity, l_returnflag || '-D' AS code, 'f' || l_linenumber || '.cu' AS file, l_linenumber::BIGINT AS line, CASE WHEN l_linestatus = 'F' THEN 3::BIGINT END AS at, 'text ' || l_partkey || CASE WHEN l_linestatus = 'F' THEN '; more: x' ELSE '' END AS message
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM (SELECT * REPLACE (CASE l_returnflag WHEN 'N' THEN '1' WHEN 'R' THEN '2' ELSE '3' END AS l_returnflag) FROM lineitem))""")
def compiler_logs(spark, d):
    """Each order's lineitems as one compiler's log with continuation lines, echoes and carets, read back."""
    code = F.when(F.col("l_returnflag") == "N", "1").when(F.col("l_returnflag") == "R", "2").otherwise("3")
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit(".cu"))
    line = F.concat(name, F.lit("("), F.col("l_linenumber").cast("string"), F.lit("): "), F.when(F.col("l_quantity") > 25, "error").otherwise("warning"), F.lit(" #"), code, F.lit("-D: text "), F.col("l_partkey").cast("string"))
    told = F.concat(line, F.when(F.col("l_linestatus") == "F", "\n          more: x\n    a b c\n      ^\n").otherwise("\n\nno diagnostic\n"))
    source = F.concat(F.repeat(F.lit("\n"), (F.col("l_suppkey") - 1).cast("int")), F.lit("a b c"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    logs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), told.alias("t")))), lambda x: x["t"])).alias("stderr"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct(name.alias("f"), F.lit("a b c").alias("s"))))).alias("files"),
    )
    logs = logs.withColumn("files", F.transform_values("files", lambda _, s: F.concat_ws("\n", F.array_repeat(s, 8))))
    got = parsers.diagnostics(logs, "nvcc", ["l_orderkey"], files="files")
    return got.select("l_orderkey", "ordinal", "severity", "code", "file", "line", F.col("column").alias("at"), "message")


@query("SELECT s_suppkey, 'Watcher dump #' || s_suppkey || ': ' || CASE WHEN s_nationkey = 0 THEN 'no core held a kernel' ELSE 'Device core(1) k_ids: 0| ' || s_nationkey || '| 0; k_id[ ' || s_nationkey || ']: kernels/' || s_name END AS note FROM supplier WHERE s_suppkey % 4 <> 0")
def watchdog_notes(spark, d):
    """A log of a whole dump for each supplier and an open one after it; every fourth log's number does not match."""
    s = table(spark, d, "supplier")
    n, key = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    end = F.when(F.col("s_suppkey") % 4 == 0, F.concat(key, F.lit("1"))).otherwise(key)
    log = F.concat(F.lit("start\nDump #"), key, F.lit(" at 1s\nDevice core(1) k_ids: 0| "), n, F.lit("| 0\nk_id[ "), n, F.lit("]: kernels/"), "s_name", F.lit("\nk_id[ 99]: other\nDump #"), end, F.lit(" completed at 2s\nDump #1 at 3s\nDevice core(2) k_ids: 5\n"))
    return simulator.watchdog_notes(s.select("s_suppkey", log.alias("log")), ["s_suppkey"])


@query("SELECT nullif(s_suppkey, 1) AS s_suppkey, 0::BIGINT AS ordinal, 'error' AS severity, CASE s_nationkey % 3 WHEN 2 THEN '/v/../k' ELSE 'k' END || s_nationkey || '.cpp' AS file, (s_nationkey + 1)::BIGINT AS line, 'bad ' || s_name || ' ?' AS message FROM supplier")
def kernel_logs(spark, d):
    """A kernel's build log in both streams, with a line of another program after it; paths need folding, one key is null."""
    n = F.col("s_nationkey")
    inside = F.when(n % 3 == 0, "/w//k").when(n % 3 == 1, "/w/x/./../k").otherwise("/v/../k")
    log = F.concat(F.lit("out\nbrisc build failed. Log: In file\n"), inside, n.cast("string"), F.lit(".cpp:"), (n + 1).cast("string"), F.lit(":0: error: bad "), "s_name", F.lit(" é\n  3 | x:1:2: error: echo\n\nz.cpp:1:1: error: outside\n"))
    logs = table(spark, d, "supplier").select(F.nullif("s_suppkey", F.lit(1)).alias("s_suppkey"), log.alias("stdout"), log.alias("stderr"), F.lit("/w").alias("dir"))
    return simulator.kernel_diagnostics(logs, ["s_suppkey"], workdir="dir").select("s_suppkey", "ordinal", "severity", "file", "line", "message")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n, p_name AS m, p_size % 2 = 0 AS even FROM part)
SELECT k, 'g++' AS tool, 0::BIGINT AS ordinal, CASE WHEN even THEN 'error' ELSE 'warning' END AS severity, CASE WHEN even THEN NULL ELSE '-Wx' END AS code, 'a.cpp' AS file, n::BIGINT AS line, CASE WHEN n > 1 THEN (n - 1)::BIGINT END AS at, m AS message FROM p
UNION ALL SELECT k, 'g++', 1, 'error', NULL, CASE WHEN n <= 3 THEN 'src/b.cpp' END, CASE WHEN n <= 3 THEN n::BIGINT END, NULL, 'undefined reference to `' || m || chr(39) FROM p
UNION ALL SELECT k, 'g++', 2, 'error', NULL, NULL, NULL, NULL, 'ld returned 1 exit status' FROM p UNION ALL SELECT k, 'g++', 3, 'error', NULL, NULL, NULL, NULL, 'no input files' FROM p
UNION ALL SELECT k, 'nvc++', 0, 'error', 'no_such', 'n.cpp', 1, CASE WHEN even THEN 5 END, m FROM p UNION ALL SELECT k, 'nvc++', 1, CASE WHEN even THEN 'error' ELSE 'warning' END, CASE WHEN even THEN 'S' ELSE 'W' END || '-' || n, 'm.cpp', n, NULL, m FROM p
UNION ALL SELECT k, 'nvc++', 2, 'warning', 'W-0155', CASE WHEN even THEN 'n.cpp' END, NULL, NULL, m || CASE WHEN even THEN '' ELSE ' (other.cpp)' END FROM p UNION ALL SELECT k, 'nvc++', 3, 'error', NULL, NULL, NULL, NULL, 'lost ' || m FROM p
UNION ALL SELECT k, 'clang', 0, 'note', NULL, 'k.cpp', n, 2, m FROM p UNION ALL SELECT k, 'clang', 1, 'error', NULL, NULL, NULL, NULL, 'undefined symbol: ' || m FROM p
UNION ALL SELECT k, 'nvcc', 0, 'error', NULL, NULL, NULL, NULL, 't.ptx, line ' || n || ': ' || m FROM p UNION ALL SELECT k, 'nvcc', 1, 'warning', '-Wodd', 'h.cu', n, NULL, m FROM p UNION ALL SELECT k, 'nvcc', 2, 'error', NULL, NULL, NULL, NULL, 'Value ' || m FROM p""")
def toolchain_logs(spark, d):
    """Each part's log from four toolchains: host and driver lines, the linker's, backend places with and without a line, carets.

    Parts go to all tasks by key before their logs are made, as a small file of them is read by one; lines then stay there.
    """
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), F.col("p_name").alias("m"), (F.col("p_size") % 2 == 0).alias("even")).repartition("k")
    n, m, even, column = F.col("n").cast("string"), F.col("m"), F.col("even"), (F.col("n") - 1).cast("string")
    text_of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    gcc = text_of("a.cpp:", n, ":", column, ": ", F.when(even, "fatal error").otherwise("warning"), ": ", m, F.when(even, "").otherwise(" [-Wx]"), "\n   16| int x:1:2: error: echoed\n/usr/bin/ld: /w/src/b.cpp:", n)
    gcc = text_of(gcc, ": undefined reference to `", m, "'\ncollect2: error: ld returned 1 exit status\ng++-13: fatal error: no input files\nnothing")
    backend = text_of("\nNVC++-", F.when(even, "S").otherwise("W"), "-", n, "-", m, "  (m.cpp: ", n, ")\nNVC++-W-0155-", m, F.when(even, " (n.cpp)").otherwise(" (other.cpp)"), "\nnvlink error   : lost ", m)
    logs = {
        "g++": (gcc, {"a.cpp": "x", "src/b.cpp": "1\n2\n3", "b.cpp": "1"}),
        "nvc++": (text_of('"n.cpp", line 1: error: ', m, " [no_such]\n  ", F.when(even, "ab cd").otherwise("other"), "\n      ^", backend), {"n.cpp": "ab cd\n"}),
        "clang": (text_of("./k.cpp:", n, ":2: note: ", m, "\nld.lld-18: error: undefined symbol: ", m, "\ncollect2: error: no"), {"k.cpp": "xy"}),
        "nvcc": (text_of("ptxas t.ptx, line ", n, "; error   : ", m, "\nptxas info    : nothing\nh.cu:", n, ":5: warning: ", m, " [-Wodd]\nnvcc fatal   : Value ", m), {"h.cu": "x"}),
    }
    out = []
    for tool, (log, files) in logs.items():
        built = F.create_map(*[F.lit(x) for pair in files.items() for x in pair])
        rows = parsers.diagnostics(p.select("k", log.alias("stderr"), built.alias("files")), tool, ["k"], files="files")
        out.append(rows.select("k", F.lit(tool).alias("tool"), "ordinal", "severity", "code", "file", "line", F.col("column").alias("at"), "message"))
    return reduce(DataFrame.unionByName, out)


@query("""SELECT p_partkey, 0::BIGINT AS ordinal, 'run' AS stage, 'error' AS severity, 'UndefinedBehavior' AS code, 'UndefinedBehavior: tt::r?ad: ' || p_name AS message FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, (p_size % 3 = 0)::BIGINT, 'run', 'error', 'SystemError', 'SystemError: g: a: b' FROM part WHERE p_size % 2 = 0""")
def finding_rows(spark, d):
    """A simulator's findings as a run's diagnostics, in printable ASCII."""
    ub = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("[12] ERROR: UndefinedBehavior: tt::réad: "), "p_name"))
    log = F.concat_ws("\n", F.lit("x"), ub, F.when(F.col("p_size") % 2 == 0, F.lit("t [9] ERROR: SystemError: g: a: b\r")), F.lit("[1] ERROR: NoMessage: x"))
    got = parsers.finding_diagnostics(table(spark, d, "part").select("p_partkey", log.alias("stdout")), ["p_partkey"])
    return got.select("p_partkey", "ordinal", "stage", "severity", "code", "message")


@query("""SELECT p_partkey, (p_size % 3 = 0) AS ub, CASE WHEN p_size % 2 = 0 THEN 'SystemError' END AS gap, concat_ws('|', CASE WHEN p_size % 3 = 0 THEN 'tt::read/' || p_name END, CASE WHEN p_size % 2 = 0 THEN 'g/a: b' END) AS said FROM part""")
def simulator_findings(spark, d):
    ub = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("[12] ERROR: UndefinedBehavior: tt::read: "), "p_name"))
    log = F.concat_ws("\n", F.lit("x"), ub, F.when(F.col("p_size") % 2 == 0, F.lit("t [9] ERROR: SystemError: g: a: b\r")), F.lit("[1] ERROR: NoMessage: x"))
    p = table(spark, d, "part").select("p_partkey", parsers.findings(log).alias("f"))
    return p.select("p_partkey", parsers.undefined_behaviour(F.col("f")).alias("ub"), parsers.first_gap(F.col("f")).alias("gap"), F.concat_ws("|", F.transform("f", lambda x: F.concat(x["function"], F.lit("/"), x["message"]))).alias("said"))


@query("""SELECT p_partkey, 'S' || CASE WHEN p_size % 4 <> 0 AND p_size % 5 <> 0 THEN 1 ELSE 0 END AS stage, CASE WHEN p_size % 5 = 0 THEN 'unclosed-block' WHEN p_size % 4 = 0 THEN 'bad-path' ELSE 'file' END AS kind, CASE WHEN p_size % 5 <> 0 AND p_size % 4 <> 0 THEN p_name || chr(10) END AS content FROM part""")
def reply_files(spark, d):
    """Replies with one block each: a file, one of a bad path, or one that never ends."""
    path = F.when(F.col("p_size") % 4 == 0, "../a.cu").otherwise("src//a.cu")
    reply = F.concat(F.lit("text\n```cuda\n// FILE: "), path, F.lit("\n"), "p_name", F.when(F.col("p_size") % 5 == 0, "\n").otherwise("\n```\n"))
    p = table(spark, d, "part").select("p_partkey", reply.alias("reply"))
    blocks = p.lateralJoin(parsers.FileBlocks(F.col("reply").outer(), F.array().cast("array<string>")))
    one = blocks.groupBy("p_partkey").agg(F.collect_list(F.when(F.col("kind") == "file", F.col("path"))).alias("files"), F.collect_list(F.when(F.col("kind") != "file", F.col("kind"))).alias("problems"), F.max("kind").alias("kind"), F.max("content").alias("content"))
    return one.select("p_partkey", attempts.reply_stage(F.col("files"), F.col("problems")).alias("stage"), "kind", "content")


@query("""WITH RECURSIVE spec AS (SELECT 's' || s_suppkey AS name, s_nationkey AS nation, (2147483648 + s_nationkey * 40000000)::UBIGINT AS span FROM supplier),
h AS (SELECT *, substr(sha256(name), 1, 16) AS x FROM spec), stream AS (SELECT *, (('0x' || x[15:16] || x[13:14] || x[11:12] || x[9:10] || x[7:8] || x[5:6] || x[3:4] || x[1:2])::UBIGINT::UHUGEINT * 2 + 1) % 18446744073709551616::UHUGEINT AS inc FROM h),
draw(name, span, inc, s, k) AS (SELECT name, span, inc, (((inc + 7) % 18446744073709551616::UHUGEINT) * 6364136223846793005::UHUGEINT + inc) % 18446744073709551616::UHUGEINT, 0 FROM stream
UNION ALL SELECT name, span, inc, (s * 6364136223846793005::UHUGEINT + inc) % 18446744073709551616::UHUGEINT, k + 1 FROM draw WHERE k < 63),
raw AS (SELECT *, ((xor((s::UBIGINT >> 18), s::UBIGINT) >> 27) & 4294967295::UBIGINT)::UBIGINT AS x, (s::UBIGINT >> 59)::INT AS r FROM draw),
u AS (SELECT *, CASE WHEN r = 0 THEN x ELSE ((x >> r) | ((x << (32 - r)) & 4294967295::UBIGINT)) END AS v FROM raw),
kept AS (SELECT name, v % span AS v, row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS i FROM u WHERE v >= 4294967296::UBIGINT % span)
SELECT name, i AS element, v::BIGINT AS value FROM kept WHERE i < 8 UNION ALL SELECT name, 8 + k, (x >> 8)::BIGINT FROM (SELECT name, k, v AS x FROM u WHERE k < 5)""")
def generated_inputs(spark, d):
    """Eight integers drawn by rejection and five floats (as their 24 bits) of each supplier's stream, in blocks of three."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_nationkey").alias("nation"))
    top = (F.lit(2147483648) + F.col("nation").cast("long") * 40000000).cast("string")
    spec = lambda dtype, dist, n, lo, hi: s.select("name", F.lit(dtype).alias("dtype"), F.array(F.lit(n).cast("long")).alias("shape"), F.lit(dist).alias("dist"), lo.alias("lo"), hi.alias("hi"))
    ints = generator.generate(spec("u32", "integers", 8, F.lit("0"), top), 7, block=3)
    floats = generator.generate(spec("f64", "uniform", 0, F.lit("0"), F.lit("1")).unionByName(spec("f32", "uniform", 5, F.lit("0"), F.lit("1"))), 7, block=3)
    at = lambda rows, width, shift: rows.select("name", (F.col("first") + shift).alias("first"), F.hex("data").alias("x"), F.posexplode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i", "_")).select("name", (F.col("first") + F.col("i")).alias("element"), F.substring("x", F.col("i") * 2 * width + 1, F.lit(2 * width)).alias("x"))
    turned = lambda x: F.concat(*[F.substring(x, k, 2) for k in (7, 5, 3, 1)])
    whole = at(ints, 4, 0).select("name", "element", F.conv(turned("x"), 16, 10).cast("long").alias("value"))
    bits = F.conv(turned("x"), 16, 10).cast("long")
    # A single-precision number in [0, 1) of 24 bits, as the integer that it is 2**-24 times.
    real = F.when(bits == 0, F.lit(0).cast("double")).otherwise((F.lit(1.0) + F.pmod(bits, F.lit(1 << 23)) / float(1 << 23)) * F.pow(F.lit(2.0), F.shiftright(bits, 23) - 127 + 24))
    return whole.unionByName(at(floats.where("n > 0"), 4, 8).select("name", "element", real.cast("long").alias("value")))


@query("""WITH m AS (SELECT conv_id, list({'role': coalesce(role, ''), 'content': coalesce(text, '')} ORDER BY turn) AS want FROM conversations GROUP BY 1),
s AS (SELECT *, CASE conv_id % 5 WHEN 1 THEN list_prepend({'role': 'other', 'content': want[1].content}, want[2:]) WHEN 2 THEN list_prepend({'role': want[1].role, 'content': want[1].content || 'x'}, want[2:]) WHEN 3 THEN want[:-2] ELSE want END AS sent FROM m)
SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'reply ' || conv_id END AS text, CASE WHEN conv_id % 5 = 0 THEN list_sum(list_transform(sent, lambda x: len(list_filter(regexp_split_to_array(x.content, '\\s+'), lambda w: w <> ''))))::BIGINT END AS prompt_tokens, CASE WHEN conv_id % 5 = 0 THEN 2::BIGINT END AS completion_tokens,
CASE conv_id % 5 WHEN 1 THEN 'message 1 has role ''other'', expected ''' || want[1].role || '''' WHEN 2 THEN 'message 1 (' || want[1].role || ') differs at character ' || length(want[1].content) || ' (length ' || (length(want[1].content) + 1) || ', expected ' || length(want[1].content) || ')'
WHEN 3 THEN len(sent) || ' message(s) sent, ' || len(want) || ' expected' WHEN 4 THEN 'the recording is used up' END AS problem FROM s""")
def replayed_requests(spark, d):
    """Each conversation as one request against a recording of it: equal, of another role, longer, too short, or not recorded."""
    c = table(spark, d, "conversations")
    one = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    m = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("m")))), lambda x: x["m"]).alias("want"))
    n = F.col("conv_id") % 5
    first, rest = F.col("want")[0], F.slice("want", F.lit(2), F.size("want"))
    role = F.array(F.struct(F.lit("other").alias("role"), first["content"].alias("content")))
    longer = F.array(F.struct(first["role"].alias("role"), F.concat(first["content"], F.lit("x")).alias("content")))
    sent = F.when(n == 1, F.concat(role, rest)).when(n == 2, F.concat(longer, rest)).when(n == 3, F.slice("want", F.lit(1), F.size("want") - 1)).otherwise(F.col("want"))
    key = F.col("conv_id").cast("string").alias("recording")
    known = m.where(n != 4).select(key, F.lit(1).cast("long").alias("call"), F.concat(F.lit("reply "), F.col("conv_id").cast("string")).alias("text"), F.col("want").alias("messages"), F.lit(None).cast("string").alias("problem"))
    asked = m.select("conv_id", key, F.lit(1).cast("long").alias("call"), sent.alias("messages"))
    return recordings.replayed(asked, known, ["conv_id"]).drop("recording", "call")


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
SELECT s_nationkey, r AS row, 0 AS column, s_name AS cell FROM s UNION ALL SELECT s_nationkey, r, 1, nullif(concat_ws(' ', CASE WHEN s_suppkey % 4 <> 0 THEN 'v ' || s_suppkey END, CASE WHEN s_suppkey % 3 = 0 THEN 'more' END), '') FROM s UNION ALL SELECT s_nationkey, r, 2, s_suppkey::VARCHAR FROM s
UNION ALL SELECT DISTINCT s_nationkey, 0, c, ['name', 'value', 'key'][c + 1] FROM s, range(3) t(c)""")
def scraped_tables(spark, d):
    """Each nation's suppliers as a table laid out by spaces, with empty and wrapped cells, read back by its gaps."""
    s = table(spark, d, "supplier")
    pad = lambda c, n: F.rpad(c, n, F.lit(" "))
    value = F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("v "), F.col("s_suppkey").cast("string"))).otherwise("")
    line = F.concat(F.lit("  "), pad(F.col("s_name"), 20), pad(value, 14), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("\n"), F.repeat(F.lit(" "), 22), F.lit("more"))).otherwise(""))
    rows = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    head = F.concat(F.lit("\n  "), pad(F.lit("name"), 20), pad(F.lit("value"), 14), F.lit("key\n"))
    return text_tables.cells(rows.select("s_nationkey", F.concat(head, "t").alias("text")), ["s_nationkey"]).drop("block")


@query("SELECT doc_id, sha256(text) AS sha, length(text) AS chars FROM documents")
def resolved_texts(spark, d):
    """Texts put into the store once each, looked up by hash."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    refs = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    return store.resolve(refs, store.put(docs), "sha", "payload").select("doc_id", "sha", F.length("payload").cast("long").alias("chars"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn // 2 END AS o, CASE WHEN role = 'assistant' THEN CASE WHEN conv_id % 3 = 0 THEN turn // 2 + 9 ELSE turn // 2 END END AS c FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT *, lag(o) OVER (PARTITION BY conv_id ORDER BY turn) AS po, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM t) SELECT conv_id, max_by(c, turn) AS number, max_by(was, turn) AS first, max(turn) AS last FROM p WHERE c IS NOT NULL AND po = c GROUP BY 1""")
def last_complete_turns(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    half = F.floor(F.col("turn") / 2)
    closed = F.when(F.col("role") == "assistant", F.when(F.col("conv_id") % 3 == 0, half + 9).otherwise(half))
    return lists.last_complete(c, ["conv_id"], "turn", F.when(F.col("role") == "user", half), closed)


@query("""SELECT n_name AS direction, round(greatest(0.0, (x/n + 3.841458820694124/(2*n)) / (1 + 3.841458820694124/n) - 1.959963984540054 * sqrt(x/n*(1-x/n)/n + 3.841458820694124/(4*n*n)) / (1 + 3.841458820694124/n)), 9) AS low
FROM (SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 0)::DOUBLE AS x, count(*)::DOUBLE AS n FROM customer GROUP BY 1) RIGHT JOIN nation ON c_nationkey = n_nationkey""")
def reference_intervals(spark, d):
    """Every direction with the interval of its reference counts, null where there are none."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("x"), F.count("*").alias("n"))
    j = table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rounded(j.select(F.col("n_name").alias("direction"), stats.wilson(F.col("x"), F.col("n"))[0].alias("low")), "low")


@query("SELECT a.s_suppkey AS reference, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < 0 AND b.s_acctbal >= 0")
def self_pairs(spark, d):
    return tasks.self_pairs(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") < 0).alias("own")), "s_nationkey", "own", "s_suppkey")


@query(f"""WITH {_A} SELECT trial_id, 'attempt ' || i AS section, 0 AS ordinal, 'stage reached' AS key, stage AS value FROM a UNION ALL SELECT trial_id, 'attempt ' || i, 2, 'exit_code', CASE WHEN failed THEN '1' ELSE '0' END FROM a
UNION ALL SELECT trial_id, 'reference run', 4, 'stdout_truncated', CASE WHEN l_orderkey % 4 = 0 THEN 'true' ELSE 'false' END FROM a WHERE i = 0 UNION ALL SELECT trial_id, 'summary', 8, 'attempts', n::VARCHAR FROM a WHERE i = 0""")
def page_facts(spark, d):
    f = facts.trial_facts(trials(spark, d))
    return f.where("(section like 'attempt%' and ordinal in (0, 2)) or (section = 'reference run' and ordinal = 4) or (section = 'summary' and ordinal = 8)")


@query(f"""WITH {_A}, m AS (SELECT trial_id, i AS request, 0 AS ordinal, 'system' AS role, sha256(l_returnflag) AS sha256 FROM a UNION ALL SELECT trial_id, i, 1, 'user', sha256(l_partkey::VARCHAR) FROM a)
SELECT *, row_number() OVER (PARTITION BY trial_id, sha256 ORDER BY request, ordinal) = 1 AS first FROM m""")
def page_messages(spark, d):
    return facts.shown_messages(trials(spark, d))


@query(f"WITH {_A} SELECT trial_id, 'stderr_truncated' AS flag, n + 1 AS missing FROM a WHERE i = 0 UNION ALL SELECT trial_id, 'workdir_incomplete', 1 FROM a WHERE i = 0")
def unrecorded_flags(spark, d):
    return facts.missing_flags(trials(spark, d))


__all__ = ["ORACLE_SQL", "QUERIES"]
