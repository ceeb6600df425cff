"""Nested records: flattening, scores, metrics, writers and readers, by hand-made trials."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trialweave.functions import ids, stats
from trialweave.operators import flatten, metrics, scoring
from trialweave.plans import lifecycle
from trialweave.sources import io, schema

SHA = "a" * 64
NO_RUN = dict(exit_code=None, hang=None, sim_ub=None, wall_s=None, stdout_ref=None, outputs_ref=None, stdout_truncated=None, stderr_truncated=None, workdir_incomplete=None, outputs=None)
CLEAN = NO_RUN | dict(exit_code=0, hang=False, stdout_ref=dict(sha256=SHA, path="texts/aa"))
WARN = dict(stage="compile", severity="warning", code=None, file="a.cu", line=3, column=None, message="w")


def attempt(index, stage="S5", run=CLEAN, mean=1.0, diagnostics=(), guards=(False, False, False), outputs=None):
    return dict(
        index=index, prompt_ref=None, response_text=dict(sha256=SHA, path="p"), files={"b.cu": "x", "a.cu": "y"}, diff_from_previous=None, stage_reached=stage, diagnostics=list(diagnostics), run=run,
        alignment=dict(per_input=[mean] if mean is not None else [], mean=mean, outputs=outputs), profile=None, guards=dict(zip(("host_compute", "harness_tamper", "oracle_access"), guards, strict=True)), score=None,
    )


def trial(item, run, attempts=(), end=None, arm="m--a", direction="x2y", reference=CLEAN, requests=None, baseline=()):
    return dict(
        trial_id=f"p/{arm}/2024/{direction}/{item}/run{run:02d}", recipe_hash=SHA, toolchain_pins=None, provenance=dict(commit="c", dirty=False, device=None if run % 2 else "host", sdk=None, date="2026-01-01T00:00:00+00:00"),
        bench_item=dict(suite="s", item=item, split="dev", direction=direction), model=dict(backend="mock", id="m/a", sampling=dict(temperature=0.0, top_p=1.0, max_tokens=5)), reference_run=reference, reference_agreement=[],
        baseline_diagnostics=list(baseline), context=None, requests=requests, attempts=list(attempts),
        final=dict(stage_reached=attempts[-1]["stage_reached"] if attempts else None, alignment=None, score=None, corrections=max(0, len(attempts) - 1), wall_s=1.0, end_reason=dict(code=end, message="m") if end else None),
    )


TRIALS = [
    trial("i1", 1, [attempt(0)], requests=[]),
    trial("i1", 2, [attempt(0, "S1", NO_RUN, None, [WARN]), attempt(1, "S5", CLEAN, 0.5, [WARN, WARN, WARN | dict(line=4)])], requests=[dict(index=0, stage="generate", attempt_index=1, messages=[dict(role="user", ref=dict(sha256=SHA, path="t"))], reply_ref=None, diagnostics=[])]),
    trial("i1", 3, [attempt(0, "S4", NO_RUN | dict(exit_code=1, hang=False), None, [WARN | dict(code="fence-quirk", severity="note")])]),
    trial("i2", 1, [], "baseline-run", baseline=[WARN]),
    trial("i2", 2, [attempt(0, "S5", CLEAN, 1.0, guards=(True, None, False))]),
    trial("i2", 3, [attempt(0, "S4", CLEAN, None)], "sim-gap"),
    trial("i2", 4, [attempt(0, "S1", NO_RUN, None)] * 1, "correction-cap"),
]


@pytest.fixture(scope="module")
def trials(spark):
    return spark.read.schema(schema.TRIAL).json(spark.sparkContext.parallelize([json.dumps(t) for t in TRIALS]))


def test_flat_tables(trials):
    t = {k: v.collect() for k, v in flatten.flat_tables(trials).items()}
    assert {k: len(v) for k, v in t.items()} == {"trials": 7, "attempts": 7, "diagnostics": 6, "requests": 1, "output_stats": 0}
    assert all([f for f in v[0].asDict()] == schema.FLAT[k].fieldNames() for k, v in t.items() if v)
    assert [len(schema.FLAT[k]) for k in ("trials", "attempts", "diagnostics", "requests", "output_stats")] == [54, 35, 14, 13, 13]
    base = [r for r in t["diagnostics"] if r["attempt_index"] is None]
    assert len(base) == 1 and base[0]["ordinal"] == 0
    assert t["attempts"][0]["files"] == '{"a.cu":"y","b.cu":"x"}' and t["attempts"][0]["run_outputs"] is None


def test_round_trip(spark, trials, tmp_path):
    lifecycle.flatten_run(trials, str(tmp_path / "flat"))
    assert io.read_flat(spark, str(tmp_path / "flat"), "output_stats").count() == 0 and not (tmp_path / "flat/output_stats").exists()
    back = io.read_flat(spark, str(tmp_path / "flat"), "trials").collect()
    assert [r["bench"] for r in back] == ["2024"] * 7 and [r["trial_id"] for r in back] == sorted(t["trial_id"] for t in TRIALS)
    for t in TRIALS:
        d = tmp_path / "run" / t["trial_id"]
        d.mkdir(parents=True)
        (d / "trial.json").write_text(json.dumps(t))
    got = lifecycle.score_run(spark, str(tmp_path / "run"), ["outcome", "reward"], str(tmp_path / "scores"))
    assert got["trial_components"].count() == 7 * 14 + 7 * 3 and io.read_manifest(spark, str(tmp_path / "scores"))["profiles"] == ["outcome", "reward"]
    assert "compile_rate" in lifecycle.report_run(got)
    odd = tmp_path / "run" / "p/m--a/2024/x2y/i9/run01"
    odd.mkdir(parents=True)
    (odd / "trial.json").write_text(json.dumps(TRIALS[0]))
    with pytest.raises(Exception, match="differs from the path"):
        io.load_trials(spark, str(tmp_path / "run")).collect()


def test_violations(trials):
    assert flatten.violations(trials).count() == 0
    broken = trials.withColumn("trial_id", F.lit("bad id")).withColumn("attempts", F.transform("attempts", lambda a: a.withField("index", a["index"] + 1)))
    assert {r["problem"] for r in flatten.violations(broken).collect()} >= {"malformed trial id", "attempt indices are not 0..n-1"}
    with pytest.raises(ValueError):
        io.check_keys(trials.unionByName(trials))


def test_scores(trials):
    r = {(x["trial_id"][-8:], x["attempt_index"]): x["r"] for x in scoring.attempt_scores(trials).collect()}
    assert r["i1/run01", 0] == pytest.approx(1.0) and r["i1/run02", 0] == pytest.approx(-0.8) and r["i1/run02", 1] == pytest.approx(0.2 - 0.04 + 0.4)
    assert r["i2/run02", 0] == -1.0 and r["i2/run03", 0] is None
    t = {x["trial_id"][-8:]: x for x in scoring.trial_scores(trials).collect()}
    assert t["i1/run02"]["multi_turn"] == pytest.approx(0.56 - 0.05) and t["i2/run01"]["single_turn"] is None and t["i2/run03"]["multi_turn"] is None
    again = scoring.apply_scores(trials).where("trial_id like '%i1/run01'").first()
    assert again["final"]["score"] == pytest.approx(1.0) and again["attempts"][0]["score"]["scalar"] == pytest.approx(1.0)


def test_outcomes(trials):
    o = {x["trial_id"][-8:]: x for x in scoring.outcomes(trials).collect()}
    assert [o[k]["correct"]["value"] for k in ("i1/run01", "i1/run02", "i1/run03", "i2/run01", "i2/run03", "i2/run04")] == [1.0, 0.0, 0.0, None, None, 0.0]
    assert o["i2/run01"]["compiled"]["value"] is None and "baseline" in o["i2/run01"]["correct"]["note"] and o["i1/run03"]["fence_quirk"]["value"] == 1.0
    assert o["i2/run04"]["cap_hit"]["value"] == 1.0 and o["i1/run01"]["first_try"]["value"] == 1.0 and o["i1/run01"]["sim_t"]["note"]


def test_metric_rows(spark, trials):
    long = scoring.score_trials(trials, ["outcome"])
    scored = metrics.scored_trials(trials, long)
    rows = {r["metric"]: r for r in metrics.metric_rows(scored).collect()}
    assert (rows["compile_rate"]["numerator"], rows["compile_rate"]["denominator"], rows["compile_rate"]["excluded"]) == (5.0, 6, 1)
    assert (rows["correct_rate"]["numerator"], rows["correct_rate"]["denominator"]) == (2.0, 5)
    assert rows["pass@1"]["value"] == pytest.approx((1 / 3 + 1 / 2) / 2) and rows["pass@3"]["value"] is None and rows["within_10pct_rate"]["placeholder"]
    assert {r["stage"]: r["count"] for r in metrics.stage_reached(scored).collect()} == {"S0": 0, "S1": 1, "S2": 0, "S3": 0, "S4": 2, "S5": 3, "none": 1}
    ref = io.reference_values(spark, {"x2y": {"correct_rate": {"published": "3/4", "recount": "2/4", "cite": "t"}}})
    got = {r["metric"]: r for r in metrics.metric_rows(scored, ref).collect()}
    assert got["correct_rate"]["published"] == Row(count=3, denominator=4) and got["compile_rate"]["published"] is None


def test_metric_rows_of_a_null_arm(spark, trials):
    """A group without a name keeps its rows."""
    from pyspark.sql import functions as F

    scored = metrics.scored_trials(trials, scoring.score_trials(trials, ["outcome"]))
    named = {(r["arm"], r["metric"]) for r in metrics.metric_rows(scored).collect()}
    none = {(r["arm"], r["metric"]) for r in metrics.metric_rows(scored.withColumn("arm", F.lit(None).cast("string"))).collect()}
    assert {m for _, m in named} == {m for _, m in none} and {a for a, _ in none} == {None}



def test_statistics(spark):
    df = spark.createDataFrame([(34, 40), (9, 10), (10, 10), (0, 0)], "x long, n long")
    low, high = stats.wilson(F.col("x"), F.col("n"))
    got = df.select(F.round(low, 3), F.round(high, 3)).collect()
    assert [tuple(r) for r in got] == [(0.709, 0.929), (0.596, 0.982), (0.722, 1.0), (None, None)]
    k = spark.createDataFrame([(5, 2), (2, 1), (4, 0), (4, 4)], "n long, c long").select(stats.pass_at_k(F.col("n"), F.col("c"), 3)).collect()
    assert [r[0] for r in k] == [pytest.approx(0.9), None, 0.0, 1.0]
    v = spark.createDataFrame([(x,) for x in (0.5996, 0.5951, 0.595, 0.6, 0.59, 0.5949)], "v double").select(stats.reaches_threshold(F.col("v"))).collect()
    assert [r[0] for r in v] == [True, True, False, True, False, False]
    p = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 5.0)], "a double, b double, c double").agg(stats.pearson("a", "b"), stats.pearson("a", "c")).first()
    assert tuple(p) == (1.0, 0.0)


def test_ids(spark):
    df = spark.createDataFrame([("p/a+b/2024/x2y/i/run007",)], "trial_id string").select(ids.parse(F.col("trial_id")).alias("p"))
    assert df.first()["p"]["arm"] == "a+b" and df.first()["p"]["run"] == 7
    with pytest.raises(Exception, match="bad trial id"):
        spark.createDataFrame([("p/a/run1",)], "trial_id string").select(ids.parse(F.col("trial_id"))).collect()


def test_scores_need_no_exchange(spark):
    """All of a trial's scores come from its own row."""
    from trialweave.operators import scoring
    from trialweave.sources.schema import TRIAL

    t = spark.createDataFrame([], TRIAL)
    for df in (scoring.attempt_scores(t), scoring.trial_scores(t), scoring.apply_scores(t)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_conform(spark):
    from pyspark.sql import functions as F

    from trialweave.sources.schema import conform, row

    want = row("a long, s struct<x:long,y:string>, l array<struct<x:double,z:boolean>>, m map<string,string>")
    df = spark.sql("select 1 as a, named_struct('x', 2) as s, array(named_struct('x', 3), null) as l, map('k', 'v') as m union all select null, null, null, null").select(F.struct("a", "s", "l", "m").alias("t"))
    got = df.select(conform(F.col("t"), df.schema["t"].dataType, want).alias("t")).select("t.*")
    assert [f.dataType for f in got.schema.fields] == [f.dataType for f in want.fields]
    first, second = sorted(got.collect(), key=lambda r: r["a"] is None)
    assert first["a"] == 1 and tuple(first["s"]) == (2, None) and [x and tuple(x) for x in first["l"]] == [(3.0, None), None] and first["m"] == {"k": "v"} and tuple(second) == (None,) * 4
