"""Exact sums, means and correlations against sums in unbounded integers."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from trialweave.functions import exact
from trialweave.operators.compare import pearson


def groups(rng):
    bits = lambda: rng.choice([-1, 1]) * rng.getrandbits(53)
    out = {
        "few": [0.1] * 10, "zero": [0.0, -0.0], "cancel": [1e308, 1.0, -1e308, 1e-300], "tiny": [5e-324] * 3 + [-5e-324], "one": [math.pi], "minus": [-0.1] * 7, "edge": [2.0**53, 1.0, 1.0], "tie": [2.0**53, 1.0], "tie up": [2.0**53, 1.0, 2.0**-200],
        "tie down": [2.0**53, 1.0, -(2.0**-200)], "power": [2.0**k for k in range(-1074, 1000, 7)], "below": [2.0**32, -(2.0**-40)], "inf": [math.inf, 1.0], "both": [math.inf, -math.inf], "nan": [math.nan, math.inf], "high": [1.7e308, -1.7e308, 3.0], None: [1.5, 2.25], "nulls": [None, None],
        "some": [None, 0.1, 0.2, 0.3],
    }
    for i in range(40):
        spread = rng.choice([0, 5, 60, 400])
        out[f"r{i}"] = [math.ldexp(bits(), rng.randint(-spread, spread) - 53) for _ in range(rng.choice([2, 30, 300]))]
        if i % 4 == 0:
            out[f"r{i}"] += [-v for v in out[f"r{i}"]][1:]
    return out


def want(values):
    v = [x for x in values if x is not None]
    if not v:
        return None
    if any(math.isinf(x) or math.isnan(x) for x in v):
        return sum(v)
    return math.fsum(v)


def test_sums_in_any_order(spark):
    rng = random.Random(7)
    g = groups(rng)
    rows = [(k, x) for k, vs in g.items() for x in vs]
    for _ in range(2):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, x double").repartition(rng.randint(1, 9))
        got = {r["k"]: r["s"] for r in exact.exact_sums(df, ["k"], {"s": F.col("x")}).collect()}
        assert set(got) == set(g)
        for k, vs in g.items():
            assert repr(got[k]).replace("-0.0", "0.0") == repr(want(vs)).replace("-0.0", "0.0"), k


def test_means_and_no_keys(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", None), ("b", 1.0), (None, 0.7), (None, 0.1)], "k string, x double")
    assert {r["k"]: r["mean"] for r in exact.exact_means(df, ["k"], "x").collect()} == {"a": math.fsum([0.1, 0.2, 0.3]) / 3, "b": None, None: math.fsum([0.7, 0.1]) / 2}
    assert exact.exact_sums(df, [], {"s": F.col("x"), "t": -F.col("x")}).collect() == [(math.fsum([0.1, 0.2, 0.3, 1.0, 0.7, 0.1]), -math.fsum([0.1, 0.2, 0.3, 1.0, 0.7, 0.1]))]


def test_correlations(spark):
    rng = random.Random(2)
    g = {f"g{i}": [(rng.gauss(0, 1) * 10.0**e, rng.gauss(0, 1)) for _ in range(50)] for i, e in enumerate((0, 5, 150, 300, -200))}
    g |= {"same": [(0.1, 0.1), (0.7, 0.7)], "flat": [(1.0, 2.0), (1.0, 3.0)], None: [(float(x), 3 * x + rng.gauss(0, 0.01)) for x in range(20)], "line": [(float(x), -2.0 * x) for x in range(9)]}
    df = spark.createDataFrame([(k, *p) for k, ps in g.items() for p in ps] + [("same", None, 1.0)], "k string, x double, y double").repartition(5)
    got = {r["k"]: r["pcc"] for r in exact.correlations(df, ["k"], "x", "y").collect()}
    import numpy as np

    assert got == {k: pearson(*(np.array(side) for side in zip(*ps, strict=True))) for k, ps in g.items()}


def test_rows_stay_where_they_are(spark):
    """Rows of a few groups are added up in their tasks: none is taken apart into bins, and none is exchanged for a join."""
    df = spark.range(0, 100_000, 1, 4).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"), F.sqrt("id").alias("y"))
    plan = exact.correlations(df, ["k"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range ") == 1 and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "Generate" not in plan
    big = spark.createDataFrame([(-(2.0**31) - 0.5,), (2.0**53 - 1,), (-(2.0**53),), (2.0**31 + 0.25,), (-(2.0**-40),)] * 3, "x double")
    assert exact.exact_sums(big, [], {"s": F.col("x")}).first()["s"] == math.fsum(r["x"] for r in big.collect())
