"""Output comparison: named arrays of a reference and a candidate, full outer by name, statistics by Arrow batches."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.sources.array_codec import FLOATS, ordered_keys, values

STATS = "name string, pcc double, max_abs double, max_ulp decimal(20,0), passed boolean, note string"


def pearson(x: np.ndarray, y: np.ndarray) -> float:
    """1 for equal sides, 0 for a constant side, else the correlation with exact sums, clamped to [-1, 1].

    Both sides are rows of one matrix; each row is scaled by a power of two first, so that squares neither overflow nor
    vanish and nothing is rounded by it.
    """
    both = np.stack([x, y]).astype(np.float64)
    if np.array_equal(both[0], both[1]):
        return 1.0
    if (both == both[:, :1]).all(axis=1).any():
        return 0.0
    _, power = np.frexp(np.abs(both).max(axis=1))
    both = np.ldexp(both, -power[:, None])
    both -= np.array([[math.fsum(row)] for row in both]) / both.shape[1]
    xx, yy, xy = (math.fsum(both[i] * both[j]) for i, j in ((0, 0), (1, 1), (0, 1)))
    scale = xx * yy
    return float(np.clip(xy / math.sqrt(scale), -1.0, 1.0)) if scale > 0 else 0.0


def compare(dtype: str, a: bytes, b: bytes, metric: str | None, threshold: float | None) -> tuple:
    """(pcc, max_abs, max_ulp, passed, note) of two arrays of one dtype and shape."""
    x, y = values(dtype, a), values(dtype, b)
    if dtype not in FLOATS:
        differ = np.flatnonzero(x != y)
        far = max((abs(int(p) - int(q)) for p, q in zip(x[differ], y[differ], strict=True)), default=0)
        note = f"{len(differ)} elements differ, the first at {differ[0]}" if len(differ) else None
        return pearson(x.astype(np.float64), y.astype(np.float64)), float(far), None, not len(differ), note
    x, y = x.astype(np.float64), y.astype(np.float64)
    both = np.isfinite(x) & np.isfinite(y)
    lost = np.flatnonzero(~both & ~((np.isnan(x) & np.isnan(y)) | (np.isinf(x) & (x == y))))
    notes = [f"{len(lost)} elements hold an unmatched NaN or infinity, the first at {lost[0]}"] if len(lost) else []
    with np.errstate(over="ignore"):
        far = float(np.abs(x[both] - y[both]).max()) if both.any() else 0.0
    kx, ky = ordered_keys(dtype, a)[both], ordered_keys(dtype, b)[both]
    ulp = max((abs(int(p) - int(q)) for p, q in ((kx[i], ky[i]) for i in np.flatnonzero(kx != ky).tolist())), default=0)
    if not math.isfinite(far):
        far, _ = None, notes.append("the largest difference overflows")
    pcc = pearson(x[both], y[both])
    value = {"pcc": pcc, "max_abs": far, "ulp": ulp}.get(metric or "")
    if not notes:
        if threshold is None or value is None:
            notes.append("no threshold")
        elif not (value >= threshold if metric == "pcc" else value <= threshold):
            notes.append(f"{metric} {value} against {threshold}")
    return pcc, far, ulp, not notes, "; ".join(notes) or None


def first_of_name(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """Of arrays with one name, the first by path; how many there were is kept."""
    pick = F.min_by(F.struct("dtype", "shape", "data"), "path")
    return arrays.groupBy(*keys, "name").agg(pick.alias("x"), F.count("*").alias("times"))


def compare_outputs(reference: DataFrame, candidate: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of every named array on either side: keys, then STATS.

    ``reference`` and ``candidate``: keys, name, path, dtype, shape, data; ``thresholds``: name, metric, threshold (small).
    """
    r, c = (first_of_name(d, keys).withColumnsRenamed({"x": s, "times": f"{s}_times"}) for d, s in ((reference, "r"), (candidate, "c")))
    both = r.join(c, [*keys, "name"], "full").join(thresholds, "name", "left")
    gone = F.when(F.col("c").isNull(), "missing in the candidate").when(F.col("r").isNull(), "not in the reference").when(F.col("c_times") > 1, "name repeated").when(~F.col("r.dtype").eqNullSafe(F.col("c.dtype")), F.concat_ws(" ", F.lit("dtype"), "r.dtype", "c.dtype")).when(~F.col("r.shape").eqNullSafe(F.col("c.shape")), "shape mismatch")
    flat = both.select(*keys, "name", gone.alias("problem"), F.col("r.dtype").alias("dtype"), F.when(gone.isNull(), F.col("r.data")).alias("a"), F.when(gone.isNull(), F.col("c.data")).alias("b"), "metric", "threshold")

    def run(batches):
        for pdf in batches:
            rows = [(None, None, None, False, q.problem) if q.problem is not None else compare(q.dtype, bytes(q.a), bytes(q.b), q.metric, None if pd.isna(q.threshold) else q.threshold) for q in pdf.itertuples(index=False)]
            rows = [(p, far, None if ulp is None else Decimal(ulp), *rest) for p, far, ulp, *rest in rows]
            out = pdf[[*keys, "name"]].copy()
            for i, n in enumerate(("pcc", "max_abs", "max_ulp", "passed", "note")):
                out[n] = pd.Series([x[i] for x in rows], dtype=object, index=out.index)
            yield out

    kinds = ", ".join(f"{k} {dict(reference.dtypes)[k]}" for k in keys)
    return flat.mapInPandas(run, ", ".join(filter(None, (kinds, STATS))))


def alignment(stats: DataFrame, keys: list[str]) -> DataFrame:
    """1.0 where all outputs passed, else 0.0."""
    return stats.groupBy(*keys).agg(F.bool_and("passed").cast("double").alias("alignment"))
