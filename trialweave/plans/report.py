"""Markdown of small results; values are formatted on the driver, where rounding is Python's."""

from __future__ import annotations

from pyspark.sql import DataFrame

EMPTY = "-"


def cell(x: object) -> str:
    if x is None:
        return EMPTY
    text = f"{x:.3f}" if isinstance(x, float) else ", ".join(map(str, x)) if isinstance(x, list) else str(x)
    return " ".join(text.replace("|", "\\|").encode("ascii", "replace").decode().split()) or EMPTY


def markdown(rows: list[dict], columns: list[str]) -> str:
    out = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(out + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def fraction(count: float, n: int, low: float, high: float) -> str:
    return f"{count:g}/{n} = {count / n:.3f} (Wilson 95% {low:.3f} to {high:.3f})"


def metrics_markdown(rows: DataFrame, stages: DataFrame, corrections: DataFrame) -> str:
    """A section for each arm and direction: at most 11 metric rows, 7 stages and the corrections that occur."""
    out: list[str] = []
    metric = rows.orderBy("arm", "direction", "ordinal").collect()
    by = {}
    for name, df, order in (("stages", stages, "ordinal"), ("corrections", corrections, "corrections")):
        for r in df.orderBy("arm", "direction", order).collect():
            by.setdefault((r["arm"], r["direction"], name), []).append(r.asDict())
    for arm, direction in dict.fromkeys((r["arm"], r["direction"]) for r in metric):
        mine = [r.asDict() for r in metric if (r["arm"], r["direction"]) == (arm, direction)]
        out += [f"## {cell(arm)}, {cell(direction)}", "", f"Trials: {mine[0]['trials']}; scenarios: {mine[0]['scenarios']}; devices: {cell(mine[0]['devices'])}.", ""]
        out += [markdown(mine, ["metric", "value", "numerator", "denominator", "wilson_low", "wilson_high", "excluded"])]
        out += [markdown(by.get((arm, direction, "stages"), []), ["stage", "count"]), markdown(by.get((arm, direction, "corrections"), []), ["corrections", "count"])]
    return "\n".join(out)
