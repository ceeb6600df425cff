"""Trial ids: <project>/<arm>/<bench>/<direction>/<item>/run<NN>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PARTS = ("project", "arm", "bench", "direction", "item")
SEGMENT = "[A-Za-z0-9][A-Za-z0-9._+-]*"
VALID = "^" + "/".join([SEGMENT] * 5) + "/run[0-9]{2,}$"


def parse(trial_id: Column) -> Column:
    """A struct of the id's parts and its run number; an error where the id is malformed."""
    ok = F.when(trial_id.rlike(VALID), trial_id).otherwise(F.raise_error(F.concat(F.lit("bad trial id: "), F.coalesce(trial_id, F.lit("null")))).cast("string"))
    parts = F.split(ok, "/")
    fields = [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(PARTS)]
    return F.struct(*fields, F.substring(F.get(parts, F.lit(5)), 4, 18).cast("long").alias("run"))


def make(project: Column, arm: Column, bench: Column, direction: Column, item: Column, run: Column) -> Column:
    return F.concat_ws("/", project, arm, bench, direction, item, F.concat(F.lit("run"), F.when(run < 100, F.lpad(run.cast("string"), 2, "0")).otherwise(run.cast("string"))))


def arm_segment(model_id: Column) -> Column:
    return F.replace(model_id, F.lit("/"), F.lit("--"))


def scenario(bench: Column, item: Column) -> Column:
    return F.concat_ws("/", bench, item)
