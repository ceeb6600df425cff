"""Explicit schemas: the nested trial record and its five flat tables. Nothing is inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "decimal(20,0)": T.DecimalType(20, 0)}


def _parts(text: str) -> list[str]:
    """Split at commas outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out]


def type_of(text: str) -> T.DataType:
    """A type by its DDL name, without a session."""
    if m := re.fullmatch(r"array<(.*)>", text):
        return T.ArrayType(type_of(m[1]))
    if m := re.fullmatch(r"map<(.*)>", text):
        return T.MapType(*map(type_of, _parts(m[1])))
    if m := re.fullmatch(r"struct<(.*)>", text):
        return T.StructType([T.StructField(n, type_of(k)) for n, _, k in (p.partition(":") for p in _parts(m[1]))])
    return _SIMPLE[text]


def row(ddl: str) -> T.StructType:
    """A schema from ``name type, ...``, without a session, so that modules import anywhere."""
    return T.StructType([T.StructField(n, type_of(k)) for n, _, k in (p.partition(" ") for p in _parts(ddl))])


# Fixed values.
STAGES = ("S0", "S1", "S2", "S3", "S4", "S5")
NO_STAGE = "none"
DIAGNOSTIC_STAGES = ("parse", "verify", "lower", "compile", "jit", "run")
SEVERITIES = ("error", "warning", "note")
PINS = ("llvm", "polygeist", "tt_mlir", "tt_metal", "ttsim", "furiosa_sdk", "cuda", "nvhpc", "rocm", "gcc")
RUN_FLAGS = ("stdout_truncated", "stderr_truncated", "workdir_incomplete")
END_REASONS = ("baseline-compile", "baseline-run", "baseline-disagree", "correction-cap", "upstream-crash", "sim-gap")
PARTITIONS = ("project", "arm", "bench", "direction")


def _struct(spec: str) -> str:
    return f"struct<{spec}>"


_REF = _struct("sha256:string,path:string")
_DIAG = _struct("stage:string,severity:string,code:string,file:string,line:long,column:long,message:string")
_STATS = _struct("name:string,pcc:double,max_abs:double,max_ulp:decimal(20,0),passed:boolean,note:string")
_RUN = _struct(f"exit_code:long,hang:boolean,sim_ub:boolean,wall_s:double,stdout_ref:{_REF},outputs_ref:{_REF}," + ",".join(f"{f}:boolean" for f in RUN_FLAGS) + ",outputs:map<string,string>")
_ATTEMPT = _struct(
    f"index:long,prompt_ref:{_REF},response_text:{_REF},files:map<string,string>,diff_from_previous:string,stage_reached:string,diagnostics:array<{_DIAG}>,run:{_RUN},"
    f"alignment:struct<per_input:array<double>,mean:double,outputs:array<{_STATS}>>,profile:struct<runtime_s:double,avg_power_w:double,energy_j:double>,"
    "guards:struct<host_compute:boolean,harness_tamper:boolean,oracle_access:boolean>,score:struct<components:map<string,double>,scalar:double>"
)
_REQUEST = _struct(f"index:long,stage:string,attempt_index:long,messages:array<struct<role:string,ref:{_REF}>>,reply_ref:{_REF},diagnostics:array<{_DIAG}>")
TRIAL_DDL = (
    "trial_id string, recipe_hash string, toolchain_pins struct<" + ",".join(f"{p}:string" for p in PINS) + ">, "
    "provenance struct<commit:string,dirty:boolean,device:string,sdk:string,date:string>, bench_item struct<suite:string,item:string,split:string,direction:string>, "
    f"model struct<backend:string,id:string,sampling:struct<temperature:double,top_p:double,max_tokens:long>>, reference_run {_RUN}, reference_agreement array<{_STATS}>, "
    f"baseline_diagnostics array<{_DIAG}>, context struct<knowledge_summary:string,source_description:string>, requests array<{_REQUEST}>, attempts array<{_ATTEMPT}>, "
    "final struct<stage_reached:string,alignment:double,score:double,corrections:long,wall_s:double,end_reason:struct<code:string,message:string>>"
)
TRIAL: T.StructType = row(TRIAL_DDL)

_KEYS = "project string, arm string, bench string, direction string, trial_id string"
_REF_COLS = "{0}_sha256 string, {0}_path string"


def _run_cols(prefix: str) -> str:
    refs = ", ".join(_REF_COLS.format(f"{prefix}_{r}") for r in ("stdout_ref", "outputs_ref"))
    return f"{prefix}_exit_code long, {prefix}_hang boolean, {prefix}_sim_ub boolean, {prefix}_wall_s double, {refs}, " + ", ".join(f"{prefix}_{f} boolean" for f in RUN_FLAGS) + f", {prefix}_outputs string"


FLAT_DDL = {
    "trials": f"{_KEYS}, item string, run long, recipe_hash string, " + ", ".join(f"toolchain_pins_{p} string" for p in PINS) + ", provenance_commit string, provenance_dirty boolean, provenance_device string, provenance_sdk string, provenance_date string, "
    "bench_item_suite string, bench_item_item string, bench_item_split string, bench_item_direction string, model_backend string, model_id string, model_sampling_temperature double, model_sampling_top_p double, model_sampling_max_tokens long, "
    + _run_cols("reference_run") + ", context_knowledge_summary string, context_source_description string, final_stage_reached string, final_alignment double, final_score double, final_corrections long, final_wall_s double, final_end_reason_code string, final_end_reason_message string, attempt_count long",
    "attempts": f"{_KEYS}, index long, {_REF_COLS.format('prompt_ref')}, response_sha256 string, files string, diff_from_previous string, stage_reached string, diagnostic_count long, " + _run_cols("run")
    + ", alignment_per_input array<double>, alignment_mean double, profile_runtime_s double, profile_avg_power_w double, profile_energy_j double, guards_host_compute boolean, guards_harness_tamper boolean, guards_oracle_access boolean, score_components string, score_scalar double",
    "diagnostics": f"{_KEYS}, attempt_index long, ordinal long, stage string, severity string, code string, file string, line long, column long, message string",
    "requests": f"{_KEYS}, index long, stage string, attempt_index long, message_roles array<string>, message_sha256 array<string>, {_REF_COLS.format('reply_ref')}, diagnostic_count long",
    "output_stats": f"{_KEYS}, attempt_index long, ordinal long, name string, pcc double, max_abs double, max_ulp decimal(20,0), passed boolean, note string",
}
FLAT = {k: row(v) for k, v in FLAT_DDL.items()}
SORT = {
    "trials": ("trial_id",),
    "attempts": ("trial_id", "index"),
    "diagnostics": ("trial_id", "attempt_index", "ordinal"),
    "requests": ("trial_id", "index"),
    "output_stats": ("trial_id", "attempt_index", "ordinal"),
}
METRICS = row(
    "arm string, direction string, ordinal long, metric string, value double, numerator double, denominator long, wilson_low double, wilson_high double, note string, placeholder boolean, paper_published string, paper_recount string, paper_cite string, "
    "compile_only boolean, b0_criterion string, trials long, scenarios long, trials_per_scenario_min long, trials_per_scenario_max long, devices array<string>"
)
STAGE_REACHED = row("arm string, direction string, ordinal long, stage string, count long")
CORRECTIONS = row("arm string, direction string, corrections long, count long")
COMPONENTS = row("trial_id string, profile string, component string, value double, note string, ordinal int")


def conform(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value as a wider type: fields it lacks are null, others are cast; no text in between."""
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        known = {f.name: f.dataType for f in have.fields}
        cells = [(conform(value[f.name], known[f.name], f.dataType) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*cells))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: conform(x, have.elementType, want.elementType))
    return value if have == want else value.cast(want)


def filled(want: T.DataType, cells) -> Column:
    """A value of ``want`` made at once: a dict is a struct (fields it lacks are null), a list an array, a column is taken as it is, or cast to a plain type."""
    if isinstance(cells, dict):
        return F.struct(*[(filled(f.dataType, cells[f.name]) if f.name in cells else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])
    if isinstance(cells, list):
        return F.array(*[filled(want.elementType, c) for c in cells])
    return cells if isinstance(want, (T.StructType, T.ArrayType, T.MapType)) else cells.cast(want)
