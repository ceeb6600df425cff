"""Readers and writers. All go through Spark's own sources, so any file system that Spark reads will do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.functions import ids
from trialweave.sources import schema


def load_trials(spark: SparkSession, run_dir: str) -> DataFrame:
    """Trial records six levels deep: strict types, known keys only, the id equal to the path, in id order."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "trial.json").text(f"{run_dir}/*/*/*/*/*/*").withColumn("path", F.col("_metadata.file_path"))
    parsed = files.select("path", F.from_json("value", schema.TRIAL, {"mode": "FAILFAST"}).alias("t"), F.json_object_keys("value").alias("keys"))
    known = F.array(*[F.lit(c) for c in sorted(schema.TRIAL.fieldNames())])
    here = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+/[^/]+/[^/]+/run[0-9]+)/trial\.json$", 1)
    problem = F.when(~F.array_sort("keys").eqNullSafe(known), F.concat(F.lit("unknown or missing keys in "), "path")).when(~here.eqNullSafe(F.col("t.trial_id")), F.concat(F.lit("trial_id differs from the path "), "path"))
    checked = parsed.withColumn("t", F.when(problem.isNull(), F.col("t")).otherwise(F.raise_error(problem)))
    return checked.select("t.*").orderBy("trial_id")


def write_trials(trials: DataFrame, run_dir: str) -> None:
    """One trial.json a trial, in the directory its id names; an existing directory is an error."""
    parts = F.split("trial_id", "/")
    names = ["p0", "p1", "p2", "p3", "p4", "p5"]
    rows = trials.select(F.to_json(F.struct(*schema.TRIAL.fieldNames()), {"ignoreNullFields": "false"}).alias("value"), *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    rows.write.mode("errorifexists").partitionBy(*names).text(run_dir)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Trial records as JSON lines or Parquet with the explicit schema."""
    return spark.read.schema(schema.TRIAL).option("mode", "FAILFAST").json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.schema(schema.TRIAL).parquet(path)


def check_keys(trials: DataFrame) -> DataFrame:
    """Raise where an id repeats; the aggregate joins back as one row, so no row reaches the driver."""
    twice = trials.groupBy("trial_id").count().where("count > 1").agg(F.min("trial_id").alias("id")).first()["id"]
    if twice is not None:
        raise ValueError(f"trial_id appears more than once: {twice}")
    return trials


def partition_clashes(df: DataFrame, columns: tuple[str, ...] = schema.PARTITIONS) -> DataFrame:
    """Partition names that differ by case alone, or that end in a full stop."""
    value = F.concat_ws("/", *columns)
    rows = df.select(value.alias("prefix")).distinct()
    fold = rows.groupBy(F.lower("prefix").alias("folded")).agg(F.sort_array(F.collect_list("prefix")).alias("prefixes"))
    return fold.where((F.size("prefixes") > 1) | F.exists("prefixes", lambda p: p.rlike(r"\.(/|$)")))


SPREAD = 16


def write_flat(tables: dict[str, DataFrame], out: str) -> None:
    """The flat tables as Hive partitions; all are computed before any is replaced, and a table without rows has no directory."""
    clash = partition_clashes(tables["trials"]).first()
    if clash is not None:
        raise ValueError(f"partition names clash: {clash['prefixes']}")
    staged = f"{out}/.staged-{uuid.uuid4().hex}"
    spark = tables["trials"].sparkSession
    # A partition may hold most of the rows, so its trials are spread over several tasks (and files).
    spread = (*schema.PARTITIONS, F.pmod(F.xxhash64("trial_id"), F.lit(SPREAD)))
    for name, df in tables.items():
        df.select(*schema.FLAT[name].fieldNames()).repartition(*spread).sortWithinPartitions(*schema.SORT[name]).write.parquet(f"{staged}/{name}")
    for name in tables:
        df = spark.read.schema(schema.FLAT[name]).parquet(f"{staged}/{name}")
        target = f"{out}/{name}"
        _delete(spark, target)
        if not df.isEmpty():
            df.repartition(*spread).sortWithinPartitions(*schema.SORT[name]).write.mode("overwrite").partitionBy(*schema.PARTITIONS).parquet(target)
    _delete(spark, staged)


def read_flat(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One flat table in key order, nulls first; a missing table is empty and a missing column null."""
    if not _exists(spark, f"{out}/{name}"):
        return spark.createDataFrame([], schema.FLAT[name])
    df = spark.read.schema(schema.FLAT[name]).parquet(f"{out}/{name}").select(*schema.FLAT[name].fieldNames())
    return df.orderBy(*[F.asc_nulls_first(c) for c in schema.SORT[name]])


def write_with_manifest(tables: dict[str, DataFrame], out: str, facts: dict) -> None:
    """Tables first, the manifest last: a reader that finds the manifest finds all of the tables."""
    first = next(iter(tables.values()))
    _delete(first.sparkSession, f"{out}/manifest")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    first.sparkSession.createDataFrame([(json.dumps(facts | {"tables": sorted(tables)}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")


def read_manifest(spark: SparkSession, out: str) -> dict:
    """Strict JSON: no NaN, no infinity."""
    text = spark.read.text(f"{out}/manifest").first()["value"]
    return json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(f"{c} is not JSON")))


def read_yaml(spark: SparkSession, path: str, required: set[str]) -> dict:
    """A small YAML mapping with exactly the keys asked for."""
    import yaml

    text = spark.read.option("wholetext", True).text(path).first()["value"]
    data = yaml.safe_load(text)
    if not isinstance(data, dict) or set(data) != required:
        raise ValueError(f"{path}: expected the keys {sorted(required)}")
    return data


def dimension(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small dimension table from driver data."""
    return spark.createDataFrame([tuple(r.values()) for r in rows], ddl)


def reference_values(spark: SparkSession, data: dict) -> DataFrame:
    """Published values {direction: {metric: {reading: 'c/n', cite}}} as (direction, metric, reading, count, denominator, cite)."""
    rows = [{"d": d, "m": m, "r": r, "f": str(v), "c": x.get("cite")} for d, ms in data.items() for m, x in ms.items() for r, v in x.items() if r != "cite"]
    df = dimension(spark, rows, "direction string, metric string, reading string, fraction string, cite string")
    c, n = (F.regexp_extract("fraction", r"^([0-9]+)/([0-9]+)$", i) for i in (1, 2))
    ok = F.when(c != "", c.cast("long")), F.when(n != "", n.cast("long"))
    bad = ok[0].isNull() | (ok[1] < 1) | (ok[0] > ok[1])
    return df.select("direction", "metric", "reading", F.when(~bad, ok[0]).otherwise(F.raise_error(F.concat(F.lit("bad fraction "), "fraction")).cast("long")).alias("count"), ok[1].alias("denominator"), "cite")


def read_text_store(spark: SparkSession, path: str) -> DataFrame:
    """A content-addressed store of files: sha256 from the name, payload, and whether the payload has that hash."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = df.select(F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1).alias("sha256"), F.col("content").alias("payload"))
    return named.withColumn("intact", F.sha2("payload", 256) == F.col("sha256"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def parsed_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("__id", ids.parse(F.col("trial_id")))
