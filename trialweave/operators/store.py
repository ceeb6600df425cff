"""Content-addressed texts: dedup by hash, lookups with completeness checks, integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.text import content_path


def put(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row a distinct text: sha256, path, payload, and how often it came."""
    sha = F.sha2(F.col(text), 256)
    return texts.where(F.col(text).isNotNull()).groupBy(sha.alias("sha256")).agg(F.any_value(text).alias("payload"), F.count("*").alias("n")).withColumn("path", content_path(F.col("sha256")))


def resolve(refs: DataFrame, store: DataFrame, column: str, to: str) -> DataFrame:
    """Look up each hash; a hash without a text is an error, a null hash stays null."""
    s = store.select(F.col("sha256").alias("__sha"), F.col("payload").alias(to))
    j = refs.join(s, F.col(column) == F.col("__sha"), "left")
    lost = F.col(column).isNotNull() & F.col("__sha").isNull()
    return j.withColumn(to, F.when(lost, F.raise_error(F.concat(F.lit("no text of "), F.col(column)))).otherwise(F.col(to))).drop("__sha")


def corrupt(store: DataFrame) -> DataFrame:
    """Rows whose payload does not have its hash."""
    return store.where(F.sha2("payload", 256) != F.col("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, sha256): added, removed or changed."""
    a, b = before.select("path", F.col("sha256").alias("a")), after.select("path", F.col("sha256").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def first_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The least position (column ``i``) where two ordered lists differ or one ends."""
    x, y = (d.select("i", F.struct(*columns).alias(n)) for d, n in ((a, "x"), (b, "y")))
    return x.join(y, "i", "full").where(~F.col("x").eqNullSafe(F.col("y"))).agg(F.min("i").alias("i"))
