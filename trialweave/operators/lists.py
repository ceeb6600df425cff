"""Ordered lists: caps that stop at the first line that does not fit, islands of lines, top-k, first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped_lines(lines: DataFrame, keys: list[str], order: str, text: str, most_lines: int = 50, most_bytes: int = 16384) -> DataFrame:
    """Lines kept under both caps (each line's bytes and its line feed), stopping at the first that does not fit; ``left_out`` counts the rest."""
    w = Window.partitionBy(*keys).orderBy(order)
    size = F.sum(F.octet_length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = lines.withColumn("__n", F.row_number().over(w)).withColumn("__fits", (F.col("__n") <= most_lines) & (size <= most_bytes))
    stop = F.max((~F.col("__fits")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 0
    d = d.withColumn("kept", stop).withColumn("left_out", F.count_if(~F.col("kept")).over(Window.partitionBy(*keys)))
    return d.drop("__n", "__fits")


def islands(lines: DataFrame, keys: list[str], order: str, start: Column, end: Column) -> DataFrame:
    """Number the blocks that open at a start line and close before the first end line; lines outside have no block."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lines.withColumn("__s", F.sum(start.cast("int")).over(w))
    inside = Window.partitionBy(*keys, "__s").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__closed", F.max(F.when(end & ~start, 1).otherwise(0)).over(inside))
    return d.withColumn("block", F.when((F.col("__s") > 0) & (F.col("__closed") == 0), F.col("__s"))).drop("__s", "__closed")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def first_seen(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """The first of equal rows in order, as an aggregate (partial on each side of the shuffle), not a window."""
    rest = [c for c in df.columns if c not in same]
    return df.groupBy(*same).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__x")).select(*same, *[F.col(f"__x.{c}").alias(c) for c in rest])


def last_complete(lines: DataFrame, keys: list[str], order: str, opened: Column, closed: Column) -> DataFrame:
    """(keys, number, first, last): the last pair of an opening and a closing line with one number.

    ``opened`` and ``closed`` give a line's number or null; a closing line ends whatever stands open.
    """
    mark = lines.select(*keys, order, opened.alias("o"), closed.alias("c")).where("o is not null or c is not null")
    w = Window.partitionBy(*keys).orderBy(order)
    prior = mark.withColumn("po", F.lag("o").over(w)).withColumn("at", F.lag(order).over(w))
    pairs = prior.where("c is not null and po = c")
    return pairs.groupBy(*keys).agg(F.max_by(F.struct(F.col("c").alias("number"), F.col("at").alias("first"), F.col(order).alias("last")), order).alias("x")).select(*keys, "x.*")


def names_report(wanted: Column, got: Column) -> Column:
    """missing, unknown and repeated names of two arrays."""
    return F.struct(F.array_sort(F.array_except(wanted, got)).alias("missing"), F.array_sort(F.array_except(got, wanted)).alias("unknown"), F.array_sort(F.array_distinct(F.filter(got, lambda x: F.size(F.filter(got, lambda y: y == x)) > 1))).alias("repeated"))
