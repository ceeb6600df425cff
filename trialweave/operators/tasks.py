"""Tables of tasks in Markdown: parsing, referential checks, what is next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pipe_table(lines: DataFrame, columns: list[str], order: str = "pos", text: str = "line") -> DataFrame:
    """Rows of a pipe table whose first cell is not the header's; cells are trimmed, an escaped bar stays in its cell."""
    row = F.regexp_extract(F.trim(text), r"^\|(.*)\|$", 1)
    cells = F.transform(F.split(row, r"(?<!\\)\|", -1), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    d = lines.select(order, cells.alias("c")).where((F.size("c") == len(columns)) & ~F.forall("c", lambda c: c.rlike("^:?-+:?$")))
    named = d.select(order, *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)])
    return named.where(F.lower(columns[0]) != columns[0].lower())


def with_dependencies(tasks: DataFrame, deps: str = "deps") -> DataFrame:
    """(task, dep) of a column that lists dependencies by commas or spaces."""
    return tasks.select("task", F.explode(F.filter(F.split(deps, r"[,\s]+"), lambda d: ~d.isin("", "-"))).alias("dep"))


def unknown_dependencies(tasks: DataFrame) -> DataFrame:
    return with_dependencies(tasks).join(tasks.select(F.col("task").alias("dep")), "dep", "left_anti")


def ready(tasks: DataFrame) -> DataFrame:
    """Tasks of which no dependency is open."""
    open_ = with_dependencies(tasks).join(tasks.where("state <> 'DONE'").select(F.col("task").alias("dep")), "dep").select("task").distinct()
    return tasks.join(open_, "task", "left_anti")


def next_task(tasks: DataFrame, order: str = "pos") -> DataFrame:
    """The first active task, else the first ready one."""
    pick = tasks.where("state = 'ACTIVE'").withColumn("__p", F.lit(0)).unionByName(ready(tasks).where("state = 'READY'").withColumn("__p", F.lit(1)))
    return pick.orderBy("__p", order).limit(1).drop("__p")


def by_state(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count("*").alias("n"))


def longest_suffix(path, keys):
    """The longest key that a path equals or ends with after a slash (in the row, no join)."""
    fits = F.filter(keys, lambda k: (path == k) | path.endswith(F.concat(F.lit("/"), k)))
    return F.aggregate(fits, F.lit(None).cast("string"), lambda best, k: F.when(best.isNull() | (F.length(k) > F.length(best)), k).otherwise(best))


def include_closure(files: DataFrame, roots: DataFrame, rounds: int = 100) -> DataFrame:
    """Files that roots include, step by step: files (name, text), roots (name); names sorted."""
    from trialweave.operators.graph import reach_labels

    inc = files.select(F.col("name").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*"([^"]+)"'), F.lit(1))).alias("dst"))
    known = inc.join(files.select(F.col("name").alias("dst")), "dst").select("src", "dst")
    reached = reach_labels(known, roots.select(F.col("name").alias("v")), rounds)
    return reached.select(F.col("v").alias("name")).orderBy("name")


def self_pairs(rows: DataFrame, key: str, own: str, name: str) -> DataFrame:
    """(reference, other): each row that is its group's own against the group's rows that are not."""
    a = rows.where(F.col(own)).select(key, F.col(name).alias("reference"))
    return a.join(rows.where(~F.col(own)).select(key, F.col(name).alias("other")), key).select("reference", "other")
