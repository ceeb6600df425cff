"""A simulator's logs: kernel build logs, and the note of a watchdog's last complete dump, as operators on lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.functions import text
from trialweave.operators import lists, parsers

# Line formats, the note's cap in bytes, how much of a log's end is read.
BUILD_FAILED = r"(?s)[A-Za-z0-9_]{1,64} build failed\. Log:(.*)"
DUMP_BEGINS = r"(?s)\ADump #([0-9]{1,20}) at .*"
DUMP_ENDS = r"(?s)\ADump #([0-9]{1,20}) completed at .*"
CORE_IDS = r"(?s)\A.* core\(.*k_ids:([0-9 |]+)\z"
KERNEL = r"(?s)\Ak_id\[ *([0-9]{1,20})\]: .*"
NOTE_BYTES, TAIL_BYTES = 4096, 1 << 20


def ascii_only(said: Column) -> Column:
    return F.regexp_replace(said, "[^ -~]", "?")


def _found(pattern: str, line: Column) -> Column:
    """The first group of a line that has the format, else null."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))


def kernel_diagnostics(logs: DataFrame, keys: list[str], *, stdout: str = "stdout", stderr: str = "stderr", workdir: str | None = None) -> DataFrame:
    """(keys, ordinal and a diagnostic's columns): what the build logs in both streams report, each once, stdout first.

    A build log is an island: it opens at its heading, whose rest is its first line, and closes before a blank line or
    the next heading.
    """
    streams = F.explode(F.array(*[F.struct(F.lit(i).alias("stream"), F.col(c).alias("log")) for i, c in enumerate((stdout, stderr))]))
    place = F.col(workdir) if workdir else F.lit(None).cast("string")
    lines = logs.select(*keys, place.alias("dir"), streams.alias("s")).select(*keys, "dir", "s.stream", F.posexplode(F.split("s.log", "\n", -1)).alias("n", "raw"))
    own = [*keys, "stream"]
    blank = parsers.trimmed(F.col("raw")) == ""
    inside = lists.islands(lines, own, "n", F.col("raw").rlike(BUILD_FAILED), blank).where("block is not null")
    shown = F.coalesce(parsers.trimmed(_found(BUILD_FAILED, F.col("raw"))), F.col("raw"))
    found = inside.withColumn("d", parsers.line_diagnostic(shown, "kernel")).where("d is not null")
    base, normal = F.concat(F.regexp_replace("dir", "/+\\z", ""), F.lit("/")), text.normal_path(F.col("d.file"))
    below = normal.startswith(base) & (F.length(normal) > F.length(base))
    file = F.when(below, F.substring(normal, F.length(base) + 1, F.length(normal))).otherwise(F.col("d.file"))
    cells = {"severity": F.col("d.severity"), "code": ascii_only(F.col("d.code")), "file": ascii_only(file), "line": F.col("d.line"), "column": F.col("d.column"), "message": ascii_only(F.col("d.message"))}
    first = lists.first_seen(found.select(*own, "n", *[c.alias(k) for k, c in cells.items()]), [*keys, *cells], ["stream", "n"])
    order = Window.partitionBy(*keys).orderBy("stream", "n")
    return first.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).select(*keys, "ordinal", *cells)


def watchdog_notes(logs: DataFrame, keys: list[str], *, log: str = "log") -> DataFrame:
    """(keys, note): the cores at work in each log's last complete dump, then their kernels; no row without such a dump.

    Whole lines up to a cap; how many are left out is said.
    """
    tail = text.last_bytes(F.col(log), TAIL_BYTES)
    lines = logs.select(*keys, F.posexplode(F.transform(F.split(tail, "\n", -1), lambda x: F.regexp_replace(x, "\r+\\z", ""))).alias("n", "raw"))
    dump = lists.last_complete(lines, keys, "n", _found(DUMP_BEGINS, F.col("raw")), _found(DUMP_ENDS, F.col("raw")))
    body = lines.join(dump, keys).where("n > first and n < last")
    ids = F.filter(F.transform(F.split(_found(CORE_IDS, F.col("raw")), r"\|"), lambda x: F.regexp_replace(F.trim(x), "^0+", "")), lambda x: x != "")
    body = body.withColumn("busy", F.coalesce(ids, F.array().cast("array<string>"))).withColumn("kernel", F.regexp_replace(_found(KERNEL, F.col("raw")), "^0+(?=.)", ""))
    whole = Window.partitionBy(*keys)
    body = body.withColumn("all_busy", F.flatten(F.collect_set("busy").over(whole)))
    kind = F.when(F.size("busy") > 0, 0).when(F.array_contains("all_busy", F.col("kernel")), 1)
    # A line that is both comes twice, among the cores and among the kernels.
    both = F.array_compact(F.array(F.when(F.size("busy") > 0, 0), F.when(F.array_contains("all_busy", F.col("kernel")), 1)))
    kept = body.where(kind.isNotNull()).withColumn("kind", F.explode(both)).select(*keys, "number", "kind", "n", ascii_only(parsers.right_trimmed(F.col("raw"))).alias("line"))
    order = Window.partitionBy(*keys).orderBy("kind", "n")
    head = F.concat(F.lit("Watcher dump #"), F.col("number"), F.lit(": "))
    left_out = lambda n: F.concat(F.lit("... "), n.cast("string"), F.lit(" more lines left out"))
    kept = kept.withColumn("k", F.row_number().over(order)).withColumn("of", F.count("*").over(whole))
    used = F.length(head) + F.sum(F.length("line") + 2).over(order)
    kept = kept.withColumn("used", used).withColumn("fits", F.min((F.col("used") + F.length(left_out(F.col("of") - F.col("k"))) <= NOTE_BYTES).cast("int")).over(order) == 1)
    kept = kept.withColumn("fits", F.col("fits") | (F.max("used").over(whole) - 2 <= NOTE_BYTES))
    said = kept.groupBy(*keys).agg(F.count("*").alias("of"), F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("k", "line")))).alias("shown"))
    out = dump.select(*keys, "number").join(said, keys, "left")
    rest = F.col("of") - F.size("shown")
    note = F.when(F.col("of").isNull(), "no core held a kernel").otherwise(F.concat_ws("; ", F.col("shown.line"), F.when(rest > 0, left_out(rest))))
    return out.select(*keys, F.concat(head, note).alias("note"))
