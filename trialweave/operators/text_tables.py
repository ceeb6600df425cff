"""Tables out of text that was laid out in columns by spaces.

A block is a run of lines that are not blank. Its columns are found without knowing their names: a place belongs to a gap
if every line of the block is blank there, so column boundaries are where all lines' gaps meet. Gaps are intervals; where
they all overlap comes from one sweep over their ends. A line without a first cell goes on with the row above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The least width of a gap between columns.
GAP = 2


def _by(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """A join by columns of one name, where null equals null."""
    other = b.select(*[F.col(n).alias(f"__of_{n}") if n in names else F.col(n) for n in b.columns])
    on = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__of_{n}")) for n in names])
    return a.join(other, on).drop(*[f"__of_{n}" for n in names])


def blocks(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, block, line, raw): the lines of ``texts`` that are not blank, numbered by blocks; tabs count as spaces to the next eighth place."""
    lines = texts.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n", -1)).alias("line", "raw"))
    spread = lambda s: F.aggregate(F.split(s, "\t", -1), F.lit(None).cast("string"), lambda a, p: F.when(a.isNull(), p).otherwise(F.concat(F.rpad(a, ((F.floor(F.length(a) / 8) + 1) * 8).cast("int"), F.lit(" ")), p)))
    w = Window.partitionBy(*keys).orderBy("line")
    blank = F.trim("raw") == ""
    numbered = lines.withColumn("raw", F.rtrim(spread(F.col("raw")))).withColumn("block", F.sum(blank.cast("int")).over(w))
    return numbered.where(~blank).select(*keys, "block", "line", "raw")


def columns(lines: DataFrame, keys: list[str], gap: int = GAP) -> DataFrame:
    """(keys, block, column, begin, end): the columns of each block, begin counted from 0, end not included."""
    own = [*keys, "block"]
    size = lines.groupBy(*own).agg(F.count("*").alias("lines"), F.max(F.length("raw")).alias("width"))
    # A line's gaps: its runs of spaces, and all that is right of its end.
    cut = F.array().cast("array<int>")
    runs = F.split("raw", "(?<= )(?! )|(?<! )(?= )")
    ends = F.aggregate(runs, cut, lambda a, r: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(r))))
    pieces = F.filter(F.transform(F.arrays_zip(runs.alias("run"), ends.alias("end")), lambda x: F.struct((x["end"] - F.length(x["run"])).alias("begin"), x["end"].alias("end"), x["run"].startswith(" ").alias("gap"))), lambda x: x["gap"])
    tail = F.array(F.struct(F.length("raw").alias("begin"), F.lit(1 << 30).alias("end"), F.lit(True).alias("gap")))
    events = lines.select(*own, F.explode(F.concat(pieces, tail)).alias("g")).select(*own, F.explode(F.array(F.struct(F.col("g.begin").alias("at"), F.lit(1).alias("d")), F.struct(F.col("g.end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(*own, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*own).orderBy("at")
    open_ = steps.withColumn("open", F.sum("d").over(w)).withColumn("until", F.lead("at").over(w))
    # Where all lines are in a gap: neighbouring pieces are one gap, narrow ones part no columns.
    shared = _by(open_, size, own).where("open = lines").withColumn("new", F.coalesce(F.lag("until").over(w) != F.col("at"), F.lit(True)))
    gaps = shared.withColumn("n", F.sum(F.col("new").cast("int")).over(w)).groupBy(*own, "width", "n").agg(F.min("at").alias("begin"), F.max("until").alias("end"))
    # (A margin on the left is a gap of any width.)
    gaps = gaps.where((F.col("end") - F.col("begin") >= gap) | (F.col("begin") == 0))
    margin = size.select(*own, "width", F.lit(0).cast("long").alias("n"), F.lit(0).alias("begin"), F.lit(0).alias("end"))
    every = gaps.select(*own, "width", "n", "begin", "end").unionByName(margin)
    w2 = Window.partitionBy(*own).orderBy("end", "begin")
    cells = every.withColumn("stop", F.lead("begin").over(w2)).select(*own, F.col("end").alias("begin"), F.coalesce("stop", "width").alias("end")).where("end > begin")
    return cells.withColumn("column", (F.row_number().over(Window.partitionBy(*own).orderBy("begin")) - 1).cast("int")).select(*own, "column", "begin", "end")


def cells(texts: DataFrame, keys: list[str], text: str = "text", gap: int = GAP) -> DataFrame:
    """(keys, block, row, column, cell): the cells of all tables in the texts; an empty cell is null, wrapped ones are joined by a space."""
    lines = blocks(texts, keys, text)
    own = [*keys, "block"]
    at = columns(lines, keys, gap)
    each = _by(lines, at, own).withColumn("cell", F.nullif(F.trim(F.substring("raw", F.col("begin") + 1, F.col("end") - F.col("begin"))), F.lit("")))
    starts = each.where("column = 0").select(*own, "line", F.col("cell").isNotNull().alias("starts"))
    w = Window.partitionBy(*own).orderBy("line")
    rows = starts.withColumn("row", F.greatest(F.sum(F.col("starts").cast("int")).over(w), F.lit(1)) - 1).drop("starts")
    whole = _by(each, rows, [*own, "line"]).groupBy(*own, "row", "column").agg(F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("line", "cell")))).alias("parts"))
    return whole.select(*own, F.col("row").cast("long").alias("row"), "column", F.nullif(F.array_join("parts.cell", " "), F.lit("")).alias("cell"))
