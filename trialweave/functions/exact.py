"""Sums of doubles that are exact until they are rounded once, so they are the same in any order and on any partitioning.

A double is cut into three integers of 32 bits, each the content of one bin; bin b counts in units of 2**(32 b). Bins are
integers, so they add up exactly, before the shuffle and after it, by expressions alone. At the end the bins of a group, of
which there are some 70 at most, are put together and rounded to the nearest double, half to even, by an Arrow UDF that
sees one row a group.

As with sums of doubles, infinities of one sign give that infinity, of both signs or with a NaN they give NaN; nulls are
left out, and a group without values has a null sum.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.session import shared_dir

BASE = 1 << 32
#: Bins of values that are no numbers to add: infinities and NaN.
PLUS, MINUS, NAN = 1000, 1001, 1002
_WIDE = "decimal(38,0)"


def _scaled(x: Column, power: Column) -> Column:
    """x times two to a power, in two steps, as either factor alone may be out of range."""
    half = F.floor(power / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def _finite(v: Column) -> Column:
    return F.abs(v) < float("inf")


def _limbs(df: DataFrame, values: dict[str, Column], kept: list[str]) -> DataFrame:
    """``kept``, and for value i: __v the value, __w0 to __w2 its limbs, __t the first one's bin or that of no number; null for null.

    What one step computes, the next names, so that no expression is repeated.
    """
    names, col = list(values), lambda k, i: F.col(f"__{k}{i}")
    n = range(len(names))
    d = df.select(*kept, *[values[x].cast("double").alias(f"__v{i}") for i, x in enumerate(names)])
    d = d.withColumns({f"__t{i}": F.floor(F.floor(F.log2(F.nullif(F.abs(col("v", i)), F.lit(0.0)))) / 32).cast("int") for i in n})
    d = d.withColumns({f"__t{i}": F.when(_finite(col("v", i)), F.coalesce(col("t", i), F.lit(0))) for i in n})
    d = d.withColumns({f"__y0{i}": _scaled(col("v", i), F.lit(-32) * col("t", i)) for i in n})
    for k in range(3):
        d = d.withColumns({f"__w{k}{i}": col(f"y{k}", i).cast("long") for i in n})
        d = d.withColumns({f"__y{k + 1}{i}": (col(f"y{k}", i) - col(f"w{k}", i).cast("double")) * F.lit(float(BASE)) for i in n})
    odd = lambda v: F.when(F.isnan(v), NAN).when(v == float("inf"), PLUS).when(v == float("-inf"), MINUS)
    return d.withColumns({f"__t{i}": F.coalesce(col("t", i), odd(col("v", i))) for i in n})


def _nearest(bins: list[tuple[int, int]]) -> float | None:
    """The double nearest to a sum of bins: the quotient of two integers is rounded once."""
    if not bins:
        return None
    special = {b for b, _ in bins if b >= PLUS}
    if special:
        return math.nan if NAN in special or len(special) > 1 else math.inf if PLUS in special else -math.inf
    low = min(0, *(b for b, _ in bins))
    total = sum(v << 32 * (b - low) for b, v in bins)
    try:
        return total / (1 << -32 * low)
    except OverflowError:
        return math.copysign(math.inf, total)


@F.arrow_udf(T.DoubleType())
def rounded_sum(of: pa.Array) -> pa.Array:
    """One number a group: its bins, added up without a limit and rounded."""
    return pa.array([_nearest([(c["bin"], int(c["value"])) for c in cells]) for cells in of.to_pylist()], pa.float64())


def exact_sums(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, one sum for each of ``values``): a row a group; what a task has of a group is added up before the shuffle.

    Rows of a group whose values begin in the same bins are added up limb by limb, each limb in two halves, which longs
    hold for 2**46 rows.
    """
    names = list(values)
    col = lambda k, i: F.col(f"__{k}{i}")
    n, ks = range(len(names)), range(3)
    d = _limbs(df, values, keys)
    halves = {f"__{h}{k}{i}": f(F.when(_finite(col("v", i)), col(f"w{k}", i))) for i in n for k in ks for h, f in (("a", lambda w: F.shiftright(w, 16)), ("b", lambda w: w.bitwiseAND(0xFFFF)))}
    bins = d.groupBy(*keys, *[f"__t{i}" for i in n]).agg(*[F.sum(h).alias(x) for x, h in halves.items()])
    whole = lambda k, i: col(f"a{k}", i).cast("decimal(38,0)") * 65536 + col(f"b{k}", i)
    limb = lambda b, v: F.struct(b.cast("int").alias("bin"), v.cast(_WIDE).alias("value"))
    cells = lambda i: F.when(col("t", i) >= PLUS, F.array(limb(col("t", i), F.lit(1)))).when(col("t", i).isNotNull(), F.array(*[limb(col("t", i) - k, whole(k, i)) for k in ks]))
    lists = bins.groupBy(*keys).agg(*[F.flatten(F.collect_list(cells(i))).alias(f"__c{i}") for i in n])
    return lists.select(*keys, *[rounded_sum(F.col(f"__c{i}")).alias(x) for i, x in enumerate(names)])


def exact_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean): the exact sum, rounded, by the number of values; null where a value is null."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count(value).alias("__k"))
    return _beside(n, exact_sums(df, keys, {"__s": F.col(value)}), keys).select(*keys, F.when((F.col("__n") == F.col("__k")) & (F.col("__n") > 0), F.col("__s") / F.col("__n")).alias("mean"))


def _kept(df: DataFrame) -> DataFrame:
    """One row a group, written to the shared folder and read back: made once, and joined as its size asks for."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' columns by keys, null keys too; without keys, one row each."""
    other = b.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return a.join(other, on).drop(*[f"__of_{k}" for k in keys])


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, pcc): 1 where both sides are equal throughout, 0 where one is constant, else the correlation by exact sums.

    Each side is scaled by a power of two first, so that no square leaves the range. Groups are joined to their rows, so
    a group's rows meet one row of facts; pairs with a null side are left out.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(*keys, a.alias("__x"), b.alias("__y")).where("__x is not null and __y is not null")
    facts = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.bool_and(F.col("__x") == F.col("__y")).alias("__same"), *[f(f"__{c}").alias(f"__{f.__name__}{c}") for c in "xy" for f in (F.min, F.max)])
    scale = lambda c: F.coalesce(F.floor(F.log2(F.nullif(F.greatest(F.abs(F.col(f"__min{c}")), F.abs(F.col(f"__max{c}"))), F.lit(0.0)))) + 1, F.lit(0))
    facts = _kept(facts.select(*keys, "__n", "__same", ((F.col("__minx") == F.col("__maxx")) | (F.col("__miny") == F.col("__maxy"))).alias("__flat"), scale("x").alias("__px"), scale("y").alias("__py")))
    sums = exact_sums(_beside(rows, facts.select(*keys, "__px", "__py"), keys), keys, {"__sx": _scaled(F.col("__x"), -F.col("__px")), "__sy": _scaled(F.col("__y"), -F.col("__py"))})
    known = _kept(_beside(facts, sums, keys).withColumn("__mx", F.col("__sx") / F.col("__n")).withColumn("__my", F.col("__sy") / F.col("__n")))
    moved = _beside(rows, known.select(*keys, "__px", "__py", "__mx", "__my"), keys)
    dx, dy = _scaled(F.col("__x"), -F.col("__px")) - F.col("__mx"), _scaled(F.col("__y"), -F.col("__py")) - F.col("__my")
    squares = exact_sums(moved, keys, {"__xx": dx * dx, "__yy": dy * dy, "__xy": dx * dy})
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("__xy") / F.sqrt(F.col("__xx") * F.col("__yy"))))
    value = F.when(F.col("__same"), 1.0).when(F.col("__flat") | (F.col("__xx") == 0) | (F.col("__yy") == 0), 0.0).otherwise(r)
    return _beside(known.select(*keys, "__same", "__flat"), squares, keys).select(*keys, value.alias("pcc"))
