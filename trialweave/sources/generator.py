"""The seeded generator of input arrays, split so that many tasks draw parts of one array.

Each array has a stream of the published pcg32 generator of its own, chosen by its name. A congruential generator can be
put to any place of its stream in as many steps as the place has bits, so a block of draws needs no block before it:

- floats take a fixed number of draws each, so a block's elements follow from where it starts;
- integers are drawn by rejection, so where an element lies depends on all draws before. A first pass counts what each
  block of draws accepts, a window adds the counts up to where each block's elements belong, and a second pass places
  them. Streams that accept too little get further blocks until they have enough.

Blocks are computed with 64-bit unsigned arrays: the states of a block double in each step. An array comes as rows of
blocks (name, first, n, data); ``whole`` puts the blocks of arrays together that fit in a row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialweave.operators.graph import _kept
from trialweave.sources.array_codec import DTYPES, FLOATS, NAME, NUMPY

# The generator's multiplier, the longest name, the significant bits and the exponents of float formats.
MULTIPLIER = 6364136223846793005
MOST_NAME_BYTES = 247
LARGEST = {"f16": 65504.0, "bf16": float(2**127) * (2 - 2**-7), "f32": float(2**127) * (2 - 2**-23), "f64": 1.7976931348623157e308}
INTEGERS = {"i8": (-(1 << 7), (1 << 7) - 1), "u8": (0, (1 << 8) - 1), "i32": (-(1 << 31), (1 << 31) - 1), "u32": (0, (1 << 32) - 1), "i64": (-(1 << 63), (1 << 63) - 1)}
KEYS = {"name", "dtype", "shape", "dist", "lo", "hi"}
M64 = (1 << 64) - 1
BLOCK = 1 << 20


def stream_of(name: str) -> int:
    """The stream of an array: the first eight bytes of its name's hash, least first."""
    return int.from_bytes(hashlib.sha256(name.encode("ascii")).digest()[:8], "little")


def jump(n: int, inc: int) -> tuple[int, int]:
    """(a, c) with state * a + c the state n steps on."""
    a, c, step_a, step_c = 1, 0, MULTIPLIER, inc
    while n:
        if n & 1:
            a, c = a * step_a & M64, (c * step_a + step_c) & M64
        step_a, step_c = step_a * step_a & M64, (step_a + 1) * step_c & M64
        n >>= 1
    return a, c


def start_of(seed: int, stream: int) -> tuple[int, int]:
    """(state, increment) of a stream before its first draw."""
    inc = (stream << 1 | 1) & M64
    return ((inc + seed) * MULTIPLIER + inc) & M64, inc


def draws(seed: int, stream: int, first: int, n: int) -> np.ndarray:
    """The 32-bit draws ``first`` to ``first + n`` of a stream."""
    state, inc = start_of(seed, stream)
    a, c = jump(first, inc)
    s = np.empty(max(n, 1), np.uint64)
    s[0], have = (state * a + c) & M64, 1
    while have < n:  # the states so far, moved on by as many steps
        more = min(have, n - have)
        a, c = jump(have, inc)
        s[have : have + more] = s[:more] * np.uint64(a) + np.uint64(c)
        have += more
    s = s[:n]
    x = (((s >> np.uint64(18)) ^ s) >> np.uint64(27)).astype(np.uint32)
    r = (s >> np.uint64(59)).astype(np.uint32)
    return (x >> r) | (x << (-r & np.uint32(31)))


def wide_draws(seed: int, stream: int, first: int, n: int) -> np.ndarray:
    """64-bit draws of two 32-bit draws each, the first in the high half."""
    x = draws(seed, stream, 2 * first, 2 * n).astype(np.uint64)
    return (x[0::2] << np.uint64(32)) | x[1::2]


# Floats: rounded once from double to the format, half to even, and kept within [lo, hi).


def rounded(dtype: str, x: np.ndarray) -> np.ndarray:
    """Doubles in a float format; bf16 as its bits."""
    if dtype != "bf16":
        return x.astype(NUMPY[dtype])
    # Rounding twice would break ties wrongly: go to single precision toward zero, with the last bit set if anything was lost.
    single = x.astype("<f4")
    bits = single.view("<u4").copy()
    over = np.abs(single.astype(np.float64)) > np.abs(x)
    bits -= over.astype("<u4")
    bits |= (bits.view("<f4").astype(np.float64) != x).astype("<u4")
    bits = bits.astype(np.uint64)
    return ((bits + np.uint64(0x7FFF) + (bits >> np.uint64(16) & np.uint64(1))) >> np.uint64(16)).astype("<u2")


def as_double(dtype: str, x: np.ndarray) -> np.ndarray:
    return (x.astype("<u4") << np.uint32(16)).view("<f4").astype(np.float64) if dtype == "bf16" else x.astype(np.float64)


def next_to(dtype: str, x: np.ndarray, up: bool) -> np.ndarray:
    """The neighbouring values of a format, above or below."""
    if dtype != "bf16":
        return np.nextafter(x, np.array(np.inf if up else -np.inf, x.dtype))
    key = x.astype(np.int64)
    key = np.where(key >= 0x8000, -(key - 0x8000), key) + (1 if up else -1)
    return np.where(key < 0, 0x8000 - key, key).astype("<u2")


def edges(dtype: str, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """The least value of a format not below lo, and the largest below hi."""
    low, high = rounded(dtype, np.array([lo])), rounded(dtype, np.array([hi]))
    if as_double(dtype, low)[0] < lo:
        low = next_to(dtype, low, True)
    if as_double(dtype, high)[0] >= hi:
        high = next_to(dtype, high, False)
    return low, high


def uniform(seed: int, name: str, dtype: str, lo: float, hi: float, first: int, n: int) -> np.ndarray:
    """The elements ``first`` to ``first + n`` of a uniform array."""
    if dtype == "f64":
        u = (wide_draws(seed, stream_of(name), first, n) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    else:
        u = (draws(seed, stream_of(name), first, n) >> np.uint32(8)).astype(np.float64) * 2.0**-24
    out = rounded(dtype, lo + (hi - lo) * u)
    low, high = edges(dtype, lo, hi)
    value, least, most = as_double(dtype, out), as_double(dtype, low), as_double(dtype, high)
    return np.where(value < least, low, np.where(value > most, high, out)).astype(NUMPY[dtype])


# Integers: draws below the threshold are rejected.


def tries(seed: int, name: str, span: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(remainders, accepted) of the tries ``first`` to ``first + n`` at a number below span."""
    wide = span > 1 << 32
    x = (wide_draws if wide else draws)(seed, stream_of(name), first, n).astype(np.uint64)
    skip = (1 << (64 if wide else 32)) % span
    return (x if span == 1 << 64 else x % np.uint64(span)), x >= np.uint64(skip)


def share(span: int) -> float:
    size = 1 << (64 if span > 1 << 32 else 32)
    return (size - size % span) / size


def integers(dtype: str, lo: int, below: np.ndarray) -> np.ndarray:
    return (below + np.uint64(lo & M64)).astype(np.int64).astype(NUMPY[dtype]) if dtype != "u32" else (below + np.uint64(lo)).astype("<u4")


# The specification of inputs.


class SpecError(ValueError):
    """What is wrong with a specification; the message starts with where it stands."""


def check_spec(spec: Any, where: str) -> list[dict]:
    """The entries of a specification, or a SpecError for the first that breaks a rule."""
    if isinstance(spec, (str, bytes, Mapping)) or not isinstance(spec, (list, tuple)):
        raise SpecError(f"{where}: the input spec must be a sequence of mappings")
    seen: set[str] = set()
    for k, entry in enumerate(spec):
        _check_entry(entry, f"{where}: input spec entry {k}")
        if entry["name"] in seen:
            raise SpecError(f"{where}: input spec entry {k}: the name {entry['name']!r} is used twice")
        seen.add(entry["name"])
    return [dict(e) for e in spec]


def _check_entry(e: Any, where: str) -> None:
    def must(ok: bool, what: str) -> None:
        if not ok:
            raise SpecError(f"{where}: {what}")

    must(isinstance(e, Mapping), "is not a mapping")
    must(set(e) == KEYS, f"the keys must be exactly {sorted(KEYS)}; missing {sorted(KEYS - set(e))}, extra {sorted(map(str, set(e) - KEYS))}")
    name, dtype, dist, shape, lo, hi = (e[k] for k in ("name", "dtype", "dist", "shape", "lo", "hi"))
    must(isinstance(name, str) and name.isascii() and NAME.fullmatch(name.encode()) is not None, "the name is no array name")
    must(len(name) <= MOST_NAME_BYTES, f"the name is longer than {MOST_NAME_BYTES} bytes")
    must(isinstance(dtype, str) and dtype in DTYPES, f"unknown dtype {dtype!r}")
    must(dist in ("uniform", "integers"), f"unknown dist {dist!r}")
    must((dtype in FLOATS) == (dist == "uniform"), f"dist {dist} does not draw {dtype}")
    is_int = lambda x: isinstance(x, int) and not isinstance(x, bool)
    must(isinstance(shape, (list, tuple)) and all(is_int(d) and d >= 0 for d in shape), "the shape is no list of sizes")
    if dist == "integers":
        must(is_int(lo) and is_int(hi), "the bounds are no ints")
        least, most = INTEGERS[dtype]
        must(lo < hi, "lo must be below hi")
        must(least <= lo and hi - 1 <= most, f"[{lo}, {hi}) does not fit {dtype}")
        return
    for x in (lo, hi):
        must(isinstance(x, (int, float)) and not isinstance(x, bool), "a bound is no number")
        must(not isinstance(x, int) or (abs(x) < 1 << 1024 and int(float(x)) == x), "a bound is not exactly a double")
    lo, hi = float(lo), float(hi)
    must(math.isfinite(lo) and math.isfinite(hi), "the bounds must be finite")
    must(lo < hi, "lo must be below hi")
    must(max(abs(lo), abs(hi)) <= LARGEST[dtype], f"the bounds reach past the finite range of {dtype}")
    must(math.isfinite(hi - lo), "hi - lo overflows a double")
    low, high = (as_double(dtype, v)[0] for v in edges(dtype, lo, hi))
    must(low <= high, f"no {dtype} value lies in the bounds")


# The jobs.

SPEC = "name string, dtype string, shape array<long>, dist string, lo string, hi string"
BLOCKS = "name string, first long, n long, data binary"


def spec_table(spark: SparkSession, spec: Iterable[Mapping[str, Any]], where: str = "spec") -> DataFrame:
    """A checked specification as a table; bounds are kept as text, since they may be wider than any number of SQL."""
    rows = [(e["name"], e["dtype"], [int(d) for d in e["shape"]], e["dist"], repr(e["lo"]), repr(e["hi"])) for e in check_spec(list(spec), where)]
    return spark.createDataFrame(rows, SPEC)


def _blocks(df: DataFrame, count, block: int) -> DataFrame:
    """A row for each block of ``count`` draws or elements, dealt out (by number, since rows this small would be put together again)."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest((count - 1).cast("long"), F.lit(0)), F.lit(block).cast("long")))
    out = df.withColumn("count", count.cast("long")).withColumn("first", starts).withColumn("n", F.least(F.lit(block).cast("long"), F.col("count") - F.col("first")))
    return out.drop("count").repartition(tasks, "name", "first")


def generate(spec: DataFrame, seed: int, *, block: int = BLOCK) -> DataFrame:
    """(name, first, n, data): the arrays of a table of specifications, in blocks of elements with where they begin.

    Equal to drawing each array from its stream one element after the other, whatever the block.
    """
    if isinstance(seed, bool) or not isinstance(seed, int) or not 0 <= seed <= M64:
        raise ValueError("the seed must be an int of 64 bits without sign")
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, d: a * d)
    sized = spec.withColumn("size", size)

    def floats(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = uniform(seed, r["name"], r["dtype"], float(r["lo"]), float(r["hi"]), r["first"], r["n"])
                yield _row(r["name"], r["first"], r["n"], x)

    drawn = _blocks(sized.where("dist = 'uniform'"), F.col("size"), block).select("name", "dtype", "lo", "hi", "first", "n").mapInArrow(floats, BLOCKS)
    return drawn.unionByName(_integers(sized.where("dist = 'integers'"), seed, block))


def _row(name: str, first: int, n: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([name]), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["name", "first", "n", "data"])


def _integers(spec: DataFrame, seed: int, block: int) -> DataFrame:
    span = F.udf(lambda lo, hi: share(int(hi) - int(lo)), "double")  # (a row an array)
    left = _kept(spec.withColumn("share", span("lo", "hi")).withColumn("tried", F.lit(0).cast("long")).withColumn("have", F.lit(0).cast("long")))
    counted = []
    kind = "name string, dtype string, lo string, hi string, size long, first long, n long, accepted long"

    def count(batches):
        for batch in batches:
            rows = batch.to_pylist()
            got = [int(tries(seed, r["name"], int(r["hi"]) - int(r["lo"]), r["first"], r["n"])[1].sum()) for r in rows]
            yield pa.record_batch([*(batch[c] for c in ("name", "dtype", "lo", "hi", "size", "first", "n")), pa.array(got, pa.int64())], names=["name", "dtype", "lo", "hi", "size", "first", "n", "accepted"])

    while not left.isEmpty():
        # As many tries as are needed on average and some more; who is short of elements tries again.
        need = F.ceil((F.col("size") - F.col("have")) / F.col("share") + 8 * F.sqrt(F.col("size") - F.col("have") + 1)).cast("long")
        tries_of = _blocks(left.withColumn("need", need), F.col("need"), block).withColumn("first", F.col("first") + F.col("tried"))
        now = _kept(tries_of.select("name", "dtype", "lo", "hi", "size", "first", "n").mapInArrow(count, kind))
        counted.append(now)
        gained = now.groupBy("name").agg(F.sum("accepted").alias("got"), F.sum("n").alias("more"))
        left = _kept(left.join(gained, "name").withColumn("have", F.col("have") + F.col("got")).withColumn("tried", F.col("tried") + F.col("more")).where("have < size").drop("got", "more"))
    every = counted[0] if counted else spec.select("name", "dtype", "lo", "hi", "size").withColumn("first", F.lit(0).cast("long")).withColumn("n", F.lit(0).cast("long")).withColumn("accepted", F.lit(0).cast("long"))
    for more in counted[1:]:
        every = every.unionByName(more)
    before = F.sum("accepted").over(Window.partitionBy("name").orderBy("first")) - F.col("accepted")
    placed = every.withColumn("place", before).where("place < size or (size = 0 and first = 0)").repartition(int(spec.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name", "first")

    def place(batches):
        for batch in batches:
            for r in batch.to_pylist():
                below, ok = tries(seed, r["name"], int(r["hi"]) - int(r["lo"]), r["first"], r["n"])
                x = integers(r["dtype"], int(r["lo"]), below[ok][: r["size"] - r["place"]])
                if len(x) or not r["size"]:  # a block may accept nothing
                    yield _row(r["name"], r["place"], len(x), x)

    return placed.select("name", "dtype", "lo", "hi", "size", "first", "n", "place").mapInArrow(place, BLOCKS)


def whole(spec: DataFrame, seed: int, *, block: int = BLOCK) -> DataFrame:
    """(name, dtype, shape, data) of arrays that fit in a row."""
    parts = generate(spec, seed, block=block).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("first", "data"))).alias("p"))
    data = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    return spec.select("name", "dtype", "shape").join(parts, "name").select("name", "dtype", "shape", data.alias("data"))
