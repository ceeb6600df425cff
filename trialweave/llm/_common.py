"""What several operators share: the shared folder, word splitting, hashing and blob packing."""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.session import shared_dir

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None

#: ASCII white space that separates words, as a regular expression for Java and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives a lost executor."""
    path = shared_dir(df.sparkSession)
    (df.select(*cols) if cols else df).write.parquet(path)
    return df.sparkSession.read.schema((df.select(*cols) if cols else df).schema).parquet(path)


def whole_row(df: DataFrame):
    """All columns as one struct, so that what is added beside it clashes with no name."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


#: Plans whose size in bytes the optimizer knows: a relation, and what takes columns or rows from it.
_SIZED = {"Project", "Filter", "LogicalRelation", "SubqueryAlias", "RepartitionByExpression", "Repartition", "Sample"}


def _is_sized(plan) -> bool:
    children = plan.children()
    return plan.nodeName().split("(")[0] in _SIZED | {"Relation"} and all(_is_sized(children.apply(i)) for i in range(children.size()))


def estimated_bytes(df: DataFrame) -> int:
    """The bytes of ``df``: the optimizer's size where it only takes from a stored table, else those of its strings by a scan.

    A join's size is estimated as the product of its sides, so it is never asked for.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if _is_sized(plan):
        size = int(str(plan.stats().sizeInBytes()))
        if size < 1 << 50:
            return size
    text = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    row = df.agg(*[F.sum(F.octet_length(c)) for c in text], F.count("*")).first()
    return sum(x or 0 for x in row[:-1]) + 8 * len(df.columns) * row[-1]


def groups_for(df: DataFrame, mb: int = 8, least: int = 12, blob: int = 0) -> int:
    """How many groups hold about ``mb`` MB of input each; grows with the input.

    With ``blob``, groups send as many parts as there are groups: then they grow with the square root of the input, so
    that a part has ``blob`` bytes of input at least.
    """
    size = estimated_bytes(df)
    return max(least, math.ceil(size / max(mb << 20, math.isqrt(size * blob))))


def one_array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def _split(column, lower: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of all texts (null: empty), and where each text begins; ``lower`` changes A-Z alone."""
    texts = pc.fill_null(one_array(column).cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0] if len(off) else np.zeros(1, np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        flat = flat.filter(pa.array(full))
        off = np.concatenate([[0], np.cumsum(full)])[off]
    return flat.dictionary_encode(), off


def split_words(column, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the word number at each position of all texts, and where each text begins."""
    coded, off = _split(column, lower)
    return _as_list(coded.dictionary.cast(pa.binary())), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), off


def _as_list(words: pa.BinaryArray) -> list[bytes]:
    """As to_pylist() of an array without nulls, by slices of its buffer."""
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    raw = words.buffers()[2].to_pybytes() if words.buffers()[2] else b""
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def split_hashes(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As split_words, with the hashes of the distinct words in place of the words."""
    coded, off = _split(column, lower)
    return hashes(coded.dictionary.cast(pa.binary())), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), off


def word_hashes(words: list[bytes]) -> np.ndarray:
    return hashes(pa.array(words, pa.binary()))


def hashes(words: pa.BinaryArray) -> np.ndarray:
    """64-bit hashes of byte strings: eight bytes of all of them at a time; of those above 512 bytes one by one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    start, size = ends[:-1], np.diff(ends)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: ends[-1]]
    data = np.concatenate([raw, np.zeros(8, np.uint8)])
    out, rows, step = mixed(size.astype(np.uint64), 21), np.flatnonzero((size > 0) & (size <= 512)), 0
    while len(rows):
        left = np.minimum(size[rows] - step, 8).astype(np.uint64)
        part = data[(start[rows] + step)[:, None] + np.arange(8)].view("<u8").ravel() & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[rows] = mixed(out[rows] ^ part, 22 + step)
        step += 8
        rows = rows[size[rows] > step]
    for i in np.flatnonzero(size > 512).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]].tobytes())
    return out


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), so that every bit depends on all bits of x and the seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_STEP = 1 << 16


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; kept while they are small."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(2 * _STEP, n)
        have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        if size == 2 * _STEP:
            _POWERS[base] = have
    return have


def rolling(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each h[i:i+k], for all i where k values are left."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    up, down = _powers(base, min(_STEP, len(out)) + k)
    for i in range(0, len(out), _STEP):
        n = min(_STEP, len(out) - i)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[i : i + n + k - 1] * up[: n + k - 1], dtype=np.uint64)])
        out[i : i + n] = mixed((total[k:] - total[:-k]) * down[:n])
    return out


def released() -> None:
    """Give back to the system what Arrow and the allocator keep: idle workers would hold it beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def inside(off: np.ndarray, k: int) -> np.ndarray:
    """For each start of a window of k words in the joined texts, whether it ends in the same text."""
    n = int(off[-1]) if len(off) else 0
    if n < k:
        return np.zeros(0, bool)
    ok = np.zeros(n + 1, np.int32)
    long = np.diff(off) >= k
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, off[1:][long] - k + 1, -1)
    return np.cumsum(ok)[: n - k + 1] > 0


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of values in each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def exact_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """As sums(), but each text is added up alone, so a text's sum does not depend on its neighbours."""
    out = np.zeros(len(off) - 1)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full])
    return out


# Keys of 40 bits within one of n buckets: (bucket << 40) | key sorts by bucket, then key.
LOW40 = np.uint64((1 << 40) - 1)


def bucketed(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(40)) % np.uint64(n)) << np.uint64(40)) | (h & LOW40)


def bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket begins in sorted keys."""
    return np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(40))


def pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte plane by byte plane (sorted keys and small counts compress well so)."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> bytes:
    """Keys of 40 bits in one bucket, in order: their differences, byte plane by byte plane."""
    keys = keys & LOW40
    return pack(np.diff(keys, prepend=np.uint64(0)), 5)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, 5), dtype=np.uint64)


_ZSTD = pa.Codec("zstd", compression_level=1)


def frame(*parts: bytes) -> bytes:
    """Several byte strings in one, compressed."""
    data = np.array([len(parts), *map(len, parts)], "<u8").tobytes() + b"".join(parts)
    return np.array([len(data)], "<u8").tobytes() + _ZSTD.compress(data, asbytes=True)


def unframe(data: bytes) -> list[bytes]:
    data = _ZSTD.decompress(memoryview(data)[8:], int(np.frombuffer(data, "<u8", 1)[0]), asbytes=True)
    n = int(np.frombuffer(data, "<u8", 1)[0])
    sizes = np.frombuffer(data, "<u8", n, 8)
    ends = 8 + 8 * n + np.cumsum(sizes).astype(int)
    return [data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


BLOB = "g int, b int, x binary"
BLOB_TYPE = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("x", pa.binary())])
#: The least input behind a blob, see groups_for.
BLOB_BYTES = 16 << 10


def _blobs(g: list[int], b: list[int], x: list[bytes]) -> pa.Table:
    return pa.table([pa.array(g, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.binary())], schema=BLOB_TYPE)


def _labels(n: int) -> list[int]:
    """n numbers that hash partitioning (32-bit Murmur3 of an int, seed 42) puts into n partitions, one into each."""
    x = np.arange(40 * n + 400, dtype=np.uint32)
    turn = lambda v, k: (v << np.uint32(k)) | (v >> np.uint32(32 - k))
    h = turn(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
    h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    part, first = np.unique(h.astype(np.int32) % n, return_index=True)
    return first.tolist() if len(part) == n else list(range(n))


def in_groups(docs: DataFrame, n: int, *keys: str) -> DataFrame:
    """Deal rows out to n groups by the hash of their keys, up to 4,096 of them each to a partition of its own."""
    g = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    if n <= 4096:
        g = F.element_at(F.lit(_labels(n)), g + 1)
    return docs.withColumn("g", g.cast("int")).repartition(n, "g")


def _reducer(reduce, order: dict[int, int]):
    def run(key, table):
        rows = sorted(zip(table["g"].to_pylist(), table["x"].to_pylist(), strict=True))
        out = _blobs([g for g, _ in rows], [order[key[0].as_py()]] * len(rows), reduce([g for g, _ in rows], [x for _, x in rows]))
        released()
        return out

    return run


def in_rounds(t: DataFrame, n: int, rounds: list, final, schema: str) -> DataFrame:
    """Rounds of questions from every group of documents to n hash buckets, with answers, then a result a group.

    A round is (emit, reduce): ``emit(table, answers)`` makes n blobs, one for each bucket; ``reduce(groups, blobs)``
    sees one bucket's blobs of all groups and answers each with a blob. ``answers`` has, for each round before, the
    answers in bucket order; ``final(table, answers)`` makes the rows. A group's question names each key once, so a
    bucket never holds more than one entry of a key from each group. The shuffled texts are one exchange, read once a
    round and at the end.
    """
    told: list[DataFrame] = []
    labels = _labels(n) if n <= 4096 else list(range(n))

    def asking(emit):
        def blobs(key, table, answers):
            return _blobs([key[0].as_py()] * n, labels, _tidy(emit, table, answers))

        return (lambda key, table, right: blobs(key, table, lists(right))) if told else lambda key, table: blobs(key, table, [])

    def lists(right):
        return [right[f"a{k}"].combine_chunks().values.to_pylist() for k in range(right.num_columns - 1)]

    def answered():
        # Each round's answers are one exchange, whatever rounds read them; a group's answers are one row.
        both = told[0]
        for a in told[1:]:
            both = both.join(a.hint("merge"), "g")
        return t.groupBy("g").cogroup(both.groupBy("g"))

    order = {b: i for i, b in enumerate(labels)}
    for k, (emit, reduce) in enumerate(rounds):
        asked = answered().applyInArrow(asking(emit), BLOB) if told else t.groupBy("g").applyInArrow(asking(emit), BLOB)
        answer = asked.repartition(n, "b").groupBy("b").applyInArrow(_reducer(reduce, order), BLOB).repartition(n, "g")
        # (The filter is the one that the joins below would add: with it everywhere, the exchange is the same everywhere.)
        answer = answer.where("g is not null").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("b", "x"))).alias("all")).select("g", F.col("all.x").alias(f"a{k}"))
        told.append(answer)
    return answered().applyInArrow(lambda key, table, right: _tidy(final, table, lists(right)), schema)


def _tidy(f, *args):
    out = f(*args)
    released()
    return out
