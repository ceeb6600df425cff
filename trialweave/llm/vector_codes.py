"""Product codes of vectors, assigned by VA-file filtering.

A component x becomes the integer floor(1024 x); vectors are cut into equal consecutive parts. Each part position has a
codebook of integer entries, fitted by a few rounds of k-means over all vectors. A part finds its nearest entry as in a
vector approximation file: the entries' coordinates are quantised to ``bits`` bits, so an entry is a cell number in each
dimension; a query computes two small tables, the least and the largest squared distance to each cell of each dimension,
and adds them up by the entries' cell numbers to a lower and an upper bound of each entry's distance. Only entries whose
lower bound does not lie above the least upper bound are refined by integer distances, of which the least wins, the lower
index on ties. Bounds are floats with a margin above their rounding, so the result is exact.

A round is one job: tasks assign their vectors and send one sum for each entry and dimension, in 32-bit limbs, so sums are
exact at any size. Only codebooks (parts x entries x dimensions) pass the driver; vectors are never shuffled.

Defined cases: vectors that are null or hold null or non-finite components are dropped; shorter vectors are taken as
filled with zeros to the longest length, rounded up to whole parts; fewer vectors than entries make a smaller codebook; of
equal ids the lesser vector comes first, null ids come last; integers of any size are compared exactly, an error or a sum
of errors above the largest long is given as that; repeated rows are separate vectors; an empty table gives no rows. Only
the columns named are used, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm._common import released, written
from trialweave.llm.components import looked_up

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BITS = 4
BLOCK = 2048
#: Integers up to this are computed with in 64 bits, others in Python's.
SMALL = 1 << 24
LIMB = 32
MOST = (1 << 63) - 1


def is_finite(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x), as 64-bit integers, or as Python's where one is large."""
    x = values.astype(np.float64)
    if not len(x) or np.abs(x).max() <= SMALL / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([math.floor(v * scale) if abs(v) < 1e15 else int(v) * scale for v in x.tolist()], object)


class VaFile:
    """The entries of one codebook (entries x dimensions) by the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, (n, d), cells = entries, entries.shape, 1 << bits
        self.fits = entries.dtype != object and d < 4096
        if not self.fits or not n or not d:
            return
        rank = np.minimum(np.arange(n) * cells // n, cells - 1)
        order = np.argsort(entries, axis=0, kind="stable")
        cell = np.zeros((n, d), np.int64)
        # Cells hold about equally many entries each; what a cell spans is the range of its own entries.
        self.low, self.high = np.full((d, cells), np.inf), np.full((d, cells), -np.inf)
        for j in range(d):
            cell[order[:, j], j] = rank
            np.minimum.at(self.low[j], cell[:, j], entries[:, j])
            np.maximum.at(self.high[j], cell[:, j], entries[:, j])
        empty = np.isinf(self.low)
        self.low[empty] = self.high[empty] = 0
        # Adding up a query's table entries by cell numbers is a product with this matrix of zeros and ones.
        self.member = np.zeros((d * cells, n), np.float32)
        self.member[(np.arange(d) * cells + cell).T.ravel(), np.tile(np.arange(n), d)] = 1

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Which entries (columns) may be nearest to each query (rows)."""
        x = queries[:, :, None].astype(np.float64)
        under, over = self.low - x, x - self.high
        least = np.maximum(np.maximum(under, over), 0) ** 2
        most = np.maximum(-under, -over) ** 2
        lower = least.reshape(len(x), -1).astype(np.float32) @ self.member
        upper = most.reshape(len(x), -1).astype(np.float32) @ self.member
        return lower * np.float32(1 - 2e-4) <= upper.min(axis=1, keepdims=True) * np.float32(1 + 2e-4)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each query, and its squared distance."""
        n, d = self.entries.shape
        if not d:
            return np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        if not self.fits or queries.dtype == object:
            return self._by_all(queries)
        best, dist = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for i in range(0, len(queries), BLOCK):
            q = queries[i : i + BLOCK]
            at, entry = np.nonzero(self.candidates(q))  # by query, then by entry; every query has one at least
            got = np.concatenate([((q[at[k : k + (1 << 16)]] - self.entries[entry[k : k + (1 << 16)]]) ** 2).sum(axis=1) for k in range(0, len(at), 1 << 16)])
            first = np.searchsorted(at, np.arange(len(q)))
            dist[i : i + len(q)] = np.minimum.reduceat(got, first)
            hit = np.flatnonzero(got == dist[i + at])
            best[i : i + len(q)] = entry[hit[np.searchsorted(at[hit], np.arange(len(q)))]]
        return best, dist

    def _by_all(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to all entries in Python's integers: large components have no bounds in floats."""
        c = self.entries.astype(object)
        best, dist = [], []
        for q in queries.astype(object):
            of = ((c - q) ** 2).sum(axis=1)
            best.append(int(np.argmin(of)))
            dist.append(int(of[best[-1]]))
        return np.array(best, np.int64), np.array(dist, object)


def _parts(column, width: int, parts: int, scale: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """The parts of all vectors of a column as integers, by kind of integer: (row numbers, a matrix for each part)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, sizes = len(column), np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((n, width))
    x[np.arange(width) < sizes[:, None]] = flat
    large = (np.abs(x) > SMALL / scale).any(axis=1) if width else np.zeros(n, bool)
    out = []
    for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
        if len(rows):
            whole = integers(x[rows].ravel(), scale).reshape(len(rows), width)
            out.append((rows, np.split(whole, parts, axis=1)))
    return out


def _entries(book: list[list[int]]) -> np.ndarray:
    small = all(abs(v) <= SMALL for e in book for v in e)
    return np.array(book, np.int64 if small else object).reshape(len(book), -1)


def _limbs(total) -> list[list[int]]:
    """Integers by limbs of 32 bits, the last of them signed."""
    out, left = [], [int(v) for v in total]
    while any(left):
        out.append([v & ((1 << LIMB) - 1) for v in left])
        left = [v >> LIMB for v in left]
        if all(-(1 << LIMB) < v < 1 << LIMB for v in left):
            out.append(left)
            break
    return out or [left]


SUMS = "part int, entry int, n long, limb int, sums array<long>"


def _round(kept: DataFrame, books: list, width: int, scale: int, bits: int) -> list:
    """One round: assign all parts, then replace each entry that is used by the floor of its parts' mean."""
    parts = len(books)

    def run(batches):
        files = [VaFile(_entries(b), bits) for b in books]
        n = np.zeros((parts, len(books[0])), np.int64)
        total = np.zeros((parts, len(books[0]), width // parts), np.int64)
        large: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, cut in _parts(batch["embedding"], width, parts, scale):
                for p, q in enumerate(cut):
                    best, _ = files[p].nearest(q)
                    n[p] += np.bincount(best, minlength=n.shape[1])
                    if q.dtype == object:
                        for e, v in zip(best.tolist(), q, strict=True):
                            large[p, e] = large.get((p, e), 0) + v
                    else:
                        order = np.argsort(best, kind="stable")
                        used, first = np.unique(best[order], return_index=True)
                        total[p, used] += np.add.reduceat(q[order], first, axis=0)
        rows = []
        for p, e in zip(*(x.tolist() for x in np.nonzero(n)), strict=True):
            whole = total[p, e] + large[p, e] if (p, e) in large else total[p, e]
            rows += [(p, e, int(n[p, e]) if k == 0 else 0, k, limb) for k, limb in enumerate(_limbs(whole))]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["part", "entry", "n", "limb", "sums"])
        released()

    sent = kept.select("embedding").mapInArrow(run, SUMS)
    each = sent.select("part", "entry", "n", "limb", F.posexplode_outer("sums").alias("pos", "value"))
    # A number for each entry, dimension and limb: as many as the codebooks hold.
    rows = each.groupBy("part", "entry", "limb", "pos").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
    count: dict = {}
    sums: dict = {}
    for r in rows:
        count[r["part"], r["entry"]] = max(count.get((r["part"], r["entry"]), 0), r["n"])
        if r["pos"] is not None:
            at = (r["part"], r["entry"], r["pos"])
            sums[at] = sums.get(at, 0) + (r["value"] << (LIMB * r["limb"]))
    return [[[sums[p, e, j] // count[p, e] for j in range(width // parts)] if (p, e) in count else list(entry) for e, entry in enumerate(book)] for p, book in enumerate(books)]


def fit(kept: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS) -> tuple[list, int]:
    """The codebooks (part, entry, component) of ``kept`` (vec_id, embedding: finite vectors), and the vectors' width."""
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not first:
        return [[] for _ in range(parts)], 0
    start = [[int(v) for v in integers(np.array(list(r[0]) + [0.0] * (width - len(r[0]))), scale)] for r in first]
    step = width // parts
    books = [[v[p * step : (p + 1) * step] for v in start] for p in range(parts)]
    for _ in range(rounds):
        books = _round(kept, books, width, scale, bits)
    return books, width


def digest(books: list) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def encode(kept: DataFrame, books: list, width: int, *, scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """``kept`` with columns code (two hex digits for each part) and error, in place of the vectors."""

    def run(batches):
        files = [VaFile(_entries(b), bits) for b in books]
        for batch in batches:
            code, error = np.zeros((batch.num_rows, len(books)), np.int64), [0] * batch.num_rows
            for rows, cut in _parts(batch["embedding"], width, len(books), scale):
                total = 0
                for p, q in enumerate(cut):
                    code[rows, p], dist = files[p].nearest(q)
                    total = total + dist
                for r, t in zip(rows.tolist(), total.tolist(), strict=True):
                    error[r] = min(t, MOST)
            text = ["".join(f"{x:02x}" for x in row) for row in code.tolist()]
            rest = [batch[c] for c in batch.schema.names if c != "embedding"]
            yield pa.record_batch([*rest, pa.array(text, pa.string()), pa.array(error, pa.int64())], names=[*(c for c in batch.schema.names if c != "embedding"), "code", "error"])
        released()

    shape = kept.drop("embedding").schema.add("code", "string").add("error", "long")
    return kept.mapInArrow(run, shape)


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **options) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256) of all finite vectors."""
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    kept = named.where(is_finite(F.col("embedding")))
    books, width = fit(kept, **options)
    with_key = kept.select("vec_id", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).alias("of_label"), "embedding")
    coded = written(encode(with_key, books, width, **{k: v for k, v in options.items() if k in ("scale", "bits")}))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("of_label").agg(F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return looked_up(coded, "of_label", sums, "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
