"""Embedding near-dedup by lattice hashing.

Several tables each project the unit vectors at random onto 8 dimensions and decode them to the nearest point of a
scaled E8 lattice; a vector's keys are its cell and the neighbouring cells it lies closest to. Vectors that share a key
are compared by exact cosine in double precision.

Equal vectors are one member with a multiplicity from the start. A bucket's members are compared in blocks: a bucket
above ``chunk`` members is cut into chunks by a hash, and each pair of chunks is a task of its own. A block gives one
row for each member that has links there (how many, and the least member it is connected with), never its pairs; a pair
found under several keys counts under the first key that both have.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing and are their own
component; vectors of differing lengths don't link; a null id is left out of other rows' components and has itself as
component; rows of one id stay separate vectors; an empty table gives no rows. Only the columns named are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm._common import groups_for, mixed, one_array, written
from trialweave.llm.components import components, looked_up

THRESHOLD = 0.9
TABLES, NEIGHBOURS, SCALE = 6, 2, 1.9
CHUNK = 2048
FOUND = "m long, n long, label long"


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [v for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1) for v in [a * np.eye(8)[i] + b * np.eye(8)[j]]]
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate([np.array(whole), signs[signs.prod(axis=1) == 1] / 2])


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    d = x[odd] - r[odd]
    worst = np.abs(d).argmax(axis=1)
    r[odd, worst] += np.where(d[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _key(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(len(points), table + 1, np.uint64)
    for c in np.rint(2 * points).astype(np.int64).T.astype(np.uint64):
        h = mixed(h ^ c, 1)
    return h


def keys(unit: np.ndarray, tables: int = TABLES, neighbours: int = NEIGHBOURS, scale: float = SCALE, seed: int = 5) -> np.ndarray:
    """Keys of unit vectors (rows): for each table the cell and its nearest neighbours, as (n, tables, 1 + neighbours)."""
    n, dim = unit.shape
    out, root = np.zeros((n, tables, 1 + neighbours), np.uint64), roots()
    for t in range(tables):
        q = np.linalg.qr(np.random.default_rng(seed + t).normal(size=(max(dim, 8), 8)))[0][:dim]
        x = unit @ q * np.sqrt(dim / 8) * scale
        p = decode(x)
        out[:, t, 0] = _key(p, t)
        if neighbours:
            near = np.argpartition(-((x - p) @ root.T), neighbours - 1, axis=1)[:, :neighbours]
            for k in range(neighbours):
                out[:, t, 1 + k] = _key(p + root[near[:, k]], t)
    return out


def usable(vectors: pa.Array) -> list[np.ndarray | None]:
    out = []
    for v in vectors:
        x = None if not v.is_valid or v.values.null_count else v.values.to_numpy().astype(np.float64)
        n = np.linalg.norm(x) if x is not None and len(x) and np.isfinite(x).all() else 0
        if n and not np.isfinite(n):
            x, n = x / np.abs(x).max(), np.linalg.norm(x / np.abs(x).max())
        out.append(x / n if n else None)
    return out


class _Block:
    """Members of blocks, sorted by block; gathers the links of each member."""

    def __init__(self, table: pa.Table, dtype: str, tables: int, threshold: float):
        self.m, self.place = table["m"].to_numpy(), table["place"].to_numpy()
        x = np.frombuffer(b"".join(table["unit"].to_pylist()), dtype).reshape(len(self.m), -1).astype(np.float64)
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64).reshape(len(self.m), tables, -1)
        self.mult, self.key = table["mult"].to_numpy(), table["key"].to_numpy().view(np.uint64)
        self.side, self.threshold = table["side"].to_numpy(), threshold
        self.left, self.right = [], []

    def add(self, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> None:
        ok = (cos >= self.threshold) & (self.m[i] != self.m[j])
        self.left.append(i[ok])
        self.right.append(j[ok])

    def rows(self) -> pa.Table:
        cut = np.flatnonzero(np.concatenate([[True], self.place[1:] != self.place[:-1]])).tolist() + [len(self.m)]
        small = np.ones(len(self.m), bool)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a > 48:
                small[a:b] = False
                self._matrix(a, b)
        at = np.flatnonzero(small)
        d = 1
        while len(at):
            at = at[at + d < len(self.m)]
            at = at[self.place[at] == self.place[at + d]]
            both = at[(self.side[at] == 0) | (self.side[at] != self.side[at + d])]
            self.add(both, both + d, np.einsum("ij,ij->i", self.unit[both], self.unit[both + d]))
            d += 1
        i, j = np.concatenate(self.left or [np.zeros(0, int)]), np.concatenate(self.right or [np.zeros(0, int)])
        return self._told(i, j)

    def _matrix(self, a: int, b: int) -> None:
        for x in range(a, b, 512):
            s = self.unit[x : min(b, x + 512)] @ self.unit[a:b].T
            i, j = np.nonzero(s >= self.threshold)
            i, j = i + x, j + a
            ok = (i < j) & ((self.side[i] == 0) | (self.side[i] != self.side[j]))
            self.add(i[ok], j[ok], np.ones(int(ok.sum())))

    def _told(self, i: np.ndarray, j: np.ndarray) -> pa.Table:
        first = np.ones(len(i), bool)
        for x in range(0, len(i), 100_000):
            s = slice(x, x + 100_000)
            mine, theirs = self.keys[i[s]], self.keys[j[s]]
            both = (mine[:, :, :, None] == theirs[:, :, None, :]).any(axis=3)
            first[s] = np.where(both, mine, np.uint64(0xFFFFFFFFFFFFFFFF)).reshape(len(mine), -1).min(axis=1) == self.key[i[s]]
        n = np.zeros(len(self.m), np.int64)
        np.add.at(n, i[first], self.mult[j[first]])
        np.add.at(n, j[first], self.mult[i[first]])
        label = self.m.copy()
        while len(i):
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            if (label == before).all():
                break
        have = np.zeros(len(self.m), bool)
        have[i] = have[j] = True
        return pa.table({"m": self.m[have], "n": n[have], "label": label[have]})


def link(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, neighbours: int = NEIGHBOURS, scale: float = SCALE, chunk: int = CHUNK) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (least vec_id reachable), kept."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e"))
    dtype = "<f4" if dict(v.dtypes)["e"] == "array<float>" else "<f8"

    def hashed(batches):
        for batch in batches:
            unit = usable(one_array(batch["e"]))
            kept = [i for i, u in enumerate(unit) if u is not None]
            cells: list = [None] * batch.num_rows
            for dim in sorted({len(unit[i]) for i in kept}):
                mine = [i for i in kept if len(unit[i]) == dim]
                # A hash of the direction names the member: equal vectors have equal names.
                for i, k in zip(mine, keys(np.array([unit[i] for i in mine]), tables, neighbours, scale), strict=True):
                    cells[i] = (k ^ np.uint64(dim)).tobytes()
            names = [None if c is None else _name(unit[i]) for i, c in enumerate(cells)]
            bytes_ = [None if c is None else batch["e"][i].values.to_numpy().astype(dtype).tobytes() if dtype == "<f4" else unit[i].tobytes() for i, c in enumerate(cells)]
            yield pa.record_batch([batch["vec_id"], pa.array(names, pa.int64()), pa.array(bytes_, pa.binary()), pa.array(cells, pa.binary()), pa.array([None if c is None else np.unique(np.frombuffer(c, np.uint64)).view(np.int64).tolist() for c in cells], pa.list_(pa.int64()))], names=["vec_id", "m", "unit", "keys", "each"])

    rows = written(v.repartition(groups_for(v, 1, 12)).mapInArrow(hashed, "vec_id long, m long, unit binary, keys binary, each array<long>"))
    member = written(rows.where("m is not null").groupBy("m").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("unit").alias("unit"), F.first("keys").alias("keys"), F.first("each").alias("each")))
    cell = written(member.select("m", F.explode("each").alias("key")))
    size = cell.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.when(F.col("size") > chunk, F.ceil(F.col("size") / chunk)).cast("int").alias("parts"))
    # Vectors join their cells once these are cut into chunks; a vector has a bounded number of cells.
    dealt = looked_up(cell, "key", size, "parts")
    mine = F.pmod(F.xxhash64("m"), F.col("parts")).cast("int")
    # A block (x, y), x <= y, holds chunks x and y; within a block of two chunks, side tells them apart.
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"), F.when(o == mine, 0).when(mine < o, 1).otherwise(2).alias("side")))
    one = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side")))
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("parts").isNull(), one).otherwise(other))).select("m", "key", F.xxhash64("key", "block.x", "block.y").alias("place"), "block.side")
    dealt = dealt.join(member.select("m", "mult", "unit", "keys"), "m")
    found = dealt.repartition(groups_for(v, 1, 48), "place").sortWithinPartitions("place").mapInArrow(lambda batches: _blocks(batches, dtype, tables, threshold), FOUND)
    found = written(found.groupBy("m", "label").agg(F.sum("n").alias("n")))
    label = components(found.select(F.col("m").alias("a"), F.col("label").alias("b")))
    named = written(member.select("m", "least", "mult").join(label, F.col("m") == F.col("v"), "left").select("m", "least", "mult", F.coalesce("label", "m").alias("label")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    links = found.groupBy("m").agg(F.sum("n").alias("n"))
    of = looked_up(named, "label", least, "component_id").join(links, "m", "left").select("m", "component_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = rows.select("vec_id", "m").join(of, "m", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _name(unit: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest((unit + 0.0).tobytes())).view(np.int64))


def _blocks(batches, dtype: str, tables: int, threshold: float):
    """Links of a partition that is sorted by block; a block may run over several batches."""
    held: pa.Table | None = None

    def done(table: pa.Table):
        width = pa.compute.binary_length(table["unit"]).to_numpy()
        for w in np.unique(width).tolist():
            yield from _Block(table.filter(pa.array(width == w)), dtype, tables, threshold).rows().to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        place = held["place"].to_numpy()
        turn = np.flatnonzero(place[1:] != place[:-1]) + 1
        if len(turn):
            cut = int(turn[-1])
            yield from done(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from done(held)
