"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document if at least ``threshold`` of its distinct five-word shingles occur there. Items fall
into partitions by size (powers of two of their shingle counts); each partition keeps, of each item, its k smallest
shingle hashes, with k above the number of shingles that an item of that size may miss. So every document that contains
an item holds at least one of its k minima, however long the document is: no candidate is lost. A document's shingles
above a partition's largest minimum are passed over without a lookup. Candidates are verified by exact containment of
the item's shingle hashes (64 bits) in the document's.

Words are lower-cased, stripped of what is neither letter nor digit at either end, and dropped if nothing is left; an
item of fewer than five words is one shingle of all its words, and so is such a document.

Items are broadcast in blocks of at most ``block_shingles`` shingles; each block is one pass over the documents.

Defined cases: a null or empty text has no shingle and matches nothing; repeated items or documents each give their
rows, also where their ids are null; an empty table gives no rows. Only the columns named are used.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialweave.llm._common import inside, rolling, split_words, word_hashes
from trialweave.llm.token_files import slices

K = 5
THRESHOLD = 0.8
BLOCK_SHINGLES = 4_000_000
ROWS = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


@lru_cache(maxsize=1 << 17)
def normal(word: bytes) -> bytes:
    w = word.decode().lower()
    i, j = 0, len(w)
    while i < j and not w[i].isalnum():
        i += 1
    while j > i and not w[j - 1].isalnum():
        j -= 1
    return w[i:j].encode()


def shingles(column, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all k-word shingles of each text, and where each text's begin."""
    words, at, off = split_words(column)
    plain = [normal(w) for w in words]
    full = np.array([bool(w) for w in plain] or [True])
    keep = full[at] if len(at) else np.zeros(0, bool)
    h = word_hashes(plain)[at][keep] if len(at) else np.zeros(0, np.uint64)
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    return windows(h, off, k)


def windows(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """rolling() within each text; a text of 1 to k-1 words gives one hash of all of them."""
    n = np.diff(off)
    out, ok = rolling(h, k), inside(off, k)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    new = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return out[ok], new
    res = np.zeros(int(new[-1]), np.uint64)
    is_short = np.zeros(len(res), bool)
    is_short[new[short]] = True
    res[~is_short] = out[ok]
    res[new[short]] = [rolling(h[off[i] : off[i + 1]], int(n[i]))[0] for i in short.tolist()]
    return res, new


def size_class(n: int) -> int:
    return int(n).bit_length()


class ItemIndex:
    """The minima of a block of distinct items, by partition: each distinct minimum with the items that have it."""

    def __init__(self, ids: list[list[int]], sets: list[np.ndarray], threshold: float):
        self.ids, self.sizes = ids, np.array([len(s) for s in sets], np.int64)
        self.all, self.first = np.concatenate(sets), np.concatenate([[0], np.cumsum(self.sizes)])
        self.need = np.ceil(threshold * self.sizes - 1e-9).astype(np.int64)
        self.parts = []
        for c in sorted({size_class(len(s)) for s in sets}):
            mine = [i for i, s in enumerate(sets) if size_class(len(s)) == c]
            largest = max(len(sets[i]) for i in mine)
            k = largest - int(np.ceil(threshold * largest - 1e-9)) + 1
            key = np.concatenate([sets[i][:k] for i in mine])  # sets are sorted
            item = np.repeat(mine, [min(k, len(sets[i])) for i in mine])
            order = np.argsort(key, kind="stable")
            distinct, start = np.unique(key[order], return_index=True)
            self.parts.append((distinct, np.append(start, len(key)), item[order]))

    def _found(self, h: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The minima that each text has, each once however often it occurs: (partition, place in it) by text."""
        out: dict[int, list[tuple[int, int]]] = {}
        for p, (keys, _, _) in enumerate(self.parts):
            at = np.flatnonzero(h <= keys[-1])
            low = np.searchsorted(keys, h[at])
            same = keys[low] == h[at]
            text = np.searchsorted(off, at[same], "right") - 1
            for x in np.unique(text * len(keys) + low[same]).tolist():
                out.setdefault(x // len(keys), []).append((p, x % len(keys)))
        return out

    def hits(self, h: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, distinct item, shingles found) of every item contained in a text.

        Candidates are expanded for one text at a time, from distinct minima, so they are no more than the block's entries.
        """
        out = []
        for text, found in sorted(self._found(h, off).items()):
            which = np.unique(np.concatenate([self.parts[p][2][self.parts[p][1][k] : self.parts[p][1][k + 1]] for p, k in found]))
            mine, n = np.unique(h[off[text] : off[text + 1]]), self.sizes[which]
            ends = np.cumsum(n)
            every = self.all[np.repeat(self.first[which] - (ends - n), n) + np.arange(int(ends[-1]))]
            there = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            got = np.add.reduceat(there.astype(np.int64), ends - n)
            ok = got >= self.need[which]
            out += [(text, i, g) for i, g in zip(which[ok].tolist(), got[ok].tolist(), strict=True)]
        return out


def item_blocks(items: DataFrame, limit: int, threshold: float):
    """ItemIndex objects of at most ``limit`` shingles each (one item at least), read partition by partition; items of equal shingles are one."""
    known: dict[bytes, int] = {}
    ids, sets, size = [], [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        s = np.unique(shingles(pa.array([row["text"]], pa.string()))[0])
        if not len(s):
            continue
        if s.tobytes() in known:
            ids[known[s.tobytes()]].append(row["item_id"])
            continue
        if ids and size + len(s) > limit:
            yield ItemIndex(ids, sets, threshold)
            ids, sets, size, known = [], [], 0, {}
        known[s.tobytes()] = len(ids)
        ids.append([row["item_id"]])
        sets.append(s)
        size += len(s)
    if ids:
        yield ItemIndex(ids, sets, threshold)


def _rows(index: ItemIndex, doc_ids: pa.Array, hits: list[tuple[int, int, int]]):
    """A row for each id of each item that is hit, in batches of bounded size."""
    rows: list[tuple] = []
    for text, i, got in hits:
        n = int(index.sizes[i])
        for item in index.ids[i]:
            rows.append((text, item, n, got, got / n))
            if len(rows) >= 1 << 16:
                yield _batch(doc_ids, rows)
                rows = []
    yield _batch(doc_ids, rows)


def _batch(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    text, item, n, got, share = zip(*rows, strict=True) if rows else [()] * 5
    return pa.record_batch([doc_ids.take(pa.array(text, pa.int64())).cast(pa.int64()), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(got, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "n_shingles", "n_found", "containment"])


def find_items(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_found, containment) of every contained item."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")

    def scan(index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches):
            index = shared.value
            for batch in batches:
                for piece in slices(batch, "text"):
                    yield from _rows(index, piece["doc_id"], index.hits(*shingles(piece["text"])))

        return docs.mapInArrow(run, ROWS)

    scans = [scan(x) for x in item_blocks(items.select("item_id", "text"), block_shingles, threshold)]
    return reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], ROWS)


def clean(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents that contain no item, with all their columns: a filter where they are read, so no document moves."""
    spark = docs.sparkSession

    def left(docs: DataFrame, index: ItemIndex) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches):
            for batch in batches:
                for piece in slices(batch, "text"):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[text for text, _, _ in shared.value.hits(*shingles(piece["text"]))]] = False
                    yield piece.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    return reduce(left, item_blocks(items.select("item_id", "text"), block_shingles, threshold), docs)
