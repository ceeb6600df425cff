"""Substring dedup by fixed-block anchors.

Reference blocks are the non-overlapping runs of 25 words of every document (word 0, 25, 50, ...). Any window of 50
words holds a whole block of each document it occurs in, so probing the block index with every rolling window of 25
words finds some part of every repeated window. Hits are extended: the windows of 50 words around a hit whose 112-bit
hashes occur in several documents join up to the maximal exact repeats. A window's words go where a document with a
smaller doc_id has it; windows are judged on the input.

Documents are dealt out by hash into groups of bounded size, which ask hash buckets in two rounds (``in_rounds``):
first which of their 25-word hashes are anchored, then which of their windows have a smaller holder. A passage in every
document is one key a group.

Defined cases: a null or empty text has no word; a text of fewer than 50 words loses none; repeats within one document
stay; a null doc_id counts as larger than all others; rows of one doc_id are one document for comparison, so they
don't remove each other's words; an empty table gives no rows. Only the columns named are used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialweave.llm._common import BLOB_BYTES, bounds, bucketed, frame, groups_for, in_groups, in_rounds, inside, mixed, pack, pack_sorted, rolling, split_hashes, split_words, unframe, unpack, unpack_sorted

BLOCK = 25
WINDOW = 50
LAST = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>"


class _Group:
    """A group's words and the hashes of its windows."""

    def __init__(self, table: pa.Table, block: int, window: int):
        ids = table["doc_id"].to_numpy()
        ids = np.where(np.isnan(ids), LAST, ids).astype(np.int64) if ids.dtype.kind == "f" else ids.astype(np.int64)
        if table["doc_id"].null_count:
            ids = np.array([LAST if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        self.block, self.window = block, window
        words, self.at, self.off = split_hashes(table["text"])
        self.h = words[self.at]
        self.ids, self.doc = ids, np.repeat(np.arange(len(ids)), np.diff(self.off))
        # the hash of each block, and where it may start
        self.hb, self.okb = rolling(self.h, block), inside(self.off, block)
        self.posb = np.flatnonzero(self.okb)

    def blocks(self, n: int):
        """Distinct block keys in bucket order; whether each is anchored here, and in several documents here."""
        key = bucketed(self.hb[self.posb], n)
        uniq, inv = np.unique(key, return_inverse=True)
        aligned = (self.posb - self.off[:-1][self.doc[self.posb]]) % self.block == 0
        anchored = np.zeros(len(uniq), bool)
        anchored[inv[aligned]] = True
        who = self.ids[self.doc[self.posb]]
        low, high = np.full(len(uniq), LAST), np.full(len(uniq), np.iinfo(np.int64).min)
        np.minimum.at(low, inv, who)
        np.maximum.at(high, inv, who)
        return uniq, inv, anchored, low < high

    def candidates(self, n: int, answers: list[bytes]):
        """Windows that hold an anchored block: start, and the distinct (key, check) with each one's number."""
        uniq, inv, _, several = self.blocks(n)
        cut = bounds(uniq, n)
        hit = np.zeros(len(uniq), bool)
        for b, data in enumerate(answers):
            anchored, elsewhere = (np.unpackbits(np.frombuffer(x, np.uint8), count=cut[b + 1] - cut[b]).astype(bool) for x in unframe(data))
            hit[cut[b] : cut[b + 1]] = anchored & (elsewhere | several[cut[b] : cut[b + 1]])
        marks = np.zeros(len(self.at) + 1, np.int64)
        marks[self.posb[hit[inv]]] = 1
        total = np.concatenate([[0], np.cumsum(marks)])
        start = np.flatnonzero(inside(self.off, self.window))
        reach = self.window - self.block + 1
        start = start[total[start + reach] > total[start]]
        key = bucketed(rolling(self.h, self.window)[start], n)
        check = rolling(mixed(self.h, 1), self.window, 0xD6E8FEB86659FD93)[start]
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
        number = np.zeros(len(k), np.int64)
        number[order] = np.cumsum(new) - 1
        low = np.full(int(new.sum()), LAST)
        np.minimum.at(low, number, self.ids[self.doc[start]])
        return start, k[new], c[new], number, low


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, block: int = BLOCK, mb: int = 3) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and the removed spans (first word, end)."""
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block wherever it starts")
    docs = docs.select("doc_id", "text")
    n = groups_for(docs, mb, blob=BLOB_BYTES)

    def emit1(table, _):
        uniq, _, anchored, _ = _Group(table, block, window).blocks(n)
        cut = bounds(uniq, n)
        return [frame(pack_sorted(uniq[i:j]), _bits(anchored[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def reduce1(groups, blobs):
        keys, flags = [], []
        for x in blobs:
            k, f = unframe(x)
            keys.append(unpack_sorted(k))
            flags.append(np.unpackbits(np.frombuffer(f, np.uint8), count=len(keys[-1])).astype(bool))
        uniq, inv, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        anchored = np.zeros(len(uniq), bool)
        anchored[inv[np.concatenate(flags)]] = True
        ends = np.cumsum([len(k) for k in keys])
        return [frame(_bits(anchored[i]), _bits(count[i] > 1)) for i in np.split(inv, ends[:-1])]

    def emit2(table, answers):
        g = _Group(table, block, window)
        _, key, check, _, low = g.candidates(n, answers[0])
        cut, out = bounds(key, n), []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            who, at = np.unique(low[i:j], return_inverse=True)
            out.append(frame(pack_sorted(key[i:j]), check[i:j].tobytes(), pack(at, 2 if len(who) < 1 << 16 else 4), who.astype("<i8").tobytes()))
        return out

    def reduce2(groups, blobs):
        keys, checks, lows = [], [], []
        for x in blobs:
            k, c, at, who = unframe(x)
            who = np.frombuffer(who, "<i8")
            keys.append(unpack_sorted(k))
            checks.append(np.frombuffer(c, np.uint64))
            lows.append(who[unpack(at, 2 if len(who) < 1 << 16 else 4).astype(np.int64)] if len(who) else who)
        key, check, low = (np.concatenate(x) for x in (keys, checks, lows))
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
        number = np.zeros(len(k), np.int64)
        number[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), LAST)
        np.minimum.at(least, number, low)
        smaller = least[number] < low
        return [frame(_bits(x)) for x in np.split(smaller, np.cumsum([len(k) for k in keys])[:-1])]

    def final(table, answers):
        g = _Group(table, block, window)
        start, key, _, number, low = g.candidates(n, answers[0])
        cut = bounds(key, n)
        smaller = np.zeros(len(key), bool)
        for b, data in enumerate(answers[1]):
            smaller[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(unframe(data)[0], np.uint8), count=cut[b + 1] - cut[b]).astype(bool)
        goes = start[smaller[number] | (low[number] < g.ids[g.doc[start]])]
        edge = np.zeros(len(g.at) + 1, np.int64)
        np.add.at(edge, goes, 1)
        np.add.at(edge, goes + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        words = split_words(table["text"])[0]  # in the order of the hashes
        shas, spans, removed = [], [], []
        for i, j in zip(g.off[:-1].tolist(), g.off[1:].tolist(), strict=True):
            out = gone[i:j]
            kept = g.at[i:j][~out].tolist() if out.any() else g.at[i:j].tolist()
            shas.append(hashlib.sha256(b" ".join([words[w] for w in kept])).hexdigest())
            turn = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
            spans.append(turn.reshape(-1, 2).tolist())
            removed.append(int(out.sum()))
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(np.diff(g.off)), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))})

    return in_rounds(in_groups(docs, n, "doc_id", "text"), n, [(emit1, reduce1), (emit2, reduce2)], final, RESULT)
