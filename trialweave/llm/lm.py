"""Language-model scoring with a weighted backoff automaton.

The model is an absolutely discounted trigram model over word tokens and one end token a text. Its automaton has a root,
a state for each word (and the text's begin) and a state for each pair of words that training texts go on from. The arcs
of a pair's state are the trigrams seen, those of a word's state the bigrams seen, those of the root all words, with one
arc for every unknown word. An arc carries the log10 probability of its word in that state, and leads to the state of
the last two words. Each state but the root has one failure arc, to the state of its last word or from there to the
root, with the weight that the state leaves to lower orders:

    P(x|vw) = (max(c(vwx) - D3, 0) + D3 N1+(vw) P(x|w)) / C(vw)      failure weight log10(D3 N1+(vw) / C(vw))
    P(x|w)  = (max(c(wx) - D2, 0) + D2 N1+(w) P(x)) / C(w)           failure weight log10(D2 N1+(w) / C(w))
    P(x)    = (c(x) + 0.5) / (N + 0.5 (V + 1))

with D = n1 / (n1 + 2 n2) from the numbers of n-grams of that order seen once and twice. Every state's probabilities sum
to 1. Texts are traversed once from left to right: the state that one token's arc leads to is the next token's state;
where it has no arc for the token, failure arcs are followed until a state has one; weights are added up.

The automaton grows with the corpus, so no machine holds all of it. Documents are dealt out by hash into groups; each
group asks hash buckets (``in_rounds``) for the counts of its own words and bigrams, then for its words' C and N1+ and its
trigrams' counts, then for its pairs' N1+, and builds the part of the automaton that its texts can reach. A bigram or
trigram counts for N1+ in the first group whose training texts hold it. A pair seen once in training is followed by one
word once, so such a trigram is known without a question, and named only where a held-out text has the pair. A frequent word is one key a group. Keys are hashes of 64 bits
cut to 40 within a bucket, so the chance that two words of a bucket share one stays the same at every size.

Defined cases: a null or empty text is the end token alone; with nothing to learn from, all probabilities are those
of the root; repeated rows count each; an empty table gives no rows. Only the columns named are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm._common import BLOB_BYTES, bounds, bucketed, exact_sums, frame, groups_for, in_groups, in_rounds, mixed, pack, pack_sorted, split_hashes, sums, unframe, unpack, unpack_sorted

END, START = 0x656E64206F662074, 0x7374617274206F66
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Group:
    """A group's tokens; its distinct words and bigrams in bucket order, with their counts in training texts.

    ``token``, ``left`` and ``pair`` are the number of the word, the word before it and the bigram of both at each token.
    """

    def __init__(self, table: pa.Table, n: int):
        h, at, off = split_hashes(table["text"], lower=True)
        docs, self.n, words = len(off) - 1, n, len(h)
        h = np.concatenate([h, np.array([END, START], np.uint64)])
        self.off = off + np.arange(docs + 1)
        last = self.off[1:] - 1
        token = np.empty(int(self.off[-1]), np.int64)
        is_end = np.zeros(len(token), bool)
        is_end[last] = True
        token[~is_end], token[is_end] = at, words
        self.words, number = np.unique(bucketed(h, n), return_inverse=True)  # of words, end and start
        self.token = number[token]
        self.begins = self.off[:-1]
        self.left = np.concatenate([number[-1:], self.token[:-1]])
        self.left[self.begins] = number[-1]
        self.held = table["held_out"].to_numpy(zero_copy_only=False).astype(bool) if docs else np.zeros(0, bool)
        self.train = np.repeat(~self.held, np.diff(self.off))
        lh, rh = mixed(self.words, 1), mixed(self.words, 2) << np.uint64(1)
        self.pairs, self.pair = np.unique(bucketed(mixed(lh[self.left] + rh[self.token]), n), return_inverse=True)
        self.pair_left, self.pair_word = (_of(self.pair, x, len(self.pairs)) for x in (self.left, self.token))
        self.word_count = np.bincount(self.token, self.train, len(self.words)).astype(np.int64)
        self.pair_count = np.bincount(self.pair, self.train, len(self.pairs)).astype(np.int64)
        self.pair_held = np.bincount(self.pair, ~self.train, len(self.pairs)) > 0
        self.left_count = np.bincount(self.left, self.train, len(self.words)).astype(np.int64)
        self.word_cut, self.pair_cut = bounds(self.words, n), bounds(self.pairs, n)

    def with_trigrams(self, seen: np.ndarray, wanted: np.ndarray) -> None:
        """The trigrams to ask for, given how often each bigram was ``seen`` in training, and whether it was once and is
        ``wanted`` by a held-out text.

        ``once`` tells training tokens after a bigram seen once; ``asked`` are the places of the others after a bigram
        that training saw, and ``tri`` the numbers of their trigrams.
        """
        before = np.concatenate([[-1], self.pair[:-1]])
        before[self.begins] = -1
        count = np.where(before >= 0, seen[before], 0)
        self.once = self.train & (count == 1) & ~wanted[before]
        self.asked = np.flatnonzero((count > 0) & ~self.once)
        code = mixed(mixed(self.pairs, 3)[before[self.asked]] + (mixed(self.words, 4) << np.uint64(1))[self.token[self.asked]])
        self.tris, self.tri = np.unique(bucketed(code, self.n), return_inverse=True)
        self.tri_context, self.tri_lower = (_of(self.tri, x[self.asked], len(self.tris)) for x in (before, self.pair))
        self.tri_count = np.bincount(self.tri, self.train[self.asked], len(self.tris)).astype(np.int64)
        self.tri_cut = bounds(self.tris, self.n)
        self.contexts = np.unique(self.tri_context)
        self.context_cut = bounds(self.pairs[self.contexts], self.n)


def _of(number: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The value of each of n things, which is the same wherever its number stands."""
    out = np.empty(n, np.int64)
    out[number] = values
    return out


class _Merge:
    """The keys of all groups' blobs as one numbering."""

    def __init__(self, keys: list[np.ndarray]):
        uniq, self.inv = np.unique(np.concatenate(keys), return_inverse=True)
        self.size, self.cut = len(uniq), np.cumsum([len(k) for k in keys])[:-1]

    def totals(self, counts: list[np.ndarray]) -> np.ndarray:
        return np.bincount(self.inv, np.concatenate(counts), self.size).astype(np.int64)

    def owners(self, counts: list[np.ndarray]) -> list[np.ndarray]:
        """In each blob, whether it is the first to hold a key with a count."""
        have = np.flatnonzero(np.concatenate(counts) > 0)
        _, first = np.unique(self.inv[have], return_index=True)
        out = np.zeros(len(self.inv), bool)
        out[have[first]] = True
        return np.split(out, self.cut)

    def told(self, totals: np.ndarray) -> list[np.ndarray]:
        return np.split(totals[self.inv], self.cut)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


def _joined(answers: list[bytes], part: int) -> np.ndarray:
    return np.concatenate([unpack(unframe(x)[part], 5) for x in answers]).astype(np.int64)


def _flags(answers: list[bytes], part: int, cut: np.ndarray) -> np.ndarray:
    return np.concatenate([_unbits(unframe(x)[part], k) for x, k in zip(answers, np.diff(cut).tolist(), strict=True)])


def _facts(answers: list[bytes]) -> np.ndarray:
    return np.sum([np.frombuffer(unframe(x)[0], "<i8") for x in answers], axis=0)


def score(docs: DataFrame, held_out: Column, *, mb: int = 3) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text) with a model of the texts where ``held_out`` is false."""
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    n = groups_for(docs, mb, blob=BLOB_BYTES)

    def emit1(table, _):
        g, out = _Group(table, n), []
        for b in range(n):
            w, p = slice(g.word_cut[b], g.word_cut[b + 1]), slice(g.pair_cut[b], g.pair_cut[b + 1])
            out.append(frame(pack_sorted(g.words[w]), pack(g.word_count[w], 5), pack_sorted(g.pairs[p]), pack(g.pair_count[p], 5), _bits(g.pair_held[p])))
        return out

    def reduce1(groups, blobs):
        parts = [unframe(x) for x in blobs]
        words, pairs = _Merge([unpack_sorted(x[0]) for x in parts]), _Merge([unpack_sorted(x[2]) for x in parts])
        pair_counts = [unpack(x[3], 5) for x in parts]
        word, pair = words.totals([unpack(x[1], 5) for x in parts]), pairs.totals(pair_counts)
        held = np.concatenate([_unbits(x[4], len(c)) for x, c in zip(parts, pair_counts, strict=True)])
        wanted = (pair == 1) & (np.bincount(pairs.inv, held, pairs.size) > 0)
        facts = np.array([word.sum(), (word > 0).sum(), (pair == 1).sum(), (pair == 2).sum()], "<i8").tobytes()
        told = zip(words.told(word), pairs.told(pair), pairs.owners(pair_counts), pairs.told(wanted), strict=True)
        return [frame(facts, pack(w, 5), pack(p, 5), _bits(o), _bits(h)) for w, p, o, h in told]

    def emit2(table, answers):
        g, out = _Group(table, n), []
        g.with_trigrams(_joined(answers[0], 2), _flags(answers[0], 4, g.pair_cut))
        follow = np.bincount(g.pair_left, _flags(answers[0], 3, g.pair_cut), len(g.words)).astype(np.int64)
        mine = int(table["g"][0].as_py()) % n  # counted in one bucket
        for b in range(n):
            w, t = slice(g.word_cut[b], g.word_cut[b + 1]), slice(g.tri_cut[b], g.tri_cut[b + 1])
            once = np.array([g.once.sum() if b == mine else 0], "<i8").tobytes()
            out.append(frame(once, pack_sorted(g.words[w]), pack(follow[w], 5), pack(g.left_count[w], 5), pack_sorted(g.tris[t]), pack(g.tri_count[t], 5)))
        return out

    def reduce2(groups, blobs):
        parts = [unframe(x) for x in blobs]
        words, tris = _Merge([unpack_sorted(x[1]) for x in parts]), _Merge([unpack_sorted(x[4]) for x in parts])
        follow, context = (words.told(words.totals([unpack(x[i], 5) for x in parts])) for i in (2, 3))
        counts = [unpack(x[5], 5) for x in parts]
        tri = tris.totals(counts)
        once = sum(int(np.frombuffer(x[0], "<i8")[0]) for x in parts)
        facts = np.array([(tri == 1).sum() + once, (tri == 2).sum()], "<i8").tobytes()
        return [frame(facts, pack(f, 5), pack(c, 5), pack(t, 5), _bits(o)) for f, c, t, o in zip(follow, context, tris.told(tri), tris.owners(counts), strict=True)]

    def emit3(table, answers):
        g = _Group(table, n)
        g.with_trigrams(_joined(answers[0], 2), _flags(answers[0], 4, g.pair_cut))
        follow = np.bincount(g.tri_context, _flags(answers[1], 4, g.tri_cut), len(g.pairs)).astype(np.int64)[g.contexts]
        keys, cut = g.pairs[g.contexts], g.context_cut
        return [frame(pack_sorted(keys[i:j]), pack(follow[i:j], 5)) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def reduce3(groups, blobs):
        parts = [unframe(x) for x in blobs]
        contexts = _Merge([unpack_sorted(x[0]) for x in parts])
        return [frame(pack(f, 5)) for f in contexts.told(contexts.totals([unpack(x[1], 5) for x in parts]))]

    def final(table, answers):
        g = _Group(table, n)
        tokens, kinds, *twos = _facts(answers[0]).tolist()
        c, pair = _joined(answers[0], 1), _joined(answers[0], 2)
        g.with_trigrams(pair, _flags(answers[0], 4, g.pair_cut))
        follow3 = np.zeros(len(g.pairs))
        follow3[g.contexts] = _joined(answers[2], 0)
        arcs = Automaton(c, tokens, kinds)
        arcs.add_words(g.pair_left, g.pair_word, pair, _joined(answers[1], 1), _joined(answers[1], 2), discount(*twos))
        arcs.add_pairs(g.tri_context, g.tri_lower, _joined(answers[1], 3), follow3, pair, discount(*_facts(answers[1]).tolist()))
        tri = np.full(len(g.token), -1)
        tri[g.asked] = g.tri
        base, model = arcs.traverse(g.token, g.pair, tri, g.once)
        known = (c > 0)[g.token].astype(np.int64)
        return pa.table({
            "doc_id": table["doc_id"], "held_out": pa.array(g.held), "n_tokens": pa.array(np.diff(g.off)), "n_known": pa.array(sums(known, g.off)),
            "train_tokens": pa.array(np.full(len(g.held), tokens, np.int64)), "base_score": pa.array(exact_sums(base, g.off)), "score": pa.array(exact_sums(model, g.off)),
        })

    return in_rounds(in_groups(docs, n, "doc_id", "text"), n, [(emit1, reduce1), (emit2, reduce2), (emit3, reduce3)], final, RESULT)


def discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(x, out=np.zeros(len(x)), where=x > 0)


class Automaton:
    """Arc weights (log10) of the states that some texts can reach: the root, words, and pairs of words (bigrams)."""

    def __init__(self, c: np.ndarray, tokens: int, kinds: int):
        """``c``: counts by word. Words of count 0 are the root's unknown word."""
        self.root = np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1)))

    def add_words(self, left, word, count, follow, context, d: float) -> None:
        """The word states' arcs, given by bigram: state, word and count; ``follow`` (N1+) and ``context`` (C) by state."""
        total = np.maximum(context, 1)
        self.word_failure = _log(np.where(context > 0, d * follow / total, 1.0))
        backed = self.word_failure[left] + self.root[word]
        self.word_arc = np.where(count > 0, np.log10(np.maximum(count - d, 0) / total[left] + 10.0**backed), backed)

    def add_pairs(self, context, lower, count, follow, total, d: float) -> None:
        """The pair states' arcs, given by trigram: state, the bigram of its last two words, and count.

        ``follow`` (N1+) and ``total`` (C) are by bigram.
        """
        total = np.maximum(total, 1)
        self.d = d
        self.pair_failure = _log(np.where(follow > 0, d * follow / total, 1.0))
        backed = self.pair_failure[context] + self.word_arc[lower]
        self.pair_arc = np.where(count > 0, np.log10(np.maximum(count - d, 0) / total[context] + 10.0**backed), backed)

    def traverse(self, token, pair, tri, once) -> tuple[np.ndarray, np.ndarray]:
        """For each token in reading order: the root's weight, and the summed weight of the failure and other arcs taken.

        The state carried into a token is the pair before it where that is a state: then ``tri`` is the number of the
        trigram, or ``once`` says that the pair was seen this one time. Else (-1, False) it is the word before it. An
        arc leads to the state of the longest suffix wherever it starts, so a state hangs on no earlier one than the
        bigram that ends there, and the traversal of all texts is one gather over the tokens in order.
        """
        out = self.word_arc[pair]
        out[once] = np.log10((1 - self.d) + self.d * 10.0 ** out[once])
        asked = tri >= 0
        out[asked] = self.pair_arc[tri[asked]]
        return self.root[token], out


def held_out_by_crc(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold
