"""Quality classifier by co-training a text view and a page-metadata view.

A document is good if its labels say quality 1 and not toxic. The text view sees word evidence (how strongly a
document's words point to bad documents, from document frequencies in the training texts, leaving out the document
itself while training) and its shape (length, variety, shares of symbols, capitals, digits, line feeds, mean word
length). The metadata view sees source, language and length class. Both are logistic models. In each round each view
labels the unlabelled pool and hands its most confident labels, as many of each kind as the labels' shares say, to the
other view; then both are trained again. One logistic model over both views' log-odds gives the score. It is fitted at
every size over all labelled rows: these are dealt, each kind evenly, into five folds, and each row's log-odds come from
views that were co-trained without the labels of its fold. Then both views are co-trained with all labels.

Training uses at most ``max_labelled`` labelled and ``max_pool`` unlabelled documents, those of the least hashes of
doc_id among the labelled and among the unlabelled; the model is of fixed size (2**18 word buckets, 512 metadata buckets). Every document is scored over its whole
text.

Defined cases: null texts count as empty and null metadata as a value of its own; several label rows of a document count
as the worst of them, a null label as not bad; of rows of one doc_id the least is learned from; without labels of both kinds every document is kept with score 0.5;
with fewer than five labelled documents of a kind there are no folds, and the score is of the mean of both log-odds;
repeated rows are scored each; an empty table gives no rows. ``keep`` hands on all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm._common import one_array, released, split_hashes, word_hashes
from trialweave.llm.token_files import slices

WORDS, META = 1 << 18, 512
MAX_LABELLED, MAX_POOL = 8000, 3000
ROUNDS, CONFIDENT, SHARE = 3, 0.97, 0.1
FOLDS = 5
SHAPE = 8
SCORED = "doc_id long, p_text double, p_page double, score double, kept boolean"

_CLASS = np.zeros(256, np.uint8)  # 1 symbol, 2 capital, 3 digit, 4 line feed
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 1
_CLASS[65:91], _CLASS[48:58], _CLASS[10] = 2, 3, 4


def shape_and_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: shape values; and of all texts in a row, the word buckets, with where each text begins."""
    texts = pc.fill_null(one_array(column).cast(pa.string()), "")
    n = len(texts)
    words, at, off = split_hashes(texts, lower=True)
    at_h = (words & np.uint64(WORDS - 1)).astype(np.int64)[at]
    doc = np.repeat(np.arange(n), np.diff(off))
    kinds = np.unique(doc * max(1, len(words)) + at)
    distinct = np.bincount(kinds // max(1, len(words)), minlength=n).astype(float)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind, size = _CLASS[raw], np.maximum(np.diff(ends), 1)
    count = np.maximum(np.diff(off), 1)
    shares = [_counted(kind == k, ends) / size for k in (1, 2, 3, 4)]
    tokens = np.log1p(np.diff(off))
    shape = np.stack([tokens, np.log1p(distinct) / np.maximum(tokens, 0.1), distinct / count, np.log1p(size / count), *shares], axis=1)
    return shape, at_h, off


def _counted(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[ends[1:]] - total[ends[:-1]]).astype(float)


def evidence(strength: np.ndarray, off: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """The word evidence of each text, from the strength of each of its words, which occur ``count`` times."""
    n, full = len(off) - 1, np.flatnonzero(np.diff(off) > 0)
    top, many, size = np.zeros(n), np.zeros(n), np.ones(n)
    if len(full):
        at, strong = off[:-1][full], strength > 2
        top[full] = np.maximum.reduceat(strength, at)
        many[full] = np.add.reduceat(strong if count is None else strong * count, at, dtype=np.int64)
        size[full] = np.diff(off)[full] if count is None else np.add.reduceat(count, at, dtype=np.int64)
    return np.stack([top, np.log1p(many), many / size], axis=1)


def strengths(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """Log ratio of document frequencies in bad and good texts; 0 for words of fewer than two bad texts."""
    s = np.log(np.maximum(bad - 0.5, 0.5) / np.maximum(n_bad, 1)) - np.log(np.maximum(good + 0.5, 0.5) / np.maximum(n_good, 1))
    return np.where(bad >= 2, np.maximum(s, 0), 0)


def meta_buckets(source, lang, n_chars) -> np.ndarray:
    """The three metadata buckets of each row."""
    out = []
    for s, l, c in zip(source.to_pylist(), lang.to_pylist(), n_chars.to_pylist(), strict=True):
        size = None if c is None else int(max(c, 0)).bit_length()
        out.append([xxhash.xxh3_64_intdigest(f"{k}={v}") % META for k, v in (("source", s), ("lang", l), ("size", size))])
    return np.array(out, np.int64).reshape(-1, 3)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; x has a column of ones first."""
    w, reg = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    reg[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + reg * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(reg), grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


class TextView:
    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], shape: np.ndarray, good: np.ndarray) -> TextView:
        words, count, off = _joined(docs)
        g = np.repeat(good, np.diff(off))
        bad_n, good_n = (np.bincount(words[k], minlength=WORDS).astype(float) for k in (~g, g))
        n_bad, n_good = float((~good).sum()), float(good.sum())
        # A text is no evidence for itself: one table for words of good texts, one for those of bad ones.
        own = [x.astype(np.float32) for x in (strengths(bad_n - 1, good_n, n_bad - 1, n_good), strengths(bad_n, good_n - 1, n_bad, n_good - 1))]
        s = np.where(g, own[1][words], own[0][words])
        self.strength = strengths(bad_n, good_n, n_bad, n_good).astype(np.float32)
        self.mean, self.std = shape.mean(axis=0), shape.std(axis=0) + 1e-6
        self.w = logistic(self._x(shape, evidence(s, off, count)), good.astype(float))
        return self

    def _x(self, shape: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = np.clip((shape - self.mean) / self.std, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z**2, words, (words[:, :1] > 3.5), (words[:, :1] > 5)], axis=1)

    def logit(self, shape: np.ndarray, at: np.ndarray, off: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
        return self._x(shape, evidence(self.strength[at], off, count)) @ self.w

    def logits_of(self, docs, shape) -> np.ndarray:
        words, count, off = _joined(docs)
        return self.logit(shape, words, off, count)


def _joined(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' distinct words in a row, their counts, and where each text begins."""
    words, count = (np.concatenate([d[i] for d in docs] or [np.zeros(0, np.int32)]) for i in (0, 1))
    return words, count, np.concatenate([[0], np.cumsum([len(w) for w, _ in docs])]).astype(np.int64)


class MetaView:
    def fit(self, buckets: np.ndarray, good: np.ndarray) -> MetaView:
        used = np.unique(buckets)
        self.column = np.zeros(META, np.int64)
        self.column[used] = 1 + np.arange(len(used))
        x = np.zeros((len(buckets), 1 + len(used)))
        x[np.arange(len(x))[:, None], self.column[buckets]] = 1
        x[:, 0] = 1
        self.w = logistic(x, good.astype(float), 3.0)
        self.of = np.where(self.column > 0, self.w[self.column], 0)
        return self

    def logit(self, buckets: np.ndarray) -> np.ndarray:
        return self.w[0] + self.of[buckets].sum(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def folds(ids: list[int], good: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The fold of each labelled row, rows of a document in one; -1 for the pool, 0 for all where a kind has too few."""
    out = np.where(known, 0, -1)
    kinds = [sorted({ids[i] for i in np.flatnonzero(known & (good == k))}, key=lambda d: (xxhash.xxh3_64_intdigest(str(d)), d)) for k in (True, False)]
    if min(map(len, kinds)) >= FOLDS:
        fold = {d: n % FOLDS for kind in kinds for n, d in enumerate(kind)}
        out[known] = [fold[ids[i]] for i in np.flatnonzero(known)]
    return out


class CoTrained:
    """Both views and their combination."""

    def __init__(self, docs, shape, meta, good, fold, rounds: int = ROUNDS):
        """``fold``: see ``folds``."""
        labelled, pool = np.flatnonzero(fold >= 0), np.flatnonzero(fold < 0)
        self.calibration = np.array([0.0, 0.5, 0.5])
        if fold.max() > 0:
            z = np.zeros((len(fold), 3))
            for k in range(FOLDS):
                hold = np.flatnonzero(fold == k)
                text, page = self._views(docs, shape, meta, good, labelled[fold[labelled] != k], pool, rounds)
                z[hold] = self._both(text.logits_of([docs[i] for i in hold], shape[hold]), page.logit(meta[hold]))
            self.calibration = logistic(z[labelled], good[labelled].astype(float), 0.1)
        self.text, self.meta = self._views(docs, shape, meta, good, labelled, pool, rounds)

    @staticmethod
    def _views(docs, shape, meta, good, train, pool, rounds: int) -> tuple[TextView, MetaView]:
        """Co-train on the rows ``train`` and ``pool``."""
        extra: list[dict[int, bool]] = [{}, {}]  # for the text view, for the metadata view
        for r in range(rounds + 1):
            rows = [np.concatenate([train, np.array(sorted(e), np.int64)]) for e in extra]
            said = [np.concatenate([good[train], np.array([e[i] for i in sorted(e)], bool)]) for e in extra]
            text, page = TextView().fit([docs[i] for i in rows[0]], shape[rows[0]], said[0]), MetaView().fit(meta[rows[1]], said[1])
            if r == rounds or not len(pool):
                break
            p = [sigmoid(text.logits_of([docs[i] for i in pool], shape[pool])), sigmoid(page.logit(meta[pool]))]
            for teacher, pupil in ((0, 1), (1, 0)):
                new = np.array([int(i) not in extra[pupil] for i in pool])
                sure = [np.flatnonzero(new & (x >= CONFIDENT)) for x in (1 - p[teacher], p[teacher])]
                share = [1 - good[train].mean(), good[train].mean()]
                # Labels of one kind alone would shift the pupil, so both kinds come in the shares they have.
                n = min(SHARE * len(pool), *(len(i) / s for i, s in zip(sure, share, strict=True)))
                for k in (0, 1):
                    best = sure[k][np.argsort(-np.abs(p[teacher][sure[k]] - 0.5), kind="stable")][: int(n * share[k])]
                    extra[pupil] |= {int(pool[i]): bool(k) for i in best}
        return text, page

    @staticmethod
    def _both(text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(text)), np.clip(text, -12, 12), np.clip(meta, -12, 12)], axis=1)

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, meta = self.text.logit(*shape_and_words(batch["text"])), self.meta.logit(meta_buckets(batch["source"], batch["lang"], batch["n_chars"]))
        return sigmoid(text), sigmoid(meta), sigmoid(self._both(text, meta) @ self.calibration)


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit on bounded samples; None where the labels are of one kind."""
    order = F.xxhash64("doc_id", F.lit(3))
    good = ~F.coalesce((F.col("quality") == 0) | (F.col("toxic") != 0), F.lit(False))
    y = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    labelled = y.orderBy(order, "doc_id").limit(max_labelled).select("doc_id", "good", F.lit(True).alias("known"))
    pool = docs.select("doc_id").where("doc_id is not null").join(y, "doc_id", "left_anti").distinct().orderBy(order, "doc_id").limit(max_pool).select("doc_id", F.lit(False).alias("good"), F.lit(False).alias("known"))
    # At most max_labelled + max_pool rows of 10 bytes.
    wanted = F.broadcast(labelled.unionByName(pool).dropDuplicates(["doc_id"]))
    # One row a document, however often it is there: the least.
    own = F.struct("text", "source", "lang", "n_chars", "good", "known")
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars").join(wanted, "doc_id").groupBy("doc_id").agg(F.min(own).alias("r")).select("doc_id", "r.*")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                shape, at, off = shape_and_words(piece["text"])
                each = [np.unique(at[i:j], return_counts=True) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                cells = [pa.array([b.astype("<i4").tobytes() for b in col], pa.binary()) for col in ([w for w, _ in each], [c for _, c in each])]
                meta = meta_buckets(piece["source"], piece["lang"], piece["n_chars"])
                yield pa.record_batch([piece["doc_id"], piece["good"], piece["known"], pa.array(list(shape), pa.list_(pa.float64())), *cells, pa.array(meta.tolist(), pa.list_(pa.int64()))], names=["doc_id", "good", "known", "shape", "words", "counts", "meta"])

    got = rows.mapInArrow(run, "doc_id long, good boolean, known boolean, shape array<double>, words binary, counts binary, meta array<long>").toArrow()
    got = got.take(pc.sort_indices(got["doc_id"]))
    good_, known = (np.array(got[c].to_pylist(), bool) for c in ("good", "known"))
    if not (good_ & known).any() or not (~good_ & known).any():
        return None
    fold = folds(got["doc_id"].to_pylist(), good_, known)
    pairs = [(np.frombuffer(w, "<i4"), np.frombuffer(c, "<i4")) for w, c in zip(got["words"].to_pylist(), got["counts"].to_pylist(), strict=True)]
    shape, meta = np.array(got["shape"].to_pylist()).reshape(-1, SHAPE), np.array(got["meta"].to_pylist(), np.int64).reshape(-1, 3)
    del got
    model = CoTrained(pairs, shape, meta, good_, fold, rounds)
    del pairs
    released()
    return model


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """One row a document: doc_id, p_text, p_page, score (of being good), kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                p = model.value.score(piece) if model.value else (np.full(piece.num_rows, 0.5),) * 3
                yield pa.record_batch([piece["doc_id"].cast(pa.int64()), *(pa.array(x) for x in p), pa.array(p[2] >= threshold)], names=["doc_id", "p_text", "p_page", "score", "kept"])

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, SCORED)


def keep(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                yield piece.filter(pa.array(model.value.score(piece)[2] >= threshold)) if model.value else piece

    return docs.mapInArrow(run, docs.schema)
