"""URL filters: rules first, else host word segmentation and multinomial naive Bayes.

A unigram Viterbi search splits the labels of a host into words. Its words are those of all pages' texts, of any length,
counted over all pages, and the seed words; other letters cost more the longer they run. No word is left out: pages are
dealt out to groups, each group asks for all substrings of its hosts once that have the length of some word, and gets the
counts of those that are words. The Bayes model learns over segmented host and path tokens, hashed into 65,536 buckets,
of all pages but those held out: pages with a seed word among their tokens stand for what is to be blocked, the others for
what is not. The seeds label examples and nothing else: what a token weighs is learned, for a seed as for what goes along
with it. (Rules can't serve as examples: they go by top-level domain and language, and would teach the model just these.)

Defined cases: a null url or one without ``://`` has empty host and path; such a page and one without any known token
follow the classes' prior; with no seed on any page, all pages without a rule are allowed; repeated rows count and
return each; an empty table gives no rows. Only the columns named are used.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm._common import groups_for, in_groups, written

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words that name what is to be blocked.
SEEDS = ("adult", "ads", "bet", "bets", "betting", "casino", "escort", "gambling", "lottery", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 1 << 16
JUDGED = "page_id long, host string, path string, rule string, verdict string, tokens array<string>, log_odds double"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    """Rules by host; the longest that fits wins."""

    def __init__(self, rules: dict[str, str]):
        self.verdict, self.by_host = rules, {}
        for r in sorted(rules, key=lambda r: (-len(r), r)):
            host, slash, path = r.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, r))

    def find(self, host: str, path: str) -> str | None:
        parts, best = host.split("."), None
        for i in range(len(parts)):
            for start, r in self.by_host.get(".".join(parts[i:]), ()):
                if path.startswith(start):
                    best = r if best is None or len(r) > len(best) else best
                    break
        return best


TAG, SKIP = re.compile(r"<[^>]*>"), re.compile(r"<(script|style)\b.*?</\1\s*>", re.S | re.I)
LETTERS = re.compile(r"[^\W\d_]+")


def page_words(html: DataFrame) -> DataFrame:
    """The words (word, n) of all pages' visible texts, with their counts."""

    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for x in batch["html"].to_pylist():
                count.update(LETTERS.findall(TAG.sub(" ", SKIP.sub(" ", x or "")).lower()))
                if len(count) > 200_000:
                    yield _counts(count)
                    count = Counter()
        yield _counts(count)

    total = html.select("html").mapInArrow(run, "word string, n long")
    return written(total.groupBy("word").agg(F.sum("n").alias("n")))


def asked_words(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """The substrings (g, word) of the hosts of each group g that may be words, as words have these lengths."""

    def run(batches):
        seen: set[tuple[int, str]] = set()
        for batch in batches:
            for g, host in set(zip(batch["g"].to_pylist(), batch["host"].to_pylist(), strict=True)):
                for chunk in runs_of(host):
                    for i in range(len(chunk)):
                        seen.update((g, chunk[i : i + k]) for k in lengths if i + k <= len(chunk))
                        if len(seen) > 200_000:
                            yield _asked(seen)
                            seen = set()
        yield _asked(seen)

    return urls.select("g", "host").mapInArrow(run, "g int, word string").distinct()


def _asked(seen: set[tuple[int, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([g for g, _ in seen], pa.int32()), pa.array([w for _, w in seen], pa.string())], names=["g", "word"])


def runs_of(host: str) -> list[str]:
    """The runs of digits and of other characters in the labels of a host."""
    return [chunk for label in re.split(r"[.\-_:@]+", host) if label for chunk in re.findall(r"\d+|\D+", label)]


def _counts(count: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])


class Segmenter:
    """Viterbi over a unigram model; ``total`` counts all words where ``words`` are only some of them.

    Letters that are no word may run on at a cost a letter, so a run of any length is one step of the search.
    """

    def __init__(self, words: dict[str, int], total: int | None = None):
        total = total or sum(words.values()) or 1
        self.score = {w: log10(n / total) for w, n in words.items()}
        self.unknown = log10(1 / total) - 1
        self.lengths = sorted({len(w) for w in words})
        self.split = lru_cache(maxsize=100_000)(self._split)

    def _split(self, text: str) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]  # the score up to here, and where its last piece begins
        run, begin = float("-inf"), 0  # of the best split that ends in letters of no word
        for j in range(1, len(text) + 1):
            fresh = best[j - 1][0] + self.unknown
            if fresh > run:
                run, begin = fresh, j - 1
            run -= 1
            found = [(best[j - k][0] + self.score[text[j - k : j]], j - k) for k in self.lengths if k <= j and text[j - k : j] in self.score]
            best.append(max([*found, (run, begin)]))
        out, j = [], len(text)
        while j:
            out.append(text[best[j][1] : j])
            j = best[j][1]
        return tuple(out[::-1])

    def _cost(self, word: str) -> float:
        return self.score.get(word, self.unknown - len(word))

    def add(self, words: tuple[str, ...], score: float = -4.0) -> None:
        """Make these words at least as likely as ``score`` says."""
        self.score |= {w: max(score, self.score.get(w, score)) for w in words}
        self.lengths = sorted({*self.lengths, *map(len, words)})

    def tokens(self, host: str, path: str) -> list[str]:
        out = [f"h:{w}" for chunk in runs_of(host) for w in (self.split if len(chunk) <= 256 else self._split)(chunk)]
        out += [f"p:{'#' if t.isdigit() else t}" for t in re.findall(r"[^\W_]+", path.lower())]
        return out


def _bucket(token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token) % BUCKETS


class Bayes:
    """Multinomial naive Bayes with add-one smoothing over hashed tokens."""

    def __init__(self, counts: dict[str, np.ndarray], pages: dict[str, int]):
        block, allow = (counts.get(c, np.zeros(BUCKETS)) for c in ("block", "allow"))
        seen = int(((block + allow) > 0).sum()) + 1
        self.weight = np.log((block + 1) / (block.sum() + seen)) - np.log((allow + 1) / (allow.sum() + seen))
        self.weight[(block + allow) == 0] = 0
        nb, na = pages.get("block", 0), pages.get("allow", 0)
        self.prior = np.log((nb + 1) / (na + 1)) if nb else -np.inf

    def log_odds(self, tokens: list[str]) -> float:
        return float(self.prior + sum(self.weight[_bucket(t)] for t in tokens))


def judge(pages: DataFrame, rules: dict[str, str] | None = None, *, seeds: tuple[str, ...] = SEEDS, held_out: Column | None = None) -> DataFrame:
    """Judge every page (page_id, url, html): host, path, rule, verdict, tokens, log_odds (block against allow).

    The model learns nothing from pages where ``held_out`` (over host and path) is true.
    """
    fixed = Rules(RULES if rules is None else rules)
    bad = {f"{side}:{w}" for side in "hp" for w in seeds}
    words = page_words(pages)
    total = words.agg(F.sum("n")).first()[0]
    urls = pages.select("page_id", "url")
    urls = in_groups(urls, groups_for(urls), "page_id", "url").select("g", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = sorted({*(r[0] for r in words.select(F.length("word")).distinct().collect()), *map(len, seeds)})
    known = asked_words(urls, lengths).join(words, "word")

    def cut(key, table, words):
        seg = Segmenter(dict(zip(words["word"].to_pylist(), words["n"].to_pylist(), strict=True)), total)
        seg.add(seeds)
        tokens = [seg.tokens(h, p) for h, p in zip(table["host"].to_pylist(), table["path"].to_pylist(), strict=True)]
        return table.select(["page_id", "host", "path"]).append_column("tokens", pa.array(tokens, pa.list_(pa.string())))

    urls = written(urls.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(cut, "page_id long, host string, path string, tokens array<string>"))

    def count(batches):
        tokens, n = Counter(), Counter()
        for batch in batches:
            for found in batch["tokens"].to_pylist():
                side = "allow" if bad.isdisjoint(found) else "block"
                n[side, -1] += 1
                tokens.update((side, _bucket(t)) for t in found)
        both = tokens + n
        yield pa.record_batch([pa.array([k[0] for k in both], pa.string()), pa.array([k[1] for k in both], pa.int32()), pa.array(list(both.values()), pa.int64())], names=["verdict", "bucket", "n"])

    # At most 65,537 rows a verdict.
    examples = urls if held_out is None else urls.where(~F.coalesce(held_out, F.lit(False)))
    rows = examples.select("tokens").mapInArrow(count, "verdict string, bucket int, n long").groupBy("verdict", "bucket").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        if r["bucket"] >= 0:
            counts.setdefault(r["verdict"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    model = pages.sparkSession.sparkContext.broadcast(Bayes(counts, {r["verdict"]: r["n"] for r in rows if r["bucket"] < 0}))

    def run(batches):
        for batch in batches:
            out = []
            for host, path, tokens in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                r, odds = fixed.find(host, path), model.value.log_odds(tokens)
                out.append((r, fixed.verdict[r] if r else "block" if odds > 0 else "allow", tokens, odds))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.float64()]
            yield pa.record_batch([batch["page_id"], batch["host"], batch["path"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "tokens", "log_odds"])

    return urls.mapInArrow(run, JUDGED)
