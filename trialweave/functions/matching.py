"""How much of two sequences matches: longest common blocks, found by suffix automata.

Blocks are taken greedily: the longest block that both sequences have, of equally long ones that which begins first in the
first sequence and then first in the second; then the same to its left and to its right. A suffix automaton of the second
sequence finds that block in one pass over the first, in time linear in both, however often tokens repeat. Short ranges,
where building an automaton costs more than it saves, are looked through place by place. Where few pairs of places begin
two equal tokens, the runs of such pairs are listed once, all blocks of two tokens or more are taken from this list, and
single tokens are taken in passing from what lies between.

With ``popular`` set, tokens that make up more than a hundredth of a second sequence of 200 tokens or more do not start
or carry a block, but may extend one at its ends.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Sequence

SHORT = 48
#: Runs are listed where at most so many pairs of places begin two equal tokens, and so many for each token of the two ranges.
MOST_PAIRS, PAIRS_A_TOKEN = 1 << 19, 64


def numbered(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[list[int], list[int]]:
    """Both sequences as numbers, equal tokens alike."""
    number: dict[Hashable, int] = {}
    return [number.setdefault(t, len(number)) for t in a], [number.setdefault(t, len(number)) for t in b]


def popular_tokens(b: Sequence[int]) -> set[int]:
    n = len(b)
    return {t for t, k in Counter(b).items() if k > n // 100 + 1} if n >= 200 else set()


class Automaton:
    """The suffix automaton of a range of a sequence: states with their arcs, suffix links, lengths and first ends."""

    def __init__(self, b: Sequence[int], low: int, high: int, barred: set[int]):
        self.arcs: list[dict[int, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [low - 1]
        arcs, link, size, end, last = self.arcs, self.link, self.size, self.end, 0
        for j in range(low, high):
            t = b[j]
            if t in barred:  # no block goes on over it: a token that comes only here
                t = -1 - j
            new = len(arcs)
            arcs.append({})
            link.append(0)
            size.append(size[last] + 1)
            end.append(j)
            p = last
            while p >= 0 and t not in arcs[p]:
                arcs[p][t] = new
                p = link[p]
            if p >= 0:
                q = arcs[p][t]
                if size[p] + 1 == size[q]:
                    link[new] = q
                else:  # q also stands for longer strings: the shorter ones get a state of their own
                    copy = len(arcs)
                    arcs.append(dict(arcs[q]))
                    link.append(link[q])
                    size.append(size[p] + 1)
                    end.append(end[q])
                    while p >= 0 and arcs[p].get(t) == q:
                        arcs[p][t] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def longest(self, a: Sequence[int], low: int, high: int, barred: set[int]) -> tuple[int, int, int]:
        """(i, j, n): the longest block of a[low:high] that the automaton's range has, the first in a, then in b."""
        arcs, link, size, end = self.arcs, self.link, self.size, self.end
        state, have, best = 0, 0, (low, 0, 0)
        for i in range(low, high):
            t = a[i]
            if t in barred:
                state = have = 0
                continue
            while state and t not in arcs[state]:
                state = link[state]
                have = size[state]
            if t in arcs[state]:
                state = arcs[state][t]
                have += 1
                if have > best[2]:
                    best = (i - have + 1, end[state] - have + 1, have)
        return best


def _longest_short(a: Sequence[int], b: Sequence[int], low: int, high: int, begin: int, stop: int, barred: set[int]) -> tuple[int, int, int]:
    """As Automaton.longest, by the lengths of the blocks that end at each pair of places."""
    best, before = (low, begin, 0), {}
    places: dict[int, list[int]] = {}
    for j in range(begin, stop):
        if b[j] not in barred:
            places.setdefault(b[j], []).append(j)
    for i in range(low, high):
        now = {}
        for j in places.get(a[i], ()):
            n = now[j] = before.get(j - 1, 0) + 1
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
        before = now
    return best


def _in_order_once(x: Sequence[int], y: Sequence[int]) -> int | None:
    """How many tokens both have, if each of these comes once in either and all in the same order: then no block loses one."""
    shared = set(x).intersection(y)
    common = [t for t in x if t in shared]
    return len(shared) if len(common) == len(shared) and common == [t for t in y if t in shared] else None


def _runs(a: Sequence[int], b: Sequence[int], low: int, high: int, begin: int, stop: int) -> list[list[int]] | None:
    """[i, j, n]: the runs of two equal tokens or more that go on at neither end; None where there are too many pairs."""
    base = 1 + max(max(a[low:high]), max(b[begin:stop]))
    places: dict[int, list[int]] = {}
    for j in range(begin, stop - 1):
        places.setdefault(b[j] * base + b[j + 1], []).append(j)
    found = [places.get(a[i] * base + a[i + 1], ()) for i in range(low, high - 1)]
    if sum(map(len, found)) > min(MOST_PAIRS, PAIRS_A_TOKEN * (high - low + stop - begin)):
        return None
    out, before = [], {}
    for i, js in enumerate(found, low):
        now = {}
        for j in js:
            run = before.get(j - 1)
            if run is None:
                run = [i, j, 1]
                out.append(run)
            run[2] += 1
            now[j] = run
        before = now
    return out


def _matched_in_runs(a: Sequence[int], b: Sequence[int], low: int, high: int, begin: int, stop: int, runs: list) -> int:
    """As ``matched`` of the ranges whose runs these are: a smaller range's runs are those of the larger, cut at its edges."""
    places: dict[int, list[int]] = {}
    for j in range(begin, stop):
        places.setdefault(b[j], []).append(j)
    total, todo = 0, [(low, high, begin, stop, runs)]
    while todo:
        low, high, begin, stop, runs = todo.pop()
        if not runs:  # the first single token leaves nothing to its left, so the next one to its right follows
            for t in a[low:high]:
                js = places.get(t)
                if js and (k := bisect_left(js, begin)) < len(js) and js[k] < stop:
                    begin, total = js[k] + 1, total + 1
            continue
        i, j, n = 0, 0, 0
        for x, y, k in runs:
            if k > n or (k == n and (x, y) < (i, j)):
                i, j, n = x, y, k
        total += n
        left, right = [], []
        for x, y, k in runs:
            before, cut = min(k, i - x, j - y), max(0, i + n - x, j + n - y)
            if before > 1:
                left.append((x, y, before))
            if k - cut > 1:
                right.append((x + cut, y + cut, k - cut))
        todo += [(low, i, begin, j, left), (i + n, high, j + n, stop, right)]
    return total


def matched(a: Sequence[Hashable], b: Sequence[Hashable], popular: bool = False) -> int:
    """How many tokens of the two sequences lie in matching blocks."""
    x, y = numbered(a, b)
    once = _in_order_once(x, y)
    if once is not None:
        return once
    barred = popular_tokens(y) if popular else set()
    total, todo = 0, [(0, len(x), 0, len(y))]
    while todo:
        low, high, begin, stop = todo.pop()
        runs = None if barred else _runs(x, y, low, high, begin, stop)
        if runs is not None:
            total += _matched_in_runs(x, y, low, high, begin, stop, runs)
            continue
        if min(high - low, stop - begin) <= SHORT:
            i, j, n = _longest_short(x, y, low, high, begin, stop, barred)
        else:
            i, j, n = Automaton(y, begin, stop, barred).longest(x, low, high, barred)
        if not n:
            i, j = low, begin
        while i > low and j > begin and x[i - 1] == y[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < high and j + n < stop and x[i + n] == y[j + n]:
            n += 1
        if not n:
            continue
        total += n
        if low < i and begin < j:
            todo.append((low, i, begin, j))
        if i + n < high and j + n < stop:
            todo.append((i + n, high, j + n, stop))
    return total


def ratio(a: Sequence[Hashable], b: Sequence[Hashable], popular: bool = False) -> float:
    """Twice the matched tokens by all tokens; 1 for two empty sequences."""
    n = len(a) + len(b)
    return 2.0 * matched(a, b, popular) / n if n else 1.0
