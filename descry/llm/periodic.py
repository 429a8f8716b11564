"""Periodic runs of words: stretches of a text that repeat one root several times, found over suffix trees.

The words of a text become numbers. Ukkonen's algorithm builds the suffix tree of the sequence and that of its reversal; a
sparse table over the Euler tour, of which only the highest node between two leaves is kept, answers the lowest common
ancestor of two leaves in constant time, and with it the longest common extension of two places to the right and to the
left. Every run has a root that is the longest Lyndon word at its place, for the order of the words or the reverse order; these
candidates are extended in both directions.

Trees are built only where a run can be. Every window of ``gram_width`` words inside a run stands in the run once more, one
period away, so stretches without such repeated windows are cut off first, again and again until nothing changes. Hashes only
decide what is looked at: equal hashes of different windows leave more to look at, never less.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import map_texts, utf8

#: Least number of words of a run, and least number of periods.
LEAST, PERIODS = 6, 4
_FACTOR = np.uint64(0x9FB21C651E98DF25)


def suffix_tree(s: list[int], sigma: int) -> tuple[list[int], list[int], dict[int, int]]:
    """(first place, end) of the label of each node, and its children by parent * sigma + symbol; node 0 is the root.

    ``s`` must end with a symbol that occurs nowhere else; symbols are below ``sigma``. Leaves end at ``len(s)`` and are
    made in the order of their suffixes.
    """
    n = len(s)
    start, end, link, child = [0], [0], [0], {}
    node = edge = length = waiting = 0
    for i, symbol in enumerate(s):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = i
            key = node * sigma + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                first = start[below]
                span = end[below] - first
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if s[first + length] == symbol:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(start)
                child[key] = middle
                start += (first, i)
                end += (first + length, n)
                link += (0, 0)
                child[middle * sigma + symbol] = middle + 1
                start[below] = first = first + length
                child[middle * sigma + s[first]] = below
                if last:
                    link[last] = middle
                last = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return start, end, child


class Extensions:
    """Longest common prefixes of the suffixes of a sequence, and the ranks of the suffixes.

    ``s`` ends with 0, which is below all its other symbols. ``rank`` follows the order of the symbols; ``mirrored`` the
    reverse order, in which 0 is the least all the same.
    """

    def __init__(self, s: list[int], sigma: int):
        start, end, child = suffix_tree(s, sigma)
        keys, below = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        self.n, self.leaf = len(s), np.array(end) == len(s)
        self.leaf[0] = False
        self.span = np.array(end) - np.array(start)
        self.parent = np.zeros(len(start), np.int64)
        self.parent[below] = keys // sigma
        self.symbol, self.below, self.sigma = keys % sigma, below, sigma
        order, shared = self.tour(self.symbol)
        self.rank = np.empty(self.n, np.int64)
        self.rank[order] = np.arange(self.n)
        self.levels = [np.array(shared, np.int32)]
        while 2 << len(self.levels) - 1 <= self.n:
            before, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(before[:-half], before[half:]))

    def tour(self, symbol: np.ndarray) -> tuple[list[int], list[int]]:
        """The suffixes as the tour meets their leaves, and the depth of the highest node since the leaf before."""
        parent = self.parent[self.below]
        at = np.lexsort((-symbol, parent))  # greatest first: the stack turns them round
        parent, nodes = parent[at], self.below[at].tolist()
        inner = np.arange(len(self.parent))
        low, high = np.searchsorted(parent, inner).tolist(), np.searchsorted(parent, inner, side="right").tolist()
        eldest = np.zeros(len(inner), bool)
        eldest[np.array(nodes)[np.append(parent[1:] != parent[:-1], True)]] = True
        eldest, leaf, span, above = eldest.tolist(), self.leaf.tolist(), self.span.tolist(), self.parent.tolist()
        depth, order, shared, least, n = [0] * len(inner), [], [], 0, self.n
        stack = nodes[low[0] : high[0]]
        while stack:
            v = stack.pop()
            base = depth[above[v]]
            if not eldest[v]:
                least = base
            if leaf[v]:
                order.append(n - base - span[v])
                shared.append(least)
            else:
                depth[v] = base + span[v]
                stack += nodes[low[v] : high[v]]
        return order, shared

    def mirrored(self) -> np.ndarray:
        order, _ = self.tour(np.where(self.symbol == 0, 0, self.sigma - self.symbol))
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes at i and j; nowhere i = j."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k, values in enumerate(self.levels):
            mine = level == k
            if mine.any():
                out[mine] = np.minimum(values[low[mine]], values[high[mine] - (1 << k)])
        return out


def lyndon_periods(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: the way to the next smaller suffix (the last suffix is the least)."""
    rank, out, stack = rank.tolist(), [0] * len(rank), []
    for i in range(len(rank) - 1, -1, -1):
        mine = rank[i]
        while stack and rank[stack[-1]] > mine:
            stack.pop()
        out[i] = stack[-1] - i if stack else 0
        stack.append(i)
    return np.array(out, np.int64)


def find_runs(words: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
    """Rows (start, length, period) by start, then period: the maximal stretches with smallest period q and a length of
    ``max(least, periods * q)`` or more. ``words`` are numbers from 0; ``periods`` is 2 or more."""
    n = len(words)
    if n < max(least, periods):
        return np.zeros((0, 3), np.int64)
    names, s = np.unique(words, return_inverse=True)
    s, sigma = s + 1, len(names) + 1
    right = Extensions([*s.tolist(), 0], sigma)
    left = Extensions([*s[::-1].tolist(), 0], sigma)
    period = np.concatenate([lyndon_periods(right.rank)[:n], lyndon_periods(right.mirrored())[:n]])
    at = np.tile(np.arange(n), 2)
    fits = period * periods <= n
    at, period = at[fits], period[fits]
    after = at + period
    forward = right.common(at, after)
    backward = left.common(n - at, n - after)
    found = np.stack([at - backward, period + forward + backward, period], axis=1)
    found = found[found[:, 1] >= np.maximum(least, periods * period)]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def gram_width(least: int, periods: int) -> int:
    """The width of the windows of which each one in a run has an equal one in the run, a period away."""
    return max(1, min(max(least, periods * q) - 2 * q + 1 for q in range(1, least + 1)))


def stretches(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
    """Rows (start, end) of stretches, each in one document, that hold all runs between them.

    A window of words stays while an equal one is in its stretch, not further away than a period can be there.
    """
    width = gram_width(least, periods)
    values = np.random.default_rng(11).integers(0, 1 << 63, ids.max(initial=0) + 1, dtype=np.uint64)
    count = max(0, len(ids) - width + 1)
    rolled = np.zeros(count, np.uint64)
    for k in range(width):
        rolled = rolled * _FACTOR + values[ids[k : k + count]]
    at = np.flatnonzero(doc[:count] == doc[width - 1 :]) if count else np.zeros(0, np.int64)
    part = doc[at]
    while True:
        starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1]))) if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(starts, append=len(at))
        part = np.repeat(np.arange(len(starts)), sizes)
        reach = np.repeat((sizes + width - 1) // periods, sizes)
        order = np.argsort(rolled[at] + part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), kind="stable")
        places, parts = at[order], part[order]
        close = (parts[1:] == parts[:-1]) & (rolled[places[1:]] == rolled[places[:-1]]) & (places[1:] - places[:-1] <= reach[order[1:]])
        stays = np.zeros(len(at), bool)
        stays[order[1:][close]] = True
        stays[order[:-1][close]] = True
        if stays.all():
            return np.stack([at[starts], at[starts] + sizes + width - 1], axis=1) if len(at) else np.zeros((0, 2), np.int64)
        at, part = at[stays], part[stays]


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _setup(bounds: tuple[int, int]):
    least, periods = bounds

    def handle(batch: pa.RecordBatch) -> dict:
        per_doc = [t.split() for t in utf8(batch)]
        ends = list(accumulate(map(len, per_doc), initial=0))
        doc = np.repeat(np.arange(len(per_doc)), np.diff(ends))
        ids = _numbered([w for words in per_doc for w in words])
        found: list[list[tuple[int, int, int]]] = [[] for _ in per_doc]
        for a, b in stretches(ids, doc, least, periods).tolist():
            d = int(doc[a])
            found[d] += [(a - ends[d] + s, n, q) for s, n, q in find_runs(ids[a:b], least, periods).tolist()]
        kept = []
        for words, runs in zip(per_doc, found):
            runs.sort(key=lambda r: (r[0], r[2]))
            if runs:
                gone = np.zeros(len(words), bool)
                for s, n, q in runs:
                    gone[s + q : s + n] = True
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept.append(b" ".join(words).decode())
        return {"doc_id": batch.column("doc_id"), "n_words": [len(w) for w in per_doc], "collapsed": pa.array(kept, pa.string())} | {
            name: [[r[k] for r in runs] for runs in found] for k, name in enumerate(("start", "length", "period"))}

    return handle


def periodic_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per document; runs is an array of (start, length, period) by start, then period.

    A run is a maximal stretch of words with smallest period q and ``max(least, periods * q)`` words or more. ``collapsed``
    holds the words, joined by one blank, without those that any run contains after its first q words. Null counts as empty:
    no words, no runs, an empty text. Of each text all words are looked at; memory grows with the longest stretch of a text
    that repeats itself. Repeated rows and null doc_ids are treated like any other; columns other than doc_id and text are
    ignored. An empty table gives no rows. No shuffle.
    """
    if least < 1 or periods < 2:
        raise ValueError("A run has one word or more and two periods or more.")
    long, longs = ("bigint", pa.int64()), ("array<bigint>", pa.list_(pa.int64()))
    fields = [("doc_id", *long), ("n_words", *long), ("collapsed", "string", pa.string())]
    fields += [(name, *longs) for name in ("start", "length", "period")]
    source = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    runs = F.transform(F.arrays_zip("start", "length", "period"),
                       lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    return map_texts(source, _setup, (least, periods), fields).select("doc_id", "n_words", runs.alias("runs"), "collapsed")
