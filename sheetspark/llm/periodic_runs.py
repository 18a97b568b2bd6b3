"""Periodic runs of words: Stoye and Gusfield's search of a suffix tree for branching tandem repeats, merged into maximal runs.

A document's words are numbers. Ranks of all stretches of 1, 2, 4, ... words come from
prefix doubling; with them the suffixes are in order, and the common beginnings of
neighbours give the suffix tree as intervals: a node is an interval of suffixes that share
``depth`` words. Every node of depth q gives its leaves, but for those of its largest child,
one by one: a leaf i and a leaf i + q (or i - q) below the same node, but not below the same
child, are a tandem repeat of q words that can't be moved one word on. So it is the end of a
run of period q; moving it back word by word, in steps of powers of two by the same ranks,
finds the run's start. Repeats with the same ends are one run, whose period is the least.

All this runs on arrays over the documents of a batch at once: a word counts as another one
in another document, so trees don't mix. Of n words, n log n leaves are looked at. Nothing
is shuffled; a task holds the arrays of about ``WORK_WORDS`` words, or of one longer document (some 300 bytes a word).

Results at the edges: a null or empty text has no words, no runs and an empty ``collapsed``; equal rows have equal
results; an empty table stays empty; a very long text is searched whole. Result columns replace input columns
of the same names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetspark.llm.common import with_arrow

#: A run has at least so many words and periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
WORK_WORDS = 200_000

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RUN_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


def ranks_of(ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For k = 0, 1, ...: the rank of the 2^k numbers from each place on; and the places in order of their suffixes.

    A rank is the first place in that order of all equal stretches. Numbers below zero end a document; each occurs once.
    """
    n = len(ids)
    order = np.argsort(ids)
    rank = np.empty(n, np.int32)
    step = np.empty(n, bool)
    step[0] = True
    step[1:] = ids[order[1:]] != ids[order[:-1]]
    first = np.maximum.accumulate(np.where(step, np.arange(n), 0))
    rank[order] = first
    levels, width = [rank], 1
    # places of the order whose stretch isn't alone
    alone = step & np.append(step[1:], True)
    at = np.flatnonzero(~alone)
    while len(at):
        place = order[at]
        # a stretch that isn't alone ends before its document does, so place + width exists
        follow = rank[place + width]
        key = first[at].astype(np.int64) * n + follow
        by = np.argsort(key)
        order[at] = place = place[by]
        key = key[by]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        first[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[place] = first[at]
        levels.append(rank)
        width *= 2
        at = at[~(new & np.append(new[1:], True))]
    return levels, order


def shared_words(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words are equal from places a and b on."""
    n, total = len(levels[0]), np.zeros(len(a), np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        step = same.astype(np.int64) << k
        total += step
        a += step
        b += step
    return total


def shared_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words are equal back from before places a and b, a < b."""
    total = np.zeros(len(a), np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    for k in range(len(levels) - 1, -1, -1):
        back = a >= 1 << k
        same = back & (levels[k][np.maximum(a - (1 << k), 0)] == levels[k][np.maximum(b - (1 << k), 0)])
        step = same.astype(np.int64) << k
        total += step
        a -= step
        b -= step
    return total


def bounds_of(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place p of ``depth``: the nearest places to the left and to the right where it is less.

    Jumps of powers of two over minima of blocks; 0 at both ends is less than all.
    """
    n = len(depth)
    minima, width = [depth], 1
    while width < n and minima[-1].max() > 0:
        last = minima[-1]
        minima.append(np.minimum(last[:-width], last[width:]) if len(last) > width else last[:0])
        width *= 2
    minima = [m for m in minima if len(m)]
    at = np.flatnonzero(depth > 0)
    value = depth[at]
    left, right = at.copy(), at.copy()  # all of (left, at] and [at, right) are not less
    left -= 1
    for k in range(len(minima) - 1, -1, -1):
        w = 1 << k
        lo = left - w + 1
        ok = (lo >= 0) & (minima[k][np.clip(lo, 0, len(minima[k]) - 1)] >= value)
        left -= ok * w
        ok = (right + w <= n) & (minima[k][np.minimum(right, len(minima[k]) - 1)] >= value)
        right += ok * w
    return left, right


def repeats(levels: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of all branching tandem repeats."""
    n = len(order)
    rank = levels[-1]
    depth = np.zeros(n, np.int64)  # of the node that a suffix shares with the one before it in the order
    same = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    depth[same] = shared_words(levels, order[same - 1], order[same])
    if not len(same):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = bounds_of(depth)
    at = np.flatnonzero(depth > 0)
    # a node is its first suffix, left, and its depth; its children begin at left and at each of its places
    node = np.lexsort((at, depth[at], left))
    at, left, right = at[node], left[node], right[node]
    head = np.ones(len(at), bool)
    head[1:] = (left[1:] != left[:-1]) | (depth[at[1:]] != depth[at[:-1]])
    heads = np.flatnonzero(head)
    number = np.cumsum(head) - 1
    # children: the one from left to the first place, and one from each place to the next
    start = np.concatenate([left[heads], at])
    owner = np.concatenate([np.arange(len(heads)), number])
    stop = np.concatenate([at[heads], np.append(np.where(head[1:], right[:-1], at[1:]), right[-1])])
    by = np.argsort(owner, kind="stable")
    start, stop, owner = start[by], stop[by], owner[by]
    size = stop - start
    firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    largest = np.maximum.reduceat(size, firsts)[owner]
    # of several largest children the first one is left out
    tops = np.flatnonzero(size == largest)
    tops = tops[np.append(True, owner[tops[1:]] != owner[tops[:-1]])]
    small = np.ones(len(size), bool)
    small[tops] = False
    start, stop, owner, size = start[small], stop[small], owner[small], size[small]
    node_from, node_to, q = left[heads], right[heads], depth[at[heads]]
    places, periods = [], []
    # in pieces, as all leaves together are n log n
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + 1, 4 * WORK_WORDS), "left")
    cuts = np.unique(np.append(cuts, len(size)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        s = size[a:b]
        child = np.repeat(np.arange(a, b), s)
        leaf = order[np.arange(len(child)) - np.repeat(np.cumsum(s) - s, s) + start[child]].astype(np.int64)
        step = q[owner[child]]
        lo, hi, c_lo, c_hi = node_from[owner[child]], node_to[owner[child]], start[child], stop[child]
        for sign in (1, -1):
            other = leaf + sign * step
            inside = (other >= 0) & (other < n)
            r = rank[np.clip(other, 0, n - 1)]
            found = inside & (r >= lo) & (r < hi) & ((r < c_lo) | (r >= c_hi))
            places.append(np.minimum(leaf, other)[found])
            periods.append(step[found])
    return np.concatenate(places), np.concatenate(periods)


def find_runs(docs: list[np.ndarray], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """document, start, length and period of each run of the documents' numbers (from 0 on), in that order."""
    none = np.zeros((0, 4), np.int64)
    sizes = np.array([len(d) for d in docs], np.int64)
    if not sizes.sum():
        return none
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.empty(int(sizes.sum()) + len(docs), np.int64)
    of = np.repeat(np.arange(len(docs)), sizes + 1)
    most = max(int(d.max(initial=0)) for d in docs) + 1
    for k, (a, d) in enumerate(zip(starts.tolist(), docs, strict=True)):
        ids[a : a + len(d)] = d
        ids[a : a + len(d)] += k * most
        ids[a + len(d)] = -1 - k
    levels, order = ranks_of(ids)
    place, q = repeats(levels, order)
    begin = place - shared_before(levels, place, place + q)
    end = place + 2 * q
    long = end - begin >= np.maximum(least_words, least_periods * q)
    begin, end, q = begin[long], end[long], q[long]
    if not len(q):
        return none
    by = np.lexsort((q, end, begin))
    begin, end, q = begin[by], end[by], q[by]
    new = np.append(True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]))
    begin, end, q = begin[new], end[new], q[new]
    doc = of[begin]
    table = np.column_stack([doc, begin - starts[doc], end - begin, q])
    return table[np.lexsort((table[:, 3], table[:, 1], table[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run (start, length, period) after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    key: str | None = None,
    reading: Callable[[object, int], np.ndarray | None] | None = None,
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """Adds n_words, runs (start, length and period, by start, then period) and collapsed.

    Words are what blanks (the space and U+0009 to U+000D) part. ``collapsed`` has the words, joined by single spaces, without those
    that a run repeats: each run keeps its first period. ``reading``, from the column ``key`` and the number of words, gives the
    places of the words in the order in which they are read, or None for their own.
    """
    if least_words < 2 or least_periods < 2:
        raise ValueError("a run has two periods and two words at least")

    def make():
        def some(words: list[list[bytes]], out: tuple[list, list, list]) -> None:
            flat = pa.array(list(chain.from_iterable(words)), pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            table = find_runs(np.split(flat, np.cumsum([len(own) for own in words])[:-1]), least_words, least_periods)
            cuts = np.searchsorted(table[:, 0], np.arange(len(words) + 1))
            for own, a, b in zip(words, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                runs = table[a:b, 1:]
                if len(runs):
                    gone = dropped(len(own), runs)
                    left = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                else:
                    left = own
                out[0].append(len(own))
                out[1].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
                out[2].append(b" ".join(left).decode())

        def call(texts: pa.Array, *keys: pa.Array) -> list[pa.Array]:
            out: tuple[list, list, list] = [], [], []
            held, size = [], 0
            ids = keys[0].to_pylist() if keys else []
            for k in range(len(texts)):
                own = (texts[k].as_py() or "").encode().split()
                if reading and (places := reading(ids[k] if ids else None, len(own))) is not None:
                    own = [own[p] for p in places.tolist()]
                held.append(own)
                size += len(own) + 1
                if size >= WORK_WORDS:
                    some(held, out)
                    held, size = [], 0
            if held:
                some(held, out)
            return [pa.array(out[0], pa.int64()), pa.array(out[1], RUN_ARROW), pa.array(out[2], pa.string())]

        return call

    return with_arrow(docs, [text, *([key] if key else [])], FIELDS, make, keep)
