"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words, as long as it
can be. Every word of a run occurs in it at least four times. So a word that occurs fewer times
in its segment belongs to no run and splits the segment; the pieces are counted again, until no
word is too rare. What survives is scanned by lags.

The scan goes through the periods by doubling: for those from s to 2 s - 1 it looks at blocks of
2 s words. A block inside a run of smallest period q < 2 s stands again exactly q words later and
not before, so runs are the stretches of blocks whose lag to their next occurrence is the
constant q. Blocks get their names from pairs of the names of half as long ones, and a block that
occurs once is dropped, as no longer block around it can recur. A scan of n words takes
n log n steps for each doubling, however repetitive they are; no pair of words is compared twice.

All texts of a batch are worked on at once, each as a segment of its own.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orthant.llm.common import map_texts

#: Times a run holds each of its words at least, and the fewest words of a run.
REPEATS, LEAST = 4, 6

RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


def split_rare(words: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that survive the splitting, and the segment of each, both in order.

    ``words`` and ``segments`` are numbers; positions of a segment are consecutive. Segments
    that no split has touched are not counted again.
    """
    at, segment = np.arange(len(words)), segments
    done: list[tuple[np.ndarray, np.ndarray]] = []
    names = int(words.max()) + 1 if len(words) else 1
    fresh = int(segments.max()) + 1 if len(segments) else 0
    while len(at):
        _, place, times = np.unique(
            segment * names + words[at], return_inverse=True, return_counts=True
        )
        kept = times[place] >= REPEATS
        # segment numbers ascend with the positions
        head = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        whole = np.logical_and.reduceat(kept, head)
        size = np.diff(np.r_[head, len(at)])
        stable = np.repeat(whole, size)
        if stable.any():
            done.append((at[stable], segment[stable]))
        at, segment = at[kept & ~stable], segment[kept & ~stable]
        if not len(at):
            break
        first = np.r_[True, (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])]
        size = np.diff(np.r_[np.flatnonzero(first), len(at)])
        long = np.repeat(size >= LEAST, size)
        segment = fresh + np.cumsum(first) - 1
        fresh = int(segment[-1]) + 1
        at, segment = at[long], segment[long]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, segment = (np.concatenate(parts) for parts in zip(*done, strict=True))
    order = np.argsort(at)
    return at[order], segment[order]


def scan_lags(names: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, length and period of every run in a row of names, in parts by period.

    A name that must not match across a border must differ on both sides of it.
    """
    found = []
    n, r = len(names), 1
    at = np.arange(n)  # where blocks of r words start that occur twice or more
    while len(at) and r < n:
        # blocks of 2 r words: two neighbouring blocks of r words, both recurring
        named = np.full(n + 1, -1, np.int64)
        named[at] = names
        second = named[np.minimum(at + r, n)]
        both = second >= 0
        at = at[both]
        pairs = names[both] * n + second[both]
        order = np.argsort(pairs, kind="stable")
        ranked, where = pairs[order], at[order]
        same = ranked[1:] == ranked[:-1]
        lag = np.zeros(n, np.int64)
        lag[where[:-1][same]] = (where[1:] - where[:-1])[same]
        s, r = r, 2 * r
        here = lag[at]
        in_range = (here >= s) & (here < 2 * s)
        starts, lags = at[in_range], here[in_range]
        if len(starts):
            first = np.r_[True, (starts[1:] != starts[:-1] + 1) | (lags[1:] != lags[:-1])]
            last = np.r_[first[1:], True]
            start, period = starts[first], lags[first]
            length = starts[last] - start + r + period
            long = length >= np.maximum(LEAST, REPEATS * period)
            if long.any():
                found.append((start[long], length[long], period[long]))
        again = np.zeros(len(where), bool)
        again[1:] |= same
        again[:-1] |= same
        name = np.zeros(n, np.int64)
        name[where] = np.cumsum(np.r_[True, ~same])[: len(where)]
        at = np.sort(where[again])
        names = name[at]
    return found


def runs_of(words: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start, then period."""
    at, segment = split_rare(words, segments)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    _, names = np.unique(segment * (int(words.max()) + 1) + words[at], return_inverse=True)
    parts = scan_lags(names)
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, length, period = (np.concatenate(p) for p in zip(*parts, strict=True))
    start = at[start]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _apply(texts: list[str]) -> dict[str, list]:
    split = [t.encode("utf-8").split() for t in texts]  # at ASCII white space only
    sizes = np.array([len(w) for w in split], np.int64)
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    every = map(numbers.__getitem__, chain.from_iterable(split))
    ids = np.fromiter(every, np.int64, int(sizes.sum()))
    border = np.r_[0, np.cumsum(sizes)]
    start, length, period = runs_of(ids, np.repeat(np.arange(len(texts)), sizes))
    doc = np.searchsorted(border, start, side="right") - 1
    # a word goes where some run has it after its first period
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    gone = np.cumsum(steps[:-1]) > 0
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    runs, collapsed = [], []
    for i, words in enumerate(split):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            runs.append([])
            collapsed.append(b" ".join(words).decode("utf-8"))
            continue
        places = zip(
            (start[a:b] - border[i]).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True
        )
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in places])
        kept = np.flatnonzero(~gone[border[i] : border[i + 1]]).tolist()
        collapsed.append(b" ".join([words[j] for j in kept]).decode("utf-8"))
    return {"n_words": sizes.tolist(), "runs": runs, "collapsed": collapsed}


def periodic_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``,
    the words joined by one space without those that a run has after its first period.

    Words stand between ASCII white space and are compared as they stand. Null and empty texts
    have no words, no runs and an empty ``collapsed``. Equal rows get equal results, an empty
    table none. ``keep`` names the columns carried over (default: doc_id); other columns,
    whatever they are called, are ignored, and kept ones must not have the name of an added one.
    """
    added = StructType.fromDDL(f"n_words bigint, runs {RUN_TYPE}, collapsed string")
    keep = ["doc_id"] if keep is None else keep
    clash = sorted(set(keep) & set(added.fieldNames()))
    if clash:
        raise ValueError(f"columns {clash} would be ambiguous")
    return map_texts(df, text, lambda: _apply, added, keep)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first one of equals."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(
        runs,
        none,
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )
