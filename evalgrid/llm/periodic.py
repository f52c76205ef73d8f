"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period q that repeats at least ``TIMES`` times and that
no neighbouring word extends. Within each text:

1. The suffix array of its words is made by doubling; the ranks of each doubling tell which stretches of
   ``2**k`` words are equal, so each dyadic block's occurrences are an interval of the suffix array.
2. A wavelet tree over the suffix array answers range successor queries: where, in the window of one block's
   length on either side, does the block occur next? A run of period q holds a block of
   ``q <= 2**k <= 2 * q`` words that recurs at distance q within it, on one side at least, and at no smaller distance.
3. Such a progression gives a candidate period, which the ranks extend to the left and right as far as it goes.

Texts are handled in the task that reads them, as many at once as hold ``WORDS`` words. Nothing is shuffled. A task
holds some hundreds of bytes for each word of its longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import modest_batches

#: Times that a period is repeated, and words of a run, at least.
TIMES, LEAST = 4, 6
#: Words of the texts that are handled at once; a longer text is handled alone.
WORDS = 200_000

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Suffixes:
    """The suffix array of several texts' words, with the ranks of every doubling.

    ``ranks[k][i]`` is the first place in the array of the suffixes that share their first ``2**k`` words with suffix i, and
    ``sizes[k]`` says at that place how many there are. A suffix shorter than ``2**k`` shares them with none.
    """

    def __init__(self, ids: np.ndarray, text: np.ndarray, ends: np.ndarray) -> None:
        n = len(ids)
        key = text.astype(np.int64) * (int(ids.max()) + 1) + ids
        self.order = np.argsort(key, kind="stable")
        self.ranks, self.sizes = [np.empty(n, np.int32)], []
        self._rank(np.arange(n), self.order, key[self.order], self.ranks[0])
        k = 0
        while True:
            starts = np.flatnonzero(np.bincount(self.ranks[k], minlength=n))
            size = np.zeros(n, np.int32)
            size[starts] = np.diff(np.append(starts, n))
            self.sizes.append(size)
            slots = np.flatnonzero(size[self.ranks[k][self.order]] > 1)
            if not len(slots):
                break
            members = self.order[slots]
            after = members + (1 << k)
            second = np.where(after < ends[members], self.ranks[k][np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            key = self.ranks[k][members] * np.int64(n + 1) + second
            by = np.argsort(key, kind="stable")
            self.order[slots] = members[by]
            self.ranks.append(self.ranks[k].copy())
            self._rank(slots, members[by], key[by], self.ranks[-1])
            k += 1
        self.ends = ends

    @staticmethod
    def _rank(slots: np.ndarray, members: np.ndarray, key: np.ndarray, ranks: np.ndarray) -> None:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        ranks[members] = slots[first][np.cumsum(first) - 1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that suffixes i and j share."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i + total, j + total
            ok = (a + (1 << k) <= self.ends[i]) & (b + (1 << k) <= self.ends[j])
            ok[ok] = self.ranks[k][a[ok]] == self.ranks[k][b[ok]]
            total[ok] += 1 << k
        return total

    def before(self, i: np.ndarray, j: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Words that the texts share right before i and j, which is the later one."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - total - (1 << k), j - total - (1 << k)
            ok = a >= starts[i]
            ok[ok] = self.ranks[k][a[ok]] == self.ranks[k][b[ok]]
            total[ok] += 1 << k
        return total


class Wavelet:
    """A wavelet tree (stored level by level) over an array of small integers."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max()).bit_length())
        self.zeros, self.split = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1 == 1
            self.zeros.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(~one, dtype=np.int32)]))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def less(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values in places ``low`` to ``high`` are under x."""
        whole = x >= 1 << self.bits
        count = np.where(whole, high - low, 0)
        for zeros, split, b in zip(self.zeros, self.split, range(self.bits - 1, -1, -1), strict=True):
            low0, high0 = zeros[low], zeros[high]
            right = ((x >> b) & 1 == 1) & ~whole
            count = count + np.where(right, high0 - low0, 0)
            low, high = np.where(right, split + low - low0, low0), np.where(right, split + high - high0, high0)
        return np.where(x > 0, count, 0)

    def nth(self, low: np.ndarray, high: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The value with r smaller ones (or equal ones before it) in places ``low`` to ``high``."""
        value = np.zeros(len(r), np.int64)
        for zeros, split, b in zip(self.zeros, self.split, range(self.bits - 1, -1, -1), strict=True):
            low0, high0 = zeros[low], zeros[high]
            right = r >= high0 - low0
            r = np.where(right, r - (high0 - low0), r)
            value += right.astype(np.int64) << b
            low, high = np.where(right, split + low - low0, low0), np.where(right, split + high - high0, high0)
        return value


def runs(ids: np.ndarray, lengths: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs of several texts, in this order; ``ids`` are their words, ``lengths`` their numbers of words.

    ``times`` is 4 or more: then each run holds a block that one of the windows finds again.
    """
    if times < 4:
        raise ValueError("runs are looked for from four times on")
    none = np.empty(0, np.int64)
    if not len(ids):
        return none, none, none, none
    text = np.repeat(np.arange(len(lengths)), lengths)
    stops = np.cumsum(lengths)
    starts, ends = np.repeat(stops - lengths, lengths), np.repeat(stops, lengths)
    suffixes = Suffixes(ids, text, ends)
    local = np.arange(len(ids)) - starts
    tree = Wavelet(local[suffixes.order].astype(np.int32))
    pairs = []
    for k in range(1, len(suffixes.sizes)):
        block = 1 << k
        j = np.flatnonzero((local & (block - 1) == 0) & (local + block <= ends - starts))
        low = suffixes.ranks[k][j].astype(np.int64)
        size = suffixes.sizes[k][low]
        j, low, high = j[size > 1], low[size > 1], (low + size)[size > 1]
        x = local[j]
        at = tree.less(low, high, x)
        later = tree.less(low, high, x + block + 1) > at + 1
        pairs.append((j[later], tree.nth(low[later], high[later], at[later] + 1) - x[later]))
        earlier = tree.less(low, high, x - block) < at
        distance = x[earlier] - tree.nth(low[earlier], high[earlier], at[earlier] - 1)
        pairs.append((j[earlier] - distance, distance))
    if not pairs:
        return none, none, none, none
    i, d = np.unique(np.stack([np.concatenate(x) for x in zip(*pairs, strict=True)]), axis=1)
    start, stop = i - suffixes.before(i, i + d, starts), i + d + suffixes.common(i, i + d)
    long = stop - start >= np.maximum(least, times * d)
    start, length, d = np.unique(np.stack([start, stop - start, d])[:, long], axis=1)
    order = np.lexsort((d, start))
    start, length, d = start[order], length[order], d[order]
    return text[start], local[start], length, d


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document (by crc32 of its id) with their tail replaced by copies of the tail's beginning; plants runs of known periods."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _found(texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[bytes]]:
    """The runs of each text (rows of start, length, period), and each text without what repeats in them."""
    found: list = [None] * len(texts)
    collapsed: list = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    known, at = _Ids(), 0
    while at < len(order):
        part, held = [], 0
        while at < len(order) and (not part or held + len(texts[order[at]]) <= WORDS):
            part.append(order[at])
            held += len(texts[order[at]])
            at += 1
        lengths = np.array([len(texts[k]) for k in part])
        ids = np.fromiter(chain.from_iterable(map(known.__getitem__, texts[k]) for k in part), np.int64, held)
        text, start, length, period = runs(ids, lengths)
        cuts = np.searchsorted(text, np.arange(len(part) + 1))
        for k, low, high in zip(part, cuts, cuts[1:], strict=False):
            words = texts[k]
            found[k] = np.stack([start[low:high], length[low:high], period[low:high]], axis=1)
            if high > low:
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, start[low:high] + period[low:high], 1)
                np.add.at(step, start[low:high] + length[low:high], -1)
                words = [words[w] for w in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
            collapsed[k] = b" ".join(words)
    return found, collapsed


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row of ``docs`` (columns doc_id, text).

    ``runs`` is an array of (start, length, period), counted in words from 0, by start and then period. ``collapsed`` has the words
    of the text but those that any run holds after its first period, joined by one blank. Words are what stands between
    ASCII white space. A null or empty text, or one of white space, has no runs and an empty ``collapsed``. Rows
    that repeat come out as often; a null id stays null; further columns are ignored; an empty table gives an empty one.

    ``planted`` gives every tenth text a repeated tail first (``repeat_tail``), for checks.
    """
    modest_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.split() if t else [] for t in batch.column(1).cast(pa.binary()).to_pylist()]
            if planted:
                texts = [repeat_tail(i, t) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            found, collapsed = _found(texts)
            flat = np.concatenate([np.empty((0, 3), np.int64), *found])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, f"doc_id long, runs {RUN}, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest length for its period, compared exactly; of equal ones the first. Null without runs."""
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.reduce(found, nothing, lambda best, run: F.when(more(best, run), run).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` found, as one row of numbers and digests for each document."""
    best = strongest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
