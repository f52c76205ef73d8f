"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Of an item's word n-grams those are its seeds that few items share. A common one is a seed only where the item
   has none that is rarer: the rarest of each stretch of ``STRETCH`` common ones, and at least one for each item. Items of equal words are one.
2. One pass joins passages to items on the seeds. What a seed can belong to lies within twice the item's length on
   either side, since an alignment at the threshold has no more gaps than the item has words. There the words
   are first summed up regardless of their order (2 for a word of the item, -1 for another); where no stretch reaches the threshold so, no alignment can.
3. Elsewhere these words are aligned with the item by Smith and Waterman's recurrence, so edits, gaps and insertions
   cost a little instead of hiding a copy. The best alignment is kept as a share of the
   score that a full copy would reach.

The item side of the join (words and seeds) is sent to every task, but only ``MOST_WORDS``
words of it at a time: a larger benchmark is handled in that many words per pass, each a further scan of the documents, whose result is
written before the next part goes out. The sorted benchmark goes through the driver, a part at a time. Documents
are never shuffled, and no task holds more than a batch of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import modest_batches, shingle_hashes, written

#: Words of a seed; words of benchmark text sent out at a time.
SEED, MOST_WORDS = 3, 2_000_000
#: Items that may share a seed before it is common, and how many common ones in a row stand for one seed.
SHARED, STRETCH = 8, 8
#: Alignment scores, and the share of a full copy's score from which a document counts as contaminated.
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.5
_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """The hashes of the words that a worker has met last; forgetting some changes nothing."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words in lower case, without punctuation."""
    words = _WORD.findall(text.lower()) if text else ()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def seed_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``SEED`` words; a shorter text is one run."""
    if 0 < len(words) < SEED:
        return shingle_hashes(words, len(words))
    return shingle_hashes(words, SEED)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of the item within ``words``, and where it starts and ends (words).

    One row a word of the item. Gaps along a row are a running maximum, since they cost the
    same each; the start of the alignment that reaches each cell is carried along.
    """
    n = len(words)
    across = np.arange(n + 1, dtype=np.int64) * -GAP
    score = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1, dtype=np.int64)
    place = np.arange(n + 1, dtype=np.int64)
    best = (0, 0, 0)
    wide = n + 2  # a score and its start travel in one number: of equal scores the later start wins
    for w in item:
        came = (score * wide + begin)[:-1] + np.where(words == w, MATCH, MISMATCH) * wide
        now = np.maximum(score * wide + begin + GAP * wide, place)
        now[1:] = np.maximum(now[1:], came)
        now = np.maximum.accumulate(now + across * wide) - across * wide
        score, begin = now // wide, now % wide
        at = int(np.argmax(score))
        if score[at] > best[0]:
            best = (int(score[at]), int(begin[at]), at)
    return best


def reach(words: np.ndarray, own: np.ndarray) -> int:
    """No alignment of an item (``own``: its sorted words) with ``words`` scores more: the best stretch, whatever the words' order."""
    known = own[np.minimum(np.searchsorted(own, words), len(own) - 1)] == words
    total = np.concatenate([[0], np.cumsum(np.where(known, MATCH, max(MISMATCH, GAP)))])
    return int((total - np.minimum.accumulate(total)).max())


class Items:
    """Benchmark texts with their items, and where each seed stands. Texts that share an item_id stay apart; those of equal words are matched once."""

    def __init__(self, entries: list[tuple[int, np.ndarray]]) -> None:
        texts: dict[bytes, list[int]] = {}
        for i, w in entries:
            texts.setdefault(w.tobytes(), []).append(i)
        self.ids, self.words = [sorted(set(i)) for i in texts.values()], [np.frombuffer(w, np.uint64) for w in texts]
        self.own = [np.unique(w) for w in self.words]
        every = [seed_hashes(w) for w in self.words]
        hashes = np.concatenate([np.empty(0, np.uint64), *every])
        which = np.repeat(np.arange(len(every)), [len(x) for x in every])
        order = np.lexsort((which, hashes))
        hashes, which = hashes[order], which[order]
        first = np.ones(len(hashes), bool)  # a seed of an item once
        first[1:] = (hashes[1:] != hashes[:-1]) | (which[1:] != which[:-1])
        hashes, which = hashes[first], which[first]
        seeds, shared = np.unique(hashes, return_counts=True)
        keep = np.repeat(shared <= SHARED, shared)
        if not keep.all():
            chosen = {(int(h), i) for i in np.unique(which[~keep]).tolist() for h in self._common(every[i], shared[np.searchsorted(seeds, every[i])])}
            keep |= np.fromiter(((h, i) in chosen for h, i in zip(hashes.tolist(), which.tolist(), strict=True)), bool, len(hashes))
        self.hashes, self.items = hashes[keep], which[keep]
        # Most n-grams of a corpus are no seeds; a bitmap of 2**20 places tells without a search.
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _common(seeds: np.ndarray, shared: np.ndarray) -> Iterator[np.uint64]:
        """The common seeds that an item needs: the rarest of each whole stretch without a rare one, and one if it has no other."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], shared > SHARED, [False]]).astype(np.int8)))
        lone = (shared > SHARED).all()
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            for at in range(low, high if lone else high - STRETCH + 1, STRETCH):
                yield seeds[at + int(np.argmin(shared[at : min(high, at + STRETCH)]))]

    def hits(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places (words) of the seeds that a document shares with items."""
        at = np.flatnonzero(self.bitmap[(seeds >> np.uint64(44)).astype(np.int64)])
        low, high = (np.searchsorted(self.hashes, seeds[at], side=s) for s in ("left", "right"))
        n = high - low
        if not n.sum():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        which = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.items[which], np.repeat(at, n)

    def matches(self, text: str | None, threshold: float) -> Iterator[tuple[int, float, int, int]]:
        """``(item, share of a full copy's score, first word, last word + 1)`` of the items that a text holds."""
        words = word_hashes(text)
        items, places = self.hits(seed_hashes(words)) if len(words) else ((), ())
        if not len(items):
            return
        found: dict[int, tuple[float, int, int]] = {}
        order = np.lexsort((places, items))
        items, places = items[order], places[order]
        for part in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1):
            k = int(items[part[0]])
            item, best = self.words[k], (0.0, 0, 0)
            at, far = places[part], 2 * len(item)
            # Seeds farther apart than an alignment can be long belong to different ones.
            for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > far) + 1):
                low, high = max(0, at[group[0]] - far), min(len(words), at[group[-1]] + SEED + far)
                if reach(words[low:high], self.own[k]) < threshold * MATCH * len(item):
                    continue
                score, start, stop = align(item, words[low:high])
                if score / (MATCH * len(item)) > best[0]:
                    best = (score / (MATCH * len(item)), int(low + start), int(low + stop))
            for item_id in self.ids[k] if best[0] >= threshold else ():
                if best[0] > found.get(item_id, (0.0,))[0]:
                    found[item_id] = best
        for item_id, best in found.items():
            yield item_id, *best


def _items(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The benchmark's texts as word hashes, at most ``MOST_WORDS`` words at a time (one text at least)."""
    held, size = [], 0
    for item_id, text in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        words = word_hashes(text)
        if size and size + len(words) > MOST_WORDS:
            yield held
            held, size = [], 0
        if len(words):
            held.append((item_id, words))
            size += len(words)
    yield held


def _passes(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple]:
    """The item side of the join, sent to all tasks, for each part of the benchmark; and whether a further part follows."""
    modest_batches(docs.sparkSession)
    parts = _items(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")))
    entries = next(parts)
    while entries is not None:
        after = next(parts, None)
        yield docs.sparkSession.sparkContext.broadcast(Items(entries)), after is not None
        entries = after


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word``: the items that each whole text holds, copied or edited.

    The score is the best alignment's as a share of a full copy's (1). Null or empty texts and
    items, and items without an id, match nothing. Repeated documents come out once each; of unlike texts that
    share an item_id the best match counts. Other columns are ignored; empty tables give an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared, more in _passes(docs, benchmark):

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for m in shared.value.matches(t, threshold)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "start_word", "end_word"]).astype({"doc_id": "Int64"})

        part = docs.mapInPandas(search, "doc_id long, item_id long, score double, start_word int, end_word int")
        if more:
            part = written(part, "contaminated")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, judged where they stand; nulls and empty texts stay."""
    out = docs
    for shared, more in _passes(docs.select(F.col("text").cast("string").alias("text")), benchmark):
        out = out.where(~_holds(shared, threshold)(F.col("text").cast("string")))
        if more:
            out = written(out, "clean")
            shared.destroy()
    return out


def _holds(shared, threshold: float):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([next(shared.value.matches(t, threshold), None) is not None for t in texts], dtype=bool)

    return holds
