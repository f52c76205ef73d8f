"""Phrases whose words keep company, from depth-truncated suffix subtrees built group by group.

1. One pass counts the words of each language. A word stands for its 64-bit hash from then on; the counts show whether two
   words share one, and if so all is done again with other hashes.
2. Vertical partitioning: suffixes (a word and the ``DEPTH`` - 1 after it in its piece) are grouped by their first
   word, so that a group's suffixes fit the budget. Prefixes that are more frequent than the budget are
   lengthened: a heavy first word is divided by its second words, and two heavy words by the third.
3. A second pass sends each suffix to its group, summed up within the text that a task holds at a time, as a small tree. Each
   group's trees are merged on their own: sorted suffixes, whose leaves are added up, and whose inner nodes are the sums of their leaves.
   A group never holds more than its budget of suffixes (a pair of words within a divided prefix less than the whole of it).
4. Phrases that are frequent enough are joined to the counts of their parts, judged and ranked.

Only the counts of hash ranges (``BINS`` of them) and the words beyond the budget pass the driver; there are at most as many of these as
budgets in the corpus. At a larger scale set the budget to what a worker's memory takes, some 100 bytes a suffix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.llm.common import mix64, modest_batches, written

#: Words of the longest phrase; occurrences of a phrase, and per cent of its own that a longer one has to have to cover it.
DEPTH, LEAST, COVERED = 3, 10, 50
#: Suffixes of a group, at most.
BUDGET = 1 << 20
#: Ranges of first words' hashes that are packed into groups.
BINS = 1 << 16
#: Bytes of text that are summed up at a time; a longer text is cut between pieces.
TEXT = 1 << 22
_PIECE_END = re.compile(rb"[.,;:!?\n-\r]")
#: By byte: 2 ends a piece, 1 is a blank, 0 belongs to a word.
_KIND = np.zeros(256, np.uint8)
_KIND[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 2
_KIND[np.frombuffer(b" \t", np.uint8)] = 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts: place, piece and 64-bit hash of each (of its language and its bytes, A-Z lowered)."""

    def __init__(self, texts: list[tuple[str, bytes]], seed: int) -> None:
        self.bytes = b"\n".join([*(t for _, t in texts), b""]).lower()
        raw = np.frombuffer(self.bytes, np.uint8)
        kind = _KIND[raw]
        edge = np.diff((kind == 0).astype(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        which = np.searchsorted(np.cumsum([len(t) + 1 for _, t in texts]), self.starts, side="right")
        self.langs = [lang for lang, _ in texts]
        self.lang = which
        self.codes = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed) for x in self.langs], np.uint64)
        self.hashes = self._hash(raw, kind, seed)

    def _hash(self, raw: np.ndarray, kind: np.ndarray, seed: int) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, np.uint64)
        length = self.ends - self.starts
        values = mix64(np.arange(256, dtype=np.uint64) + _GOLD * np.uint64(2 * seed + 1))
        inside = np.flatnonzero(kind == 0)
        first = np.cumsum(length) - length
        place = np.arange(len(inside)) - np.repeat(first, length)
        powers = np.cumprod(np.full(int(length.max()), np.uint64(0xD1342543DE82EF95)))
        sums = np.add.reduceat(values[raw[inside]] * powers[place], first)
        for k in np.flatnonzero(length > 64):  # the sum is weak for long words of a certain pattern
            sums[k] = xxhash.xxh3_64_intdigest(self.bytes[self.starts[k] : self.ends[k]], seed)
        out = mix64(sums + length.astype(np.uint64) * _GOLD ^ self.codes[self.lang])
        out[out == 0] = 1  # stands for no word
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place (number of a word that has it) and count of the distinct words; words that share another's hash come besides, with count 0."""
        hashes, first, inverse, counts = np.unique(self.hashes, return_index=True, return_inverse=True, return_counts=True)
        length = self.ends - self.starts
        twin = first[inverse]
        same = (length == length[twin]) & (self.codes[self.lang] == self.codes[self.lang[twin]])
        raw = np.frombuffer(self.bytes, np.uint8)
        some = np.flatnonzero(same & (twin != np.arange(len(twin))))
        n = length[some]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = raw[np.repeat(self.starts[some], n) + at] != raw[np.repeat(self.starts[twin[some]], n) + at]
        same[np.repeat(some, n)[differ]] = False
        odd = np.flatnonzero(~same)
        return np.concatenate([hashes, self.hashes[odd]]), np.concatenate([first, odd]), np.concatenate([counts, np.zeros(len(odd), np.int64)])

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct suffixes of two words and more: numbers of their three words (-1: none) in ``hashes``, and their counts."""
        hashes, ids = np.unique(self.hashes, return_inverse=True)
        n = len(ids)
        wide = np.int64(len(hashes) + 1)
        after = np.zeros((2, n), np.int64)
        for k in (1, 2):
            near = self.piece[k:] == self.piece[: n - k] if n > k else np.empty(0, bool)
            after[k - 1, : n - k][near] = ids[k:][near] + 1
        two = after[0] > 0
        pair, third = ids[two] * wide + after[0][two], after[1][two]
        if float(wide) ** 3 < 2**63:
            keys, counts = np.unique(pair * wide + third, return_counts=True)
            pair, third = keys // wide, keys % wide
        else:
            order = np.lexsort((third, pair))
            pair, third = pair[order], third[order]
            new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
            counts = np.diff(np.append(new, len(pair)))
            pair, third = pair[new], third[new]
        return hashes, pair // wide, pair % wide - 1, third - 1, counts


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
    """The texts with their languages, about ``TEXT`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            at = 0
            while text and at < len(text):
                end = len(text)
                if end - at > TEXT and (m := _PIECE_END.search(text, at + TEXT)):
                    end = m.end()
                held.append((lang, text[at:end]))
                size += end - at
                at = end
                if size >= TEXT:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _counted(docs: DataFrame, seed: int) -> DataFrame:
    """``h, lang, word, f``: the words of each language with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches):
            words = Words(texts, seed)
            hashes, place, n = words.distinct()
            spans = zip(words.starts[place].tolist(), words.ends[place].tolist(), strict=True)
            word = pa.array([words.bytes[a:b] for a, b in spans], pa.binary()).cast(pa.string())
            lang = pa.array(words.langs, pa.string()).take(pa.array(words.lang[place]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), lang, word, pa.array(n)], ["h", "lang", "word", "n"])

    found = docs.mapInArrow(count, "h long, lang string, word string, n long")
    return found.groupBy("h", "lang", "word").agg(F.sum("n").alias("f"))


class Groups:
    """Which group a suffix belongs to."""

    def __init__(self, loads: dict[int, int], heavy: list[tuple[int, int]], budget: int) -> None:
        """``loads``: occurrences by hash range, without heavy words; ``heavy``: (hash, occurrences) of those beyond the budget."""
        load = np.zeros(BINS, np.int64)
        for k, n in loads.items():
            load[k] = n
        self.parts = np.maximum(1, -(-load // budget))  # a range beyond the budget is divided evenly
        self.base = np.zeros(BINS, np.int64)
        group, room = 0, budget
        for k in range(BINS):
            if load[k] > room:
                group, room = group + 1, budget
            self.base[k] = group
            room -= load[k]
            if self.parts[k] > 1:
                group, room = group + int(self.parts[k]), budget
        found = np.array(sorted((h & (1 << 64) - 1, n) for h, n in heavy), np.uint64).reshape(-1, 2)
        self.heavy, self.loads, self.budget = found[:, 0], found[:, 1].astype(np.int64), budget

    def __call__(self, hashes: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each suffix (numbers of its words in ``hashes``), and whether its first two words are divided among groups."""
        ranges = (hashes >> np.uint64(48)).astype(np.int64)
        inner = (hashes >> np.uint64(16) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        group = (self.base[ranges] + (inner * self.parts[ranges] >> 32))[one]
        if not len(self.heavy):
            return group, np.zeros(len(one), bool)
        at = np.minimum(np.searchsorted(self.heavy, hashes), len(self.heavy) - 1)
        load = np.where(self.heavy[at] == hashes, self.loads[at], 0)
        lone = (load[one] > 0) & (load[two] == 0)
        both = (load[one] > 0) & (load[two] > 0)
        slices = -(-load[one[lone]] // self.budget)
        group[lone] = mix64(hashes[one[lone]] + (inner[two[lone]] * slices >> 32).astype(np.uint64)).view(np.int64)
        slices = -(-np.minimum(load[one[both]], load[two[both]]) // self.budget)
        third = np.where(three[both] >= 0, inner[three[both]], 0)
        group[both] = mix64(mix64(hashes[one[both]] + (third * slices >> 32).astype(np.uint64)) + hashes[two[both]]).view(np.int64)
        return group, both


def _tree(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted suffixes as a tree: the nodes of each level, with their numbers of children (of the last: their counts)."""
    new1 = np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]]))
    new2 = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
    children1 = np.diff(np.append(np.searchsorted(new2, new1), len(new2)))
    children2 = np.diff(np.append(new2, len(h1)))
    parts = [np.array([len(new1), len(new2), len(h1)], np.uint32), children1.astype(np.uint32), children2.astype(np.uint32), counts.astype(np.uint32), h1[new1], h2[new2], h3]
    return b"".join(x.tobytes() for x in parts)


def _suffixes(tree: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n1, n2, n3 = np.frombuffer(tree, np.uint32, 3)
    n = np.frombuffer(tree, np.uint32, n1 + n2 + n3, 12)
    nodes = np.frombuffer(tree, np.uint64, n1 + n2 + n3, 12 + 4 * int(n1 + n2 + n3))
    children2 = n[n1 : n1 + n2]
    return np.repeat(np.repeat(nodes[:n1], n[:n1]), children2), np.repeat(nodes[n1 : n1 + n2], children2), nodes[n1 + n2 :], n[n1 + n2 :].astype(np.int64)


def _merged(trees: list[bytes], least: int, divided: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of a group (0: no third word) and their counts; pairs that are divided among groups come whatever their count."""
    h1, h2, h3, n = (np.concatenate(x) for x in zip(*map(_suffixes, trees), strict=True))
    order = np.lexsort((h3, h2, h1))
    h1, h2, h3, n = h1[order], h2[order], h3[order], n[order]
    new2 = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    new3 = np.flatnonzero(new2 | np.concatenate([[True], h3[1:] != h3[:-1]]))
    leaves = np.add.reduceat(n, new3)
    new2 = np.flatnonzero(new2)
    inner = np.add.reduceat(n, new2)
    pairs = new2[(inner >= least) | divided]
    some = (leaves >= least) & (h3[new3] != 0)
    triples = new3[some]
    return (
        np.concatenate([h1[pairs], h1[triples]]),
        np.concatenate([h2[pairs], h2[triples]]),
        np.concatenate([np.zeros(len(pairs), np.uint64), h3[triples]]),
        np.concatenate([inner[(inner >= least) | divided], leaves[some]]),
    )


def _phrases(docs: DataFrame, groups: Groups, seed: int, least: int) -> DataFrame:
    """``h1, h2, h3 (0: none), a``: the phrases that occur often enough, and parts of the divided ones."""
    shared = docs.sparkSession.sparkContext.broadcast(groups)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches):
            hashes, one, two, three, n = Words(texts, seed).suffixes()
            if not len(one):
                continue
            group, divided = shared.value(hashes, one, two, three)
            order = np.argsort(group, kind="stable")
            group, divided = group[order], divided[order]
            h1, h2 = hashes[one[order]], hashes[two[order]]
            h3 = np.where(three[order] >= 0, hashes[three[order]], np.uint64(0))
            n = n[order]
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            trees = [_tree(h1[a:b], h2[a:b], h3[a:b], n[a:b]) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(group)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group[new]), pa.array(divided[new]), pa.array(trees, pa.binary())], ["grp", "divided", "tree"])

    def merge(table: pa.Table) -> pa.Table:
        # Two kinds of groups may share a number; they are merged apart.
        found = []
        for divided in (False, True):
            trees = [t for t, d in zip(table["tree"].to_pylist(), table["divided"].to_pylist(), strict=True) if d is divided]
            if trees:
                found.append(_merged(trees, least, divided))
        h1, h2, h3, a = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "h3": h3.view(np.int64), "a": a})

    sent = docs.mapInArrow(send, "grp long, divided boolean, tree binary")
    return sent.groupBy("grp").applyInArrow(merge, "h1 long, h2 long, h3 long, a long")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in decimals of 38 digits: exact up to 10**15 occurrences."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, covered: int = COVERED, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language whose parts are found together most.

    Texts (columns lang, text) are lowered in A-Z, cut into pieces at ``.,;:!?`` and line ends, and those into words at blanks and
    tabs. A phrase of 2 or 3 words with a occurrences, l of its first part and r of the rest scores
    floor(1000000 * a * a / (l * r)) at its lowest-scoring cut. Phrases with fewer than ``least`` occurrences are no candidates; those within
    a longer candidate that has ``covered`` per cent of their occurrences are dropped. n counts the language's words.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often; further columns are ignored; an empty
    table gives an empty one. A piece longer than ``TEXT`` is held whole.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    for seed in range(8):
        words = written(_counted(docs, seed), "words")
        if words.groupBy("h").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("words share hashes with every seed")
    heavy = [(r["h"], r["f"]) for r in words.where(F.col("f") > budget).select("h", "f").toLocalIterator()]
    ranges = words.where(F.col("f") <= budget).groupBy(F.shiftrightunsigned("h", 48).cast("int").alias("k")).agg(F.sum("f").alias("f"))
    groups = Groups({r["k"]: r["f"] for r in ranges.collect()}, heavy, budget)

    found = written(_phrases(docs, groups, seed, least), "phrases")
    pairs = written(found.where("h3 = 0").groupBy("h1", "h2").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "pairs")
    triples = found.where("h3 <> 0")
    known = words.where(F.col("f") >= least)
    part = lambda k: known.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))

    cover = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    free = pairs.join(cover, ["h1", "h2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    two = free.join(part(1), "h1").join(part(2), "h2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))

    ends = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"))
    parts = triples.join(pairs.withColumnRenamed("a", "f12"), ["h1", "h2"]).join(ends, ["h2", "h3"]).join(part(1), "h1").join(part(2), "h2").join(part(3), "h3")
    early, late = score(F.col("a"), F.col("f1"), F.col("f23")), score(F.col("a"), F.col("f12"), F.col("f3"))
    cut = F.when(late < early, F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), late.alias("score"))).otherwise(F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), early.alias("score")))
    three = parts.withColumn("cut", cut).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")

    judged = written(two.unionByName(three), "judged")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each share of a language hold the first of all.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = judged.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
