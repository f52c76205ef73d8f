"""Near-duplicate documents: circulant MinHash, bands, exact Jaccard on full sets.

A document is the set of its distinct word shingles. Two fixed permutations of
the 32-bit integers make all coordinates of a signature: the first scatters the
shingles, the second, circularly shifted by k, gives coordinate k as its least
value over the set.

1. One pass over the texts gives each row a fingerprint of its full set, the
   set's size and a hash for each band of the signature. Rows with the same set
   become one *class*, named by its smallest doc_id; only classes go on.
2. Classes that share a band's hash form a bucket. Each is compared with the
   bucket's smallest class, on full sets. Links of this star already connect most
   of a bucket's classes.
3. Classes that share a bucket but are not yet connected are compared with each
   other, again on full sets. A pair that is connected already can't change any
   component, so nothing is lost by leaving it out. Small buckets give pairs; the members
   of larger ones go to blocks of about ``BLOCK_SHINGLES`` shingles, each block meets each
   other of its bucket, and only confirmed links leave the task. Pairs of a large group are never
   rows of a table, and buckets with the same members count once.

In step 2 the texts of one class and of a block of its partners meet: partners
are salted into blocks of about ``BLOCK``, so a class with a great many partners
is spread over many tasks. Texts are shuffled instead of their (larger) sets.

With j the similarity at the threshold, a pair is missed with probability
(1 - j**ROWS)**bands; the defaults keep this under 1 in 30,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.llm.common import mix32, mix64, modest_batches, remix32, shingle_hashes, written
from evalgrid.llm.components import components

#: Partners of a class that are compared in one group.
BLOCK = 128
#: Members of an open bucket up to which pairs are formed, and shingles and members of a block of a larger one.
PAIRED, BLOCK_SHINGLES, BLOCK_MEMBERS = 12, 250_000, 512
#: Shingles whose coordinates are computed at once; such a block stays in the CPU's cache.
_AT_ONCE = 1 << 15
_SCATTER = np.uint32(0x9E3779B9)


def words(text: str) -> list[bytes]:
    """Words with only A-Z lower-cased; white space is space and the characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word shingles.

    A shorter text is one shingle of all its words. No word: the empty set.
    """
    w = words(text) if text else []
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(shingle_hashes(np.fromiter(map(digest, w), np.uint64, len(w)), n))


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """The band hashes (sets x bands) of non-empty sets."""
    out = np.empty((len(sets), bands), np.int64)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (size == 0 or size + len(sets[stop]) <= _AT_ONCE):
            size += len(sets[stop])
            stop += 1
        at = np.cumsum([0] + [len(s) for s in sets[start : stop - 1]])
        scattered = mix32((np.concatenate(sets[start:stop]) >> np.uint64(32)).astype(np.uint32) ^ _SCATTER)
        for b in range(bands):
            h = np.full(stop - start, b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                least = np.minimum.reduceat(remix32(scattered + np.uint32(k)), at)
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + least)
            out[start:stop, b] = h.view(np.int64)
        start = stop
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for non-empty sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, f1, f2, bands``: size, fingerprint and band hashes of each row's set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.iloc[low : low + 1000]
                sets = [shingle_set(t, n) for t in part["text"]]
                full = [s for s in sets if len(s)]
                hashes = iter(band_hashes(full, bands, rows)) if full else iter(())
                prints = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "n_shingles": [len(s) for s in sets],
                        "f1": np.array([p >> 64 for p in prints], np.uint64).view(np.int64),
                        "f2": np.array([p & (2**64 - 1) for p in prints], np.uint64).view(np.int64),
                        "bands": [next(hashes) if len(s) else None for s in sets],
                    }
                )

    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ids.mapInPandas(sign, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union of their full sets.

    ``n`` bounds the partners that a pair's bucket gives u; by it they are dealt to blocks, so nothing is counted by u.
    The texts of ``u`` and of a block of its partners ``v`` are brought together.
    An id with several texts in ``docs`` is linked if any of them is.
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    # Pairs dealt to different numbers of blocks get salts of their own, so that no block sums up several.
    salt = F.pmod(F.xxhash64("v"), blocks) + blocks * (blocks - 1) / 2
    spread = written(pairs.select("u", salt.cast("long").alias("salt"), "v"), "pairs")
    wanted = spread.select("u", "salt", F.col("v").alias("id"), F.lit(1).alias("side")).unionByName(
        spread.select("u", "salt").distinct().select("u", "salt", F.col("u").alias("id"), F.lit(0).alias("side"))
    )
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted.select("id", "u", "salt", "side").hint("merge"), "id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for u, salt, id, side, text in zip(batch["u"], batch["salt"], batch["id"], batch["side"], batch["text"], strict=True):
                if key != (u, salt):
                    key, first = (u, salt), []
                own = shingle_set(text, n)
                if side == 0:
                    first.append(own)
                elif any(similar(x, own, percent) for x in first):
                    found.append((u, id))
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    dealt = texts.repartition("u", "salt").sortWithinPartitions("u", "salt", "side")
    return dealt.mapInPandas(compare, "u long, v long").distinct()


def _blockwise(members: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between members of a bucket that aren't connected yet; every two blocks of a bucket meet in one group."""
    blocks = F.ceil(F.greatest(F.col("shingles") / BLOCK_SHINGLES, F.col("size") / BLOCK_MEMBERS)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    dealt = members.select("band", "hash", "root", F.col("doc_id").alias("id"), own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("band", "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        sets = [shingle_set(t, n) for t in group["text"]]
        group, sets = group[[len(x) > 0 for x in sets]], [x for x in sets if len(x)]
        if not sets:
            return pd.DataFrame(columns=["u", "v"], dtype="int64")
        size = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        known, at = np.unique(np.concatenate(sets), return_inverse=True)
        ids, root, block = group["id"].to_numpy(), group["root"].to_numpy().copy(), group["own"].to_numpy()
        between = group["i"].iloc[0] != group["j"].iloc[0]
        found, there = [], np.zeros(len(known), np.int32)
        for a in range(len(sets)):
            open_ = (root != root[a]) & (100 * np.minimum(size, size[a]) >= percent * np.maximum(size, size[a])) & ((block != block[a]) if between else True)
            open_[: a + 1] = False
            if open_.any():
                part = slice(starts[a], starts[a] + size[a])
                there[at[part]] = 1
                both = np.add.reduceat(there[at], starts)
                there[at[part]] = 0
                for b in np.flatnonzero(open_ & (100 * both >= percent * (size + size[a] - both))):
                    found.append((ids[a], ids[b]))
                    root[root == root[b]] = root[a]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text").join(dealt.hint("merge"), "id")
    return texts.groupBy("band", "hash", "i", "j").applyInPandas(compare, "u long, v long").distinct()


def _same_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of a doc_id that comes with several texts."""
    several = full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    heads = full.join(several, "doc_id").select("doc_id", "f1", "f2").join(classes.select("f1", "f2", F.col("doc_id").alias("head")), ["f1", "f2"])
    return heads.groupBy("doc_id").agg(F.min("head").alias("u")).join(heads.select("doc_id", F.col("head").alias("v")), "doc_id").where("u <> v").select("u", "v").distinct()


def component_table(docs: DataFrame, n: int = 3, percent: int = 85, bands: int = 22, rows: int = 6) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (columns doc_id and text; others are ignored).

    component_id is the smallest doc_id that is reachable over links; ``kept`` says whether it
    is the row's own. A null or empty text, or one without words, has an empty set, is linked
    with nothing and kept. A row without a doc_id can't be named: it takes no part and
    comes out with its n_shingles 0, no component and not kept. Rows that repeat a
    doc_id are one document, with the links of all its texts. An empty table gives an empty one.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(signatures(docs, n, bands, rows), "signatures")
    full = signed.where("n_shingles > 0")
    classes = written(
        full.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("one")).select("f1", "f2", "one.*"), "classes"
    )
    keys = classes.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    buckets = keys.groupBy("band", "hash").agg(F.min(F.struct("doc_id", "n_shingles")).alias("low"), F.count("*").alias("size")).where("size > 1")
    # Members of every bucket that has company, with the bucket's smallest class.
    members = written(
        keys.join(buckets, ["band", "hash"]).select("band", "hash", "doc_id", "n_shingles", "size", F.col("low.doc_id").alias("low"), F.col("low.n_shingles").alias("low_n")),
        "members",
    )
    fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent  # noqa: E731  the smaller set bounds the intersection
    star = members.where(F.col("low") != F.col("doc_id")).where(fits(F.col("low_n"), F.col("n_shingles"))).groupBy(F.col("low").alias("u"), F.col("doc_id").alias("v")).agg(F.max("size").alias("n"))
    # Only texts with company are compared; they are picked out once, and the comparisons deal out these alone.
    wanted = members.select("doc_id").distinct()
    texts = written(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "texts")
    linked = written(_confirmed(star, texts, n, percent).unionByName(_same_id(full, classes)), "links")
    roots = components(linked)

    placed = members.join(roots, members["doc_id"] == roots["node"], "left").select(
        "band", "hash", "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("root")
    )
    split = placed.groupBy("band", "hash").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sign")
    )
    split = split.where("least < most").groupBy("size", "sign", "shingles").agg(F.min(F.struct("band", "hash")).alias("b"))
    open_members = written(placed.join(split.select("b.band", "b.hash", "size", "shingles"), ["band", "hash"]), "open")
    a, b = open_members.where(F.col("size") <= PAIRED).alias("a"), open_members.where(F.col("size") <= PAIRED).alias("b")
    rest = (
        a.join(b, ["band", "hash"])
        .where("a.root <> b.root AND a.doc_id < b.doc_id")
        .where(fits(F.col("a.n_shingles"), F.col("b.n_shingles")))
        .select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v"), F.lit(1).alias("n"))
        .distinct()
        .join(star, ["u", "v"], "left_anti")
    )
    large = open_members.where(F.col("size") > PAIRED)
    more = _confirmed(rest, texts, n, percent).unionByName(_blockwise(large, texts, n, percent))
    more = written(more, "links")
    if not more.isEmpty():
        roots = components(linked.unionByName(more))
    named = classes.select("f1", "f2", F.col("doc_id").alias("head")).join(roots, F.col("head") == F.col("node"), "left")
    named = named.select("f1", "f2", F.coalesce("root", "head").alias("root"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    unnamed = docs.where("doc_id IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(unnamed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
