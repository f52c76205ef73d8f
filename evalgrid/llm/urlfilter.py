"""URL filters: host and path rules first, then exact list membership from a Bloom filter cascade.

A cascade is built over the complete universe of keys that the corpus holds. Its first level
is a Bloom filter of the listed keys; the second encodes those unlisted keys of the universe
that the first lets through, the third those listed keys that the second lets through, and so
on until a level lets nothing wrong through. A key is listed if the first level that rejects it
has an even number (counted from 1), or none rejects it and their number is odd. For every
key of the universe that answer is exact, and a scan of URLs needs no join to get it.

Bits are set by an aggregate (a bitwise or for each word), so keys never pass the driver. Only
finished filters do. A long list is cut by a hash of its keys into shards, with a cascade of at most about
``SHARD_BYTES`` each, and the URLs are probed by one shard after the other; so what is sent at a time is bounded for any list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import written

#: Size of the cascade of one shard, which is sent to every executor.
SHARD_BYTES = 64 << 20
#: Share of keys that a level after the first lets through wrongly.
NEXT_RATE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host and its subdomains, for paths that begin with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def parents(host: Column) -> Column:
    """A host and all domains above it, as an array."""
    labels = F.size(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), labels), lambda i: F.call_function("substring_index", host, F.lit("."), -i))


def key_hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key; all bit places come from them."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """The ``hashes`` bit places of each key in a level's filter."""
    a = h1.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    b = h2.astype(np.uint64) | np.uint64(1)
    for i in range(hashes):
        x = a + np.uint64(i) * b
        x ^= x >> np.uint64(29)
        yield (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) % np.uint64(bits)


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def lets_through(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in places(h1, h2, level, self.bits, self.hashes):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


@dataclass
class Cascade:
    levels: list[Level]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe that the cascade was built for."""
        listed = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            through = level.lets_through(h1[open_], h2[open_], i)
            listed[open_[~through]] = i % 2 == 1
            open_ = open_[through]
        return listed


def _shape(inside: int, outside: int, first: bool) -> tuple[int, int]:
    """Bits and hashes of a level that encodes ``inside`` keys against ``outside`` others."""
    rate = min(NEXT_RATE, inside / (outside * math.sqrt(2))) if first and outside else NEXT_RATE
    return max(64, math.ceil(inside * -math.log2(rate) / math.log(2))), max(1, round(-math.log2(rate)))


def _tester(keys: DataFrame, level: Level, number: int):
    test = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def through(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(test.value.lets_through(h1.to_numpy(), h2.to_numpy(), number))

    return through


def universe_keys(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """``h1, h2, inside``: the distinct keys (column ``key``) of ``universe``, hashed, and whether ``listed`` has them; written."""
    named = universe.where("key IS NOT NULL").select("key").distinct()
    marked = named.join(listed.where("key IS NOT NULL").select("key", F.lit(True).alias("inside")).distinct(), "key", "left")
    h1, h2 = key_hashes(F.col("key"))
    return written(marked.select(h1.alias("h1"), h2.alias("h2"), F.coalesce("inside", F.lit(False)).alias("inside")), "keys")


def n_shards(keys: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards so that the first level of each takes half of ``shard_bytes`` at most; the levels after it are a fraction of that."""
    n = dict(keys.groupBy("inside").count().collect())
    return max(1, math.ceil(_shape(n.get(True, 0), n.get(False, 0), True)[0] / 4 / shard_bytes)) if n.get(True) else 1


def shard_of(h2: Column, shards: int) -> Column:
    """A key's shard; the hash is mixed once more, as its bits also choose places in the filters."""
    return F.pmod(F.xxhash64(h2), F.lit(shards))


def build(keys: DataFrame) -> Cascade:
    """The cascade of a table of ``universe_keys``, or of one shard of it."""
    levels: list[Level] = []
    while True:
        n = dict(keys.groupBy("inside").count().collect())
        if not n.get(True):
            return Cascade(levels)
        bits, hashes = _shape(n[True], n.get(False, 0), not levels)
        number = len(levels)

        def set_bits(batches: Iterator[pd.DataFrame], number=number, bits=bits, hashes=hashes) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in places(batch["h1"].to_numpy(), batch["h2"].to_numpy(), number, bits, hashes):
                    yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "mask": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

        rows = keys.where("inside").select("h1", "h2").mapInPandas(set_bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
        words = np.zeros(bits // 64 + 1, np.uint64)
        words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
        levels.append(Level(bits, hashes, words))
        through = _tester(keys, levels[-1], number)
        # What the level lets through wrongly is encoded by the next, against what this one encoded.
        keys = written(keys.where(F.col("inside") | through("h1", "h2")).withColumn("inside", ~F.col("inside")), "keys")


def _probe(parts: DataFrame, cascade: Cascade, shard: int, shards: int) -> DataFrame:
    """``parts`` with ``listed`` set where the cascade of a shard holds the host or a domain above it."""
    shared = parts.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def any_listed(first: pd.Series, second: pd.Series) -> pd.Series:
        at = np.cumsum([0] + [len(x) for x in first])
        if not at[-1]:
            return pd.Series(np.zeros(len(first), bool))
        found = shared.value.contains(np.concatenate(first.tolist()), np.concatenate(second.tolist()))
        sums = np.concatenate([[0], np.cumsum(found)])
        return pd.Series(sums[at[1:]] > sums[at[:-1]])

    own = parents(F.col("host"))
    own = own if shards == 1 else F.filter(own, lambda k: shard_of(key_hashes(k)[1], shards) == shard)
    return parts.withColumn("listed", F.col("listed") | any_listed(F.transform(own, lambda k: key_hashes(k)[0]), F.transform(own, lambda k: key_hashes(k)[1])))


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of every row of ``pages`` (columns page_id and url).

    ``listed`` (column ``key``) holds domains that block themselves and all below. ``verdict`` is
    the longest fitting rule's, else block for a listed host and allow for any
    other. A null URL or one without ``://`` has an empty host and path, which is a
    key like any other. Repeated rows come out as they are; an empty table or list works.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = universe_keys(listed, parts.select(F.explode(parents(F.col("host"))).alias("key")))
    shards = n_shards(keys, shard_bytes)
    judged = parts.withColumn("listed", F.lit(False))
    for shard in range(shards):
        if shard:
            judged = written(judged, "probed")  # so that no task holds more than one shard
        judged = _probe(judged, build(keys if shards == 1 else keys.where(shard_of(F.col("h2"), shards) == shard)), shard, shards)
    rule, verdict = first_rule(rules, F.col("host"), F.col("path"))
    otherwise = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, otherwise).alias("verdict"), "listed")
