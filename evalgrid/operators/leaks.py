"""Leak checks over manuals: forbidden words, years, task overlap and answers, as rules with waivers and warnings.

Words are matched between characters that are neither letters, digits nor underscores, in any script. Matching doubles
those characters first, so two matches side by side don't share one; the same patterns then mean the same in Java and RE2.
N-grams never leave the scan: the known ones go out in parts of bounded size, and each part is one pass over the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions import text as t
from evalgrid.sources.files import kept

#: Fixed values of the gate: words that compare designs, and words of the evaluation itself.
FORBIDDEN = ("era", "version", "modern", "older", "newer", "legacy", "newest", "latest", "outdated", "contemporary", "retro", "old-fashioned", "old-style", "dated")
PERFORMANCE = ("success rate", "difficulty", "benchmark", "agent", "reward", "episode", "task success", "score of")
NEUTRAL = ("newest", "latest", "most recent", "state of the art")
N_VERSIONS, NEUTRAL_VERSION, EXAMPLES = 6, "v6", 8
#: Words of an n-gram, and n-grams that are sent to the tasks at a time.
N, MOST_GRAMS = 6, 1_000_000
_OUTSIDE = r"[^\p{L}\p{N}_]"
#: The same for years and version keys.
YEAR, VERSION_KEY = "(?:19|20)[0-9]{2}", f"v[1-{N_VERSIONS}]"


def doubled(text: Column) -> Column:
    """``text`` with every character between words twice."""
    return F.regexp_replace(text, f"({_OUTSIDE})", "$1$1")


def pattern(word: str, literal: bool = True) -> str:
    """The pattern of a word, or of an expression for one, in doubled text."""
    inner = re.sub(r"([^\w])", r"\1\1", word) if literal else word
    return rf"(?:^|{_OUTSIDE}){inner}(?:$|{_OUTSIDE})"


def _times(text: Column, found: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(found), 0)).cast("long")


class _Codes(dict):
    """The 64-bit codes of the words that a worker has met last; forgetting some changes nothing."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = code = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return code


_codes, _PRIME = _Codes(), np.uint64(0x9E3779B97F4A7C15)


def gram_codes(words: list[str]) -> np.ndarray:
    """A 64-bit code of each n-gram of a text, in order."""
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    n = len(codes) - N + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(N if n > 0 else 0):
        out = (out ^ codes[i : i + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return out


class Known:
    """N-grams that are looked for, as sorted codes: 8 bytes each, and a bitmap that most others fail."""

    def __init__(self, grams: Iterator[str]) -> None:
        self.codes = np.unique(np.concatenate([np.empty(0, np.uint64), *(gram_codes(g.split(" ")) for g in grams)]))
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.codes >> np.uint64(42)).astype(np.int64)] = True

    def within(self, words: list[str]) -> set[str]:
        """The n-grams of a text that have a known code."""
        codes = gram_codes(words)
        at = np.flatnonzero(self.bitmap[(codes >> np.uint64(42)).astype(np.int64)])
        if not len(at):
            return set()
        place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        return {" ".join(words[i : i + N]) for i in at[self.codes[place] == codes[at]].tolist()}


def shared_grams(docs: DataFrame, key: str, text: Column, known: DataFrame) -> DataFrame:
    """``key, gram``: a row for each distinct n-gram of a row's ``text`` that ``known`` (column ``gram``) has.

    Known n-grams go out as 64-bit codes, ``MOST_GRAMS`` (8 MB a million) at a time, dealt by a hash; n-grams of the texts are never rows and never
    shuffled. Only hits are: they are joined to the known n-grams, so a code that two share does no harm.
    """
    spark = docs.sparkSession
    grams = known.where("gram IS NOT NULL").select("gram").distinct()
    parts = max(1, -(-grams.count() // MOST_GRAMS))
    texts, out = docs.select(key, text.alias("text")), None
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, gram string"
    for part in range(parts):
        own = grams if parts == 1 else grams.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(Known(r["gram"] for r in own.toLocalIterator()))

        def probe(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            word = re.compile(t.WORD)
            for batch in batches:
                keys, hits = [], []
                for k, x in zip(batch[key], batch["text"], strict=True):
                    found = shared.value.within(word.findall(x.lower())) if x else ()
                    keys += [k] * len(found)
                    hits += found
                yield pd.DataFrame({key: pd.Series(keys, dtype=batch[key].dtype), "gram": pd.Series(hits, dtype="object")})

        found = texts.mapInPandas(probe, schema)
        out = found if out is None else out.unionByName(found)
    return out.join(grams, "gram", "left_semi").select(key, "gram")


def grams_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, gram``: the distinct n-grams of a table of short texts, such as intents."""
    return df.select(key, F.explode(t.ngrams(F.col(text), N)).alias("gram"))


def leak_check(manuals: DataFrame, intents: DataFrame, scouted: DataFrame, themes: tuple[str, ...] = (), answers: tuple[str, ...] = (), warned: tuple[str, ...] = (), affordances: bool = True) -> DataFrame:
    """``id, rule, kind, match, n`` for every rule that fires on a manual; ``kind`` is hit, waived or warning.

    ``manuals`` has ``id, text, version`` and ``labels`` (what the site's own pages say, in lower case): a forbidden
    word within a label is waived. ``intents`` and ``scouted`` have ``intent``: an n-gram shared with the first is a hit once an
    intent, waived where a scouted intent explains it; those of the second may stand in section 8 alone. ``answers`` may
    stand nowhere and are never waived; ``warned`` ones give warnings. Years are forbidden in sections 1 to 6, unless
    ``affordances`` is off.
    """
    low = F.lower("text")
    m = manuals.select("id", "version", "text", low.alias("low"), F.expr("aggregate(labels, lower(text), (x, label) -> replace(x, label, ' '))").alias("bare"))
    row = lambda rule, kind, match, n: F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), match.alias("match"), n.cast("long").alias("n"))
    every = [w for words in (FORBIDDEN, PERFORMANCE, NEUTRAL) for w in words]
    some = rf"(?:^|{_OUTSIDE})(?:{'|'.join([*map(re.escape, dict.fromkeys(every)), VERSION_KEY])})(?:$|{_OUTSIDE})"
    m = m.withColumn("any", F.rlike("low", F.lit(some)))
    m = m.withColumn("whole", F.when(F.col("any"), doubled(F.col("low")))).withColumn("left", F.when(F.col("any"), doubled(F.col("bare"))))
    fired = []
    for rule, words in (("1-comparative", FORBIDDEN), ("4-performance", PERFORMANCE), ("5-neutral-era", NEUTRAL)):
        for w in words:
            on = F.col("any") & (F.col("version") == NEUTRAL_VERSION) if rule[0] == "5" else F.col("any")
            hits = F.when(on, _times(F.col("left"), pattern(w)))
            fired += [row(rule, "hit", F.lit(w), hits), row(rule, "waived", F.lit(w), F.when(on, _times(F.col("whole"), pattern(w))) - hits)]
    fired += [row("1-version-key", "hit", F.lit("v"), F.when(F.col("any"), _times(F.col("whole"), pattern(VERSION_KEY, False))))]
    fired += [row("1-theme-name", "hit", F.lit(x), F.contains("low", F.lit(x))) for x in map(str.lower, themes)]
    if affordances:
        bodies = F.array_join(F.filter(F.map_values(F.map_filter(t.sections(F.col("text")), lambda k, _: k <= 6)), lambda x: F.rlike(x, F.lit(YEAR))), "\n")
        fired += [row("2-year-in-affordance", "hit", F.lit("year"), F.when(F.rlike("low", F.lit(YEAR)), _times(doubled(bodies), pattern(YEAR, False))))]
    tidy = F.regexp_replace("low", r"[ \t\n\r\f\x0B]+", " ")
    for rule, kind, strings in (("6-answer-leak", "hit", answers), ("6w-test-answer-coincidence", "warning", warned)):
        for a in (x for x in (" ".join(s.lower().split()) for s in strings) if len(x) >= 4):
            n = F.when(F.contains("low", F.lit(a.split()[0])), (F.length(tidy) - F.length(F.replace(tidy, F.lit(a), F.lit("")))) / len(a))
            fired += [row(rule, kind, F.lit(a), n)]
    said = m.select("id", F.explode(F.filter(F.array(*fired), lambda x: x.n > 0)).alias("x")).select("id", "x.*")

    mine, theirs = grams_table(scouted, "intent", "intent"), grams_table(intents, "intent", "intent")
    texts = manuals.select("id", "text")
    # One pass over the texts looks for the n-grams of both lists; its hits are few and kept.
    both = kept(shared_grams(texts, "id", F.col("text"), theirs.select("gram").unionByName(mine.select("gram"))), "shared-grams")
    shared = both
    # Hits are few; each is looked up among the intents and the scouted n-grams.
    judged = shared.join(theirs, "gram").join(mine.select("gram", F.lit(True).alias("known")).distinct(), "gram", "left").groupBy("id", "intent").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("explained"))
    overlap = judged.groupBy("id", F.when(F.col("explained"), "waived").otherwise("hit").alias("kind")).agg(F.count("*").alias("n"))
    # Only manuals with a scouted n-gram anywhere can hold one within a section.
    some = both.join(mine.select("gram").distinct(), "gram", "left_semi").select("id").distinct()
    bodies = texts.join(some, "id", "left_semi").select("id", F.explode(t.sections(F.col("text"))).alias("k", "body")).where(F.col("k") != EXAMPLES)
    inside = shared_grams(bodies, "id", F.col("body"), mine).join(mine, "gram").groupBy("id").agg(F.count_distinct("intent").alias("n"))
    named = lambda df, rule, kind: df.select("id", F.lit(rule).alias("rule"), kind.alias("kind"), F.lit("n-gram").alias("match"), "n")
    return said.unionByName(named(overlap, "3-task-overlap", F.col("kind"))).unionByName(named(inside, "3b-scouted-outside-section8", F.lit("hit")))
