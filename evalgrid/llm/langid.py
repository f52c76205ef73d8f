"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams in order of frequency.
A document's own n-grams are ranked the same way, and the language whose profile
is least out of place wins: each n-gram of the document adds the difference of
the two ranks, or the profile's length where the profile lacks it.

The n-grams are runs of one to three letters or word ends (a blank) and never
cross a word. Up to three code points fit one 64-bit integer, so n-grams are
counted without hashing and without collisions.

Profiles are counted over every labelled document: each partition counts its own
n-grams, the counts are summed by key, and the first ``PROFILE_SIZE`` of each
language are kept. What reaches the driver, and then every task, is at most
``PROFILE_SIZE`` rows for each language tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.llm.common import modest_batches

#: N-grams kept of each language and of each document.
PROFILE_SIZE = 400
#: A partition's pending n-grams are summed up when there are so many.
_PENDING = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
#: Word characters that are numbers but not decimal digits, such as one half or a circled one: no letters either. Sets of plain
#: characters of the first plane are fast; those beyond it are looked at one by one.
_NUMBER = re.compile("[{}]".format("".join(c for c in map(chr, range(1 << 16)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())))
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _letters_only(text: str) -> str:
    """``text`` with blanks for those numbers."""
    return _BEYOND.sub(lambda m: m[0] if m[0].isalpha() else " ", _NUMBER.sub(" ", text))


def grams(text: str | None) -> np.ndarray:
    """The n-grams of a text as integers, repeats included; none without letters."""
    text = text.lower() if text else ""
    words = _WORD.findall(text if text.isascii() else _letters_only(text))
    if not words:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = ((two[:-1] << 21) | c[2:])[c[1:-1] != 32]
    return np.concatenate([c[c != 32], two, three])


def _count(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with their counts or sums of weights."""
    if weights is not None:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    else:
        values = np.sort(values)
    if not len(values):
        return values, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    n = np.diff(np.append(first, len(values))) if weights is None else np.add.reduceat(weights, first)
    return values[first], n


class _Counter:
    def __init__(self) -> None:
        self.total = (np.empty(0, np.int64), np.empty(0, np.int64))
        self.pending: list[np.ndarray] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        self.pending.append(values)
        self.size += len(values)
        if self.size >= _PENDING:
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        if self.pending:
            v, n = _count(np.concatenate(self.pending))
            self.total = _count(np.concatenate([self.total[0], v]), np.concatenate([self.total[1], n]))
            self.pending, self.size = [], 0
        return self.total


def _partition_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    by_lang: dict[str, _Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            by_lang.setdefault(lang, _Counter()).add(grams(text))
    for lang, counter in by_lang.items():
        g, n = counter.sum()
        yield pd.DataFrame({"lang": lang, "gram": g, "n": n})


def profiles(labelled: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """``lang, gram, rank`` (from 0) of each language's ``size`` most frequent n-grams.

    ``labelled`` has ``text`` and ``lang``; rows where either is null are left
    out. Equal counts are ranked by the n-gram's code.
    """
    modest_batches(labelled.sparkSession)
    counts = (
        labelled.select("lang", "text")
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInPandas(_partition_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


class Model:
    """Profiles side by side: a row of ranks for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE_SIZE) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[at[lang], np.searchsorted(self.grams, gram)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language that is least out of place (ties: first in order), and 1 less its share of the worst distance."""
        g, n = _count(grams(text))
        if not len(g) or not self.langs:
            return "und", 0.0
        top = g[np.argsort(-n, kind="stable")[: self.size]]
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != top] = len(self.grams)
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top), dtype=np.int32))).sum(axis=1)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(top)))


def fit(labelled: DataFrame, size: int = PROFILE_SIZE) -> Model:
    return Model([tuple(r) for r in profiles(labelled, size).collect()], size)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) of every whole text.

    A null text, a text without a letter, or a model that has learned nothing
    gives ``und`` and 0. Other columns, nulls among them, pass through; columns
    named like the two new ones are replaced. An empty table gives an empty one.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang", "score"])

    guess = "__guess"
    return (
        docs.drop("lang_pred", "score")
        .withColumn(guess, predict(F.col("text").cast("string")))
        .withColumn("lang_pred", F.col(f"{guess}.lang"))
        .withColumn("score", F.col(f"{guess}.score"))
        .drop(guess)
    )


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, mod 4, is 2 (null: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` with profiles learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
