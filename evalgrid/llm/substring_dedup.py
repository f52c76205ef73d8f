"""Repeated lines and sentences: hash units, keep the earliest, cut out the rest.

A unit is a line that isn't blank, and each sentence of at least ``MIN_WORDS`` words within
it, so a passage that was pasted into the middle of a line is found as well. A shorter sentence counts
together with those after it, and with those before it, that make up so many words. Units are
compared in lower case with their white space collapsed, by a 128-bit digest.

The digests of all documents are counted; partial aggregation keeps one row for each digest
and task, however common a line is. Digests that occur once fall out, and only units of the others are kept and grouped for their earliest
occurrence, by doc_id and then by place. That one stays; the others come back as spans of their own
document, in code points of the original text. Both joins are plain equi-joins of written tables,
which the adaptive planner splits where a digest is hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evalgrid.llm.common import modest_batches, written

#: Shorter sentences within a line are removed only with their neighbours.
MIN_WORDS = 8
#: Rows and bytes of texts that a worker is handed at once, and rows whose units it holds as strings; units are several times the size of their text.
ROWS, BYTES, SOME = 250, 2 << 20, 50
#: Runs of sentence ends and what stands between them are taken as wholes, so no line takes longer than in proportion to its length.
_SENTENCE = re.compile(r"\S(?:[^.!?]++|[.!?]++(?!\s))*+(?:[.!?]++\s*+)?")


def units(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, int, str]]:
    """``(start, stop, normalised text)`` of the units of a text; lines come before sentences."""
    found, at = [], 0
    parts: list[tuple[int, int, list[str], bool]] = []
    lines = set()
    for line in text.split("\n") if text else ():
        words = line.lower().split()
        if words:
            found.append((at, at + len(line) + 1, " ".join(words)))
            spans = [m.span() for m in _SENTENCE.finditer(line)]
            lines.add((len(parts), len(parts) + len(spans)))
            parts += [(at + low, at + high, line[low:high].lower().split() if len(spans) > 1 else words, len(spans) > 1) for low, high in spans]
        at += len(line) + 1
    runs = set()
    for k, (_, _, own, within) in enumerate(parts):
        if within:
            for way in (1, -1):
                last, n = k, len(own)
                while n < min_words and 0 <= last + way < len(parts):
                    last += way
                    n += len(parts[last][2])
                if n >= min_words:
                    runs.add((min(k, last), max(k, last) + 1))
    found += [(parts[i][0], parts[j - 1][1], " ".join(w for p in parts[i:j] for w in p[2])) for i, j in sorted(runs - lines)]
    return found


def _unit_table(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each unit: its digest, its document's key and its place."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), SOME):
                part = batch.iloc[low : low + SOME]
                found = [units(t, min_words) for t in part["text"]]
                flat = [u for doc in found for u in doc]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(u[2].encode("utf-8", "surrogatepass")) for u in flat), np.int64).reshape(-1, 2)
                n = [len(doc) for doc in found]
                yield pd.DataFrame(
                    {
                        "h1": digests[:, 0],
                        "h2": digests[:, 1],
                        "doc_id": part["doc_id"].repeat(n).to_numpy(),
                        "sign": part["sign"].repeat(n).to_numpy(),
                        "start": np.array([u[0] for u in flat], np.int32),
                        "stop": np.array([u[1] for u in flat], np.int32),
                    }
                )

    modest_batches(docs.sparkSession, ROWS, BYTES)
    return _keyed(docs).where("text IS NOT NULL").mapInPandas(cut, "h1 long, h2 long, doc_id long, sign long, start int, stop int")


def _sign() -> Column:
    return F.xxhash64(F.col("text").cast("string"), F.length(F.col("text").cast("string")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _sign().alias("sign"), F.col("text").cast("string").alias("text"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every unit but the earliest of its digest: ``doc_id, sign, start, stop, first_doc_id, first_start``.

    Start and stop are code points of the original text; stop is after the white
    space or line break that ends the unit. Null and empty texts have no units.
    Rows that repeat doc_id and text are one document. A null doc_id comes before
    all others.
    """
    found = _unit_table(docs, min_words)
    place = F.struct("doc_id", "sign", "start")
    several = written(found.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "several")
    repeated = written(found.join(several, ["h1", "h2"]), "repeated-units")
    firsts = written(repeated.groupBy("h1", "h2").agg(F.min(place).alias("first")), "firsts")
    return (
        repeated.join(firsts, ["h1", "h2"])
        .where(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "sign", "start", "stop", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))
        .distinct()
    )


def without(text: str, starts: np.ndarray, stops: np.ndarray) -> str:
    """``text`` without the given spans, which may overlap."""
    out, at = [], 0
    for low, high in sorted(zip(starts, stops, strict=True)):
        if low > at:
            out.append(text[at:low])
        at = max(at, high)
    out.append(text[at:])
    return "".join(out)


@F.pandas_udf(StringType())
def _cut_out(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if s is None else without(t, [x["start"] for x in s], [x["stop"] for x in s]) for t, s in zip(text, spans, strict=True)])


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``, and their original places in ``removed`` (null: none).

    All other columns stay; a column that is named ``removed`` already is
    replaced. An empty table gives an empty one.
    """
    spans = repeats(docs, min_words).groupBy(F.col("doc_id").alias("__id"), F.col("sign").alias("__sign")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    columns = [c for c in docs.columns if c != "removed"]
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (_sign() == F.col("__sign")), "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.col("__cut"))
    return joined.withColumn("__cut", _cut_out(F.when(F.col("__spans").isNotNull(), F.col("text")), "__spans")).select(
        *[text.alias(c) if c == "text" else F.col(c) for c in columns], F.col("__spans").alias("removed")
    )
