"""Runs of words against their definition; digests, odd rows and long texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from evalgrid.llm import periodic, queries
from tests.parity import DATA

DOCS = "doc_id long, text string, runs string, best string, start string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS)


def brute(words):
    """All runs by their definition."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q] if i > start else []
            if len(stretch) >= max(6, 4 * q) and not any(all(a == b for a, b in zip(stretch, stretch[p:], strict=False)) for p in range(1, q)):
                found.append((start, len(stretch), q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def row(doc_id, text, planted=False):
    """What the query is to return, straight from its definition."""
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if planted and h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *numbers, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_small_alphabets_and_planted_tails():
    rnd = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randrange(1, 6)):
            n = rnd.randrange(90)
            words = [rnd.randrange(rnd.choice([1, 2, 2, 3, 5])) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = min(rnd.randrange(1, 14), n - a)
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            texts.append(words)
        text, start, length, period = periodic.runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]))
        for k, words in enumerate(texts):
            assert [(s, n, q) for t, s, n, q in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True) if t == k] == brute(words)


def test_fewer_times_are_refused():
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(9, np.int64), np.array([9]), times=3)


def test_range_successor_of_the_wavelet_tree():
    rnd = np.random.default_rng(2)
    values = rnd.permutation(300).astype(np.int32)
    tree = periodic.Wavelet(values)
    low, high = np.sort(rnd.integers(0, 301, (2, 500)), axis=0)
    x = rnd.integers(-3, 600, 500)
    assert tree.less(low, high, x).tolist() == [int((values[a:b] < y).sum()) for a, b, y in zip(low, high, x, strict=True)]
    some = high > low
    r = ((high - low) * rnd.random(500)).astype(np.int64)
    assert tree.nth(low[some], high[some], r[some]).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(low[some], high[some], r[some], strict=True)]


def test_query_equals_definition(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(row(i, t, planted=True) for i, t in rows)
    assert sum(w[1] > 0 for w in want) > 10
    assert got(queries.QUERIES["op13_periodic_runs"](spark, DATA)) == want


def test_odd_rows(spark):
    hot = "buy now " * 40_000
    nested = ("a a a a a a b " * 6) + "x " + ("c d " * 9)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x " * 6), (5, "x " * 5), (6, nested), (7, "a\x00b é 日本 🙂 " * 5), (8, "no\xa0break " * 4), (9, "w\x1cv " * 7)]
    assert got(periodic.digests(periodic.periodic_runs(docs(spark, rows)))) == sorted(row(i, t) for i, t in rows)
    found = periodic.periodic_runs(docs(spark, [(1, hot), (None, "y " * 8), (1, hot)])).collect()
    assert sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found) == [(0, [(0, 8, 1)], "y"), (1, [(0, 80_000, 2)], "buy now"), (1, [(0, 80_000, 2)], "buy now")]
    assert periodic.digests(periodic.periodic_runs(docs(spark, []))).count() == 0


def test_ties_of_the_strongest_run(spark):
    text = "a a a a a a x b b b b b b y " + "c d " * 6
    best = periodic.digests(periodic.periodic_runs(docs(spark, [(1, text)]))).first()
    assert (best["start"], best["length"], best["period"], best["exponent_milli"], best["n_runs"]) == (0, 6, 1, 6000, 3)
