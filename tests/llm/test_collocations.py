"""Phrases against a plain count of everything; groups of every size, hot words, clashing hashes and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalgrid.llm import collocations, queries
from evalgrid.llm.sql import ORACLES
from tests.parity import DATA, check, connect

DOCS = "doc_id long, text string, lang string, rank string, n string, h string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "x", "y", "z") for k, (lang, t) in enumerate(rows)], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, top=2000, least=10, covered=50):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= covered * a for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in frame.collect())


def prose(seed, n=150, hot=0.3):
    rnd = random.Random(seed)
    vocabulary = ["the", "Of", "AND", "é", "naïve", "x"] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(n):
        words = [rnd.choice(vocabulary[:3]) if rnd.random() < hot else rnd.choice(vocabulary) for _ in range(rnd.randrange(120))]
        if rnd.random() < 0.4:
            words += "New York city hall".split() * rnd.randrange(1, 4)
        rows.append((rnd.choice(["en", "de", None, "und"]), "".join(w + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "!?"]) for w in words)))
    return rows


@pytest.mark.parametrize("budget", [1 << 20, 300, 7])
def test_groups_of_every_size(spark, budget, monkeypatch):
    monkeypatch.setattr(collocations, "TEXT", 5000)
    rows = prose(3)
    assert got(collocations.collocations(docs(spark, rows), budget=budget)) == brute(rows)


def test_hot_line_and_short_lists(spark):
    rows = prose(4, 40) + [("en", "buy now buy now buy now, click here")] * 300
    assert got(collocations.collocations(docs(spark, rows), budget=50)) == brute(rows)
    few = got(collocations.collocations(docs(spark, rows), top=5, least=3, covered=101))
    assert few == brute(rows, top=5, least=3, covered=101) and len(few) == 15


def test_odd_rows(spark):
    rows = [(None, None), ("en", None), ("en", ""), ("en", " \t\n"), ("en", ".,;!"), (None, "a\x00b é 日本 🙂 a\x00b é 日本 🙂 " * 6), ("fr", "x\x1cy \xa0 x\x1cy \xa0 " * 7), ("", "no lang " * 11), ("en", "ÀB àb ÀB àb " * 10), ("en", "of " * 30_000), ("en", "lone"), ("en", ("ab" * 4000 + " end ") * 12)]
    assert got(collocations.collocations(docs(spark, rows))) == brute(rows)
    assert got(collocations.collocations(docs(spark, []))) == []
    assert got(collocations.collocations(docs(spark, [("en", None)]))) == []


def test_long_text_is_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TEXT", 64)
    rows = [("en", "one two three four, five six seven. " * 40), ("en", "one two three four " * 40)]
    assert got(collocations.collocations(docs(spark, rows))) == brute(rows)


def test_clashing_words_are_seen():
    words = collocations.Words([("en", b"Aa bb aa cc bb"), ("de", b"aa")], 0)
    assert len(set(words.hashes.tolist())) == 4
    words.hashes[:] = words.hashes[0]
    hashes, place, n = words.distinct()
    assert {(words.bytes[words.starts[k] : words.ends[k]], words.lang[k] > 0) for k in place} == {(b"aa", False), (b"bb", False), (b"cc", False), (b"aa", True)} and n.sum() == 6


def test_exact_score_beyond_64_bits(spark):
    a = 900_000_000_000
    frame = spark.range(1).selectExpr(f"{a}L AS a", f"{3 * a}L AS l", f"{7 * a}L + 1 AS r")
    assert frame.select(collocations.score(*(frame[c] for c in "alr"))).first()[0] == 1_000_000 * a * a // (3 * a * (7 * a + 1))


def test_groups_keep_within_the_budget():
    rnd = np.random.default_rng(1)
    loads = {int(k): int(n) for k, n in enumerate(rnd.integers(0, 50, collocations.BINS))}
    groups = collocations.Groups(loads, [], 1000)
    total = Counter()
    for k, n in loads.items():
        total[int(groups.base[k])] += n
    assert max(total.values()) <= 1000 and len(total) < 1.2 * sum(loads.values()) / 1000


def test_query_equals_sql(spark):
    check(spark, connect(), queries.QUERIES["op11_collocations"], ORACLES["op11_collocations"])
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "text").collect()]
    assert got(queries.QUERIES["op11_collocations"](spark, DATA)) == brute(rows)
