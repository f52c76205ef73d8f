"""Mixing sources to target weights: soft memberships, then nonnegative document rates.

1. *Posteriors.* A classifier learns the domains from a labelled table: from all its rows, or from the
   ``LABELLED`` that come first by a hash of their id. A feature is a word, the beginning of a longer one, or the share of words
   that repeat the one before; how often or where doesn't matter, so evidence doesn't fade in long texts. A domain's marks are the features that
   more of its documents hold than chance explains, and a document's evidence for it is the sum of their log ratios.
   Posteriors are the shares of the domains among labelled documents with like evidence, each judged by marks learned
   without it; so they are as soft as the evidence, and expected totals are those of the labels.
2. *Rates.* Document i has t_i tokens and belongs to domain d with probability p_id. Its rate
   r_i >= 0 is how often it enters the mixture, and A r, with A_di = t_i p_id, is the expected
   number of tokens of each domain. Accelerated projected gradient steps minimise
   |W (A r - target)|^2 / 2 + ridge |r - 1|^2 / 2 over r >= 0, the rows weighed by W so
   that domains of different sizes converge alike. A step needs only the residual of A r, one number
   for each domain, which a distributed sum gives; a document's own rate follows from its
   t_i, p_i and the residuals so far, so rates are never stored between steps nor sent
   anywhere. ``STEPS`` of them, at most, are replayed in numpy on each batch. How far the totals stay from targets that
   can't be met comes back as ``gap``.
3. *Copies.* A document enters floor(rate) times, and once more if a hash of its id falls below the
   fraction, so expected totals match the targets without a random state.

Tokens are words between white space, unless a column of counts is named (such as those of ``tokencount``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import modest_batches, written

#: Labelled documents that the classifier learns from at most.
LABELLED = 20_000
#: Letters of a longer word that are a feature of their own; longer features than that many letters aren't kept.
STEM, LONGEST = 5, 40
#: Percents of words that repeat the one before, from which on they are a feature.
REPEATED = (5, 20, 40)
#: Least evidence (the negative log of the chance's bound) that a feature is a mark, and bounds of the levels of evidence.
MARK, LEVELS = 6.0, (0.0, 2.0, 4.0, 6.0, 9.0)
#: Most gradient steps, relative distance from the targets at which they end (and a fraction of it, that totals still move by when they have settled), and the pull of rates to 1.
STEPS, CLOSE, SETTLED, RIDGE = 100, 1e-3, 0.02, 1e-4
_WORD = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None) -> set[str]:
    """Words in lower case and runs of punctuation, beginnings of longer words (with ``~``), and ``=`` with percents of words, as many as repeat the one before."""
    text = text.lower() if text else ""
    found, words = set(_WORD.findall(text)), text.split()
    found |= {w[:STEM] + "~" for w in found if len(w) > STEM}
    found = {w for w in found if len(w) <= LONGEST}
    again = sum(map(eq, words, words[1:]))
    found.update(f"={share}" for share in REPEATED if again * 100 >= share * len(words) > 0)
    return found


def _surprise(c, expected):
    """A bound on -log P(at least c) of a count with that expectation (Chernoff's, of Poisson's law); 0 if it isn't above."""
    return np.where(c > expected, c * np.log(np.maximum(c, 1e-9) / expected) - c + expected, 0.0)


class Classifier:
    """Marks of each domain with their counts, and the posteriors by level of evidence.

    ``marks[d]`` has, for each feature, the labelled documents of the domain and of all that hold it; ``documents``
    counts the labelled ones of each domain.
    """

    def __init__(self, domains: list[str], marks: list[dict[str, tuple[int, int]]], documents: np.ndarray) -> None:
        self.domains, self.marks, self.documents = domains, marks, documents
        self.weights = [{f: self._weight(d, c, every) for f, (c, every) in own.items()} for d, own in enumerate(marks)]
        self.cells: dict[tuple[int, int], np.ndarray] = {}
        self.prior = (documents + 1) / (documents + 1).sum()

    def _weight(self, d: int, c: int, every: int, without: int = 0) -> float:
        """The log ratio of a mark, or 0 if it isn't one once a document of the domain is left out."""
        n, other = self.documents[d] - without, self.documents.sum() - self.documents[d]
        c, every = c - without, every - without
        if n < 1 or every < 1 or _surprise(np.float64(c), every * n / (n + other)) < MARK:
            return 0.0
        return float(np.log((c + 0.5) / (n + 1)) - np.log((every - c + 0.5) / (other + 1)))

    def cell(self, found: set[str], own: int | None = None) -> tuple[int, int]:
        """The domain with the most evidence, and its level; for a labelled document of domain ``own`` as if it hadn't been learned from."""
        best, at = 0.0, 0
        for d, weights in enumerate(self.weights):
            held = found & weights.keys()
            score = sum(self._weight(d, *self.marks[d][f], without=1) if d == own else weights[f] for f in held)
            if score > best:
                best, at = score, d
        level = sum(best > x for x in LEVELS)
        return (at, level) if level else (0, 0)

    def posteriors(self, text: str | None) -> np.ndarray:
        """Probabilities of the domains; a text without words has the prior's."""
        found = features(text)
        return self.cells.get(self.cell(found), self.prior) if found else self.prior

    def learn_cells(self, counts: dict[tuple[int, int], np.ndarray]) -> None:
        """Posteriors from counts of labelled documents; a cell with few leans to its own domain's share of all cells of its level and above."""
        for d in range(len(self.domains)):
            for level in range(1, len(LEVELS) + 1):
                near = sum((n for (e, m), n in counts.items() if e == d and m >= level), np.zeros(len(self.domains)))
                lean = near + self.prior if near.any() else self.prior + np.eye(len(self.domains))[d]
                own = counts.get((d, level), np.zeros(len(self.domains))) + 2 * lean / lean.sum()
                self.cells[d, level] = own / own.sum()
        none = counts.get((0, 0), np.zeros(len(self.domains))) + self.prior
        self.cells[0, 0] = none / none.sum()


def fit(labelled: DataFrame, domains: list[str]) -> Classifier:
    """Learns from every row of ``labelled`` (``text, domain``) whose domain is among ``domains``.

    Only counts of marks and of cells reach the driver; what isn't a mark stays in the aggregate.
    """
    spark, at = labelled.sparkSession, {d: i for i, d in enumerate(domains)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[tuple[int, str]] = Counter()
        for batch in batches:
            for domain, text in zip(batch["domain"], batch["text"], strict=True):
                found.update((at[domain], f) for f in features(text))
                found[at[domain], ""] += 1
            if len(found) > 500_000:
                yield table(found)
                found.clear()
        yield table(found)

    table = lambda found: pd.DataFrame([(d, f, n) for (d, f), n in found.items()], columns=["d", "f", "n"])
    rows = labelled.where(F.col("domain").isin(domains)).select("domain", "text")
    counted = written(rows.mapInPandas(count, "d int, f string, n long").groupBy("d", "f").agg(F.sum("n").alias("n")), "features")
    documents = np.zeros(len(domains))
    for d, n in counted.where("f = ''").select("d", "n").collect():
        documents[d] = n
    all_ = max(documents.sum(), 1)
    share = F.element_at(F.array(*[F.lit(float(x / all_)) for x in documents]), F.col("d") + 1)
    every = counted.where("f <> ''").groupBy("f").agg(F.sum("n").alias("every"))
    expected = F.col("every") * share
    surprise = F.when(F.col("n") > expected, F.col("n") * F.log(F.col("n") / expected) - F.col("n") + expected).otherwise(0.0)
    found = counted.join(every, "f").where(surprise >= MARK).select("d", "f", "n", "every").collect()
    marks: list[dict[str, tuple[int, int]]] = [{} for _ in domains]
    for d, f, n, total in found:
        marks[d][f] = (n, total)
    model = Classifier(domains, marks, documents)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, found = shared.value, Counter()
        for batch in batches:
            for domain, text in zip(batch["domain"], batch["text"], strict=True):
                if own := features(text):
                    found[(*model.cell(own, at[domain]), at[domain])] += 1
        yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lead", "level", "d", "n"])

    counts: dict[tuple[int, int], np.ndarray] = {}
    for lead, level, d, n in rows.mapInPandas(judge, "lead int, level int, d int, n long").groupBy("lead", "level", "d").agg(F.sum("n")).collect():
        counts.setdefault((lead, level), np.zeros(len(domains)))[d] = n
    model.learn_cells(counts)
    return model


def memberships(docs: DataFrame, model: Classifier, found: Rates | None = None, tokens: str | None = None) -> DataFrame:
    """``docs`` with ``posteriors``, in the order of the model's domains, the text's ``n_tokens``, and the ``rate`` once rates are found.

    ``tokens`` names a column of token counts; without one they are the words between white space.
    One Python step computes them all, so a task needs one Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, found))

    @F.pandas_udf("p array<double>, n long, rate double")
    def soft(texts: pd.Series, given: pd.Series) -> pd.DataFrame:
        model, found = shared.value
        p = [model.posteriors(t) for t in texts]
        n = [(len(t.split()) if t else 0) if pd.isna(g) else int(g) for t, g in zip(texts, given, strict=True)]
        rate = found.of(np.stack(p), np.array(n, float)) if found and len(p) else np.ones(len(p))
        return pd.DataFrame({"p": p, "n": n, "rate": rate})

    columns = {"posteriors": "p", "n_tokens": "n"} | ({"rate": "rate"} if found else {})
    given = F.col(tokens).cast("long") if tokens else F.lit(None).cast("long")
    out = docs.withColumn("__s", soft(F.col("text").cast("string"), given)).drop(*columns)
    return out.withColumns({c: F.col(f"__s.{x}") for c, x in columns.items()}).drop("__s")


def _replay(a: np.ndarray, weight: np.ndarray, step: float, ridge: float, residuals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps so far, and the extrapolated point where the next gradient is taken. Row i of ``a`` is t_i p_i."""
    r = y = np.ones(len(a))
    t = 1.0
    for residual in residuals:
        new = np.maximum(0.0, y - step * (a @ (weight**2 * residual) + ridge * (y - 1)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, r, t = new + (t - 1) / t_new * (new - r), new, t_new
    return r, y


class Rates:
    """What a document's rate follows from, besides its own tokens and posteriors: the residuals of all steps."""

    #: Largest distance of a domain's expected total from its target, as a share of the largest target.
    gap = 0.0

    def __init__(self, scale: float, weight: np.ndarray, step: float, ridge: float, residuals: list[np.ndarray]) -> None:
        self.scale, self.weight, self.step, self.ridge, self.residuals = scale, weight, step, ridge, residuals

    def of(self, posteriors: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return _replay(posteriors * tokens[:, None] / self.scale, self.weight, self.step, self.ridge, self.residuals)[0]


def solve(members: DataFrame, goal: np.ndarray, steps: int = STEPS, close: float = CLOSE, ridge: float = RIDGE) -> Rates:
    """The rates of a table of ``posteriors`` and ``n_tokens``, so that domains expect ``goal`` as shares of all tokens.

    Rows alike in both have one rate, so steps work on the distinct ones and how many there are of each.
    """
    k = len(goal)
    small = written(members.groupBy("posteriors", "n_tokens").agg(F.count("*").alias("n")), "distinct-members")
    scale = float(max(small.agg(F.sum(F.col("n_tokens") * F.col("n"))).first()[0] or 0, 1))

    def total(part) -> np.ndarray:
        """Sums the vectors that ``part`` makes of each batch's rows and of how many there are of each."""

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = None
            for batch in batches:
                if len(batch):
                    a = np.stack(batch["posteriors"].to_numpy()) * batch["n_tokens"].to_numpy(float)[:, None] / scale
                    x = np.ravel(part(a, a.T * batch["n"].to_numpy(float)))
                    out = x if out is None else out + x
            if out is not None:
                yield pd.DataFrame({"i": np.arange(len(out), dtype=np.int32), "x": out})

        rows = small.mapInPandas(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(max((r[0] for r in rows), default=-1) + 1)
        for i, x in rows:
            out[i] = x
        return out

    gram = total(lambda a, counted: counted @ a)
    gram = gram.reshape(k, k) if len(gram) else np.zeros((k, k))
    weight = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300)) if gram.any() else np.ones(k)
    step = 1 / (float(np.linalg.eigvalsh(weight[:, None] * gram * weight).max()) + ridge)
    residuals: list[np.ndarray] = []
    out = Rates(scale, weight, step, ridge, residuals)
    before, still = np.zeros(k), 0
    for i in range(steps + 1):
        # Both sums of a step come from one pass: that of the rates, and the residual where the gradient is taken.
        both = total(lambda a, counted: np.concatenate([counted @ x for x in _replay(a, weight, step, ridge, residuals)]))
        if not len(both):
            break
        out.gap = float(np.abs(both[:k] - goal).max() / max(goal.max(), 1e-300))
        still = still + 1 if np.abs(both[:k] - before).max() <= SETTLED * close * max(goal.max(), 1e-300) else 0
        before = both[:k]
        if i == steps or (residuals and (out.gap <= close or still == 3)):
            break
        residuals.append(both[k:] - goal)
    return out


def copies(rate: str = "rate", key: str = "doc_id"):
    """How often a document enters the mixture: the rate's floor, and one more with the fraction's probability by a hash of its id."""
    u = F.pmod(F.xxhash64(F.lit("copies"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < F.col(rate) - F.floor(rate)).cast("long")).cast("long")


#: Domains of the labelled table.
DOMAINS = ["plain", "poor", "toxic"]


def labelled_domains(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """``text, domain`` of up to ``most`` labelled documents; toxic before poor before plain where labels differ.

    The labels that are used number ``most`` at the most, so they are sent to the documents and no text is shuffled.
    """
    order = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(order).alias("o")).where("o IS NOT NULL")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), F.col("o") + 1)
    return docs.select("doc_id", "text").join(F.broadcast(marks.select("doc_id", domain.alias("domain"))), "doc_id").select("text", "domain")


def mixed(docs: DataFrame, labels: DataFrame, shares: dict[str, float], budget: float = 1.0, with_text: bool = True, tokens: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens, posteriors, rate, n_copies, gap``, mixed so that domains have the given shares of ``budget`` times all tokens.

    Null and empty texts have no tokens: their rate stays 1, and they get the prior's
    posteriors. Rows that share a doc_id are each given a rate. Labels that are null, or of
    unknown documents, teach nothing; without any label every document has the same posteriors.
    ``gap`` is how far the expected totals stay from the targets, as a share of the largest; over ``CLOSE`` the targets are out of reach
    (a domain that no document may belong to, say) and the rates are the nearest.
    Columns named like the new ones are replaced; an empty table gives an empty one. Without text,
    memberships are computed once and written; with it they are computed again beside the text.
    """
    modest_batches(docs.sparkSession)
    model = fit(labelled_domains(docs, labels), DOMAINS)
    docs, goal = docs.drop("rate", "n_copies", "gap"), np.array([shares[d] for d in DOMAINS]) * budget
    if with_text:
        found = solve(written(memberships(docs, model, tokens=tokens).select("posteriors", "n_tokens"), "memberships"), goal)
        return memberships(docs, model, found, tokens).withColumn("n_copies", copies()).withColumn("gap", F.lit(found.gap))
    own = written(memberships(docs, model, tokens=tokens).drop("text"), "memberships")
    found = solve(own, goal)

    @F.pandas_udf("double")
    def rate(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(found.of(np.stack(p.to_numpy()), n.to_numpy(float)) if len(p) else [], dtype=float)

    return own.withColumn("rate", rate("posteriors", "n_tokens")).withColumn("n_copies", copies()).withColumn("gap", F.lit(found.gap))
