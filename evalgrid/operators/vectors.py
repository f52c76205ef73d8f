"""Vectors and low-rank factors as array expressions; heavy steps are aggregates or joins on small keys."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_vector(df: DataFrame, by: list[str], vector: str, dim: int) -> DataFrame:
    """The element-wise mean of each group as ``v``; one shuffle of partial sums, no explode."""
    sums = df.groupBy(*by).agg(*[F.avg(F.get(vector, i)).alias(f"__{i}") for i in range(dim)])
    return sums.select(*by, F.array(*[F.col(f"__{i}") for i in range(dim)]).alias("v"))


#: Rows that a driver-side step takes at most.
MOST_ROWS = 1000


def bounded(df: DataFrame, most: int = MOST_ROWS) -> pd.DataFrame:
    """A table that must be small, on the driver; more rows than ``most`` raise ValueError."""
    out = df.limit(most + 1).toPandas()
    if len(out) > most:
        raise ValueError(f"more than {most} rows for a step that takes them on the driver")
    return out


def gram(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of outer products, sum of vectors and their number. The d x d matrix is all that reaches the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch[vector].to_numpy())
            x = np.hstack([x, np.ones((len(x), 1))])
            g = x.T @ x
            i, j = np.indices(g.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": g.ravel()})

    rows = df.select(vector).mapInPandas(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    d = int(rows["i"].max()) + 1
    g = np.zeros((d, d))
    g[rows["i"], rows["j"]] = rows["x"]
    return g[:-1, :-1], g[-1, :-1], round(g[-1, -1])


def effective_ranks(df: DataFrame, vector: str, centred: bool = True) -> dict[str, float]:
    """The three effective ranks of a set of vectors: entropy of s, entropy of s squared, and (sum s)^2 / sum s^2."""
    g, total, n = gram(df, vector)
    s = np.sqrt(np.clip(np.linalg.eigvalsh(g - np.outer(total, total) / n if centred else g), 0, None))
    s = s[s > 1e-9 * max(s.max(), 1e-300)]
    entropy = lambda p: float(np.exp(-(p * np.log(p)).sum()))
    return {"by_value": entropy(s / s.sum()), "by_energy": entropy(s**2 / (s**2).sum()), "participation": float(s.sum() ** 2 / (s**2).sum())}


def hull_distance(bank: np.ndarray, x: np.ndarray) -> float:
    """Distance of a point to the convex hull of a few points: the best affine projection over all faces with weights >= 0."""
    k = len(bank)
    g, c = bank @ bank.T, bank @ x
    best = np.inf
    for face in itertools.chain.from_iterable(itertools.combinations(range(k), n) for n in range(1, k + 1)):
        f = list(face)
        m = np.ones((len(f) + 1, len(f) + 1))
        m[:-1, :-1], m[-1, -1] = g[np.ix_(f, f)], 0
        w = np.linalg.lstsq(m, np.append(c[f], 1.0), rcond=None)[0][:-1]
        if (w >= -1e-10).all() and abs(w.sum() - 1) < 1e-6:
            best = min(best, float(np.linalg.norm(x - w @ bank[f])))
    return best


def merge_order(names: list[str], distance: np.ndarray) -> list[tuple[str, str, float, int]]:
    """Average-linkage merges of a bounded set: closest pair first, ties by place, new clusters last."""
    groups = [([n], 1) for n in names]
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    out = []
    while len(groups) > 1:
        i, j = divmod(int(np.argmin(np.where(np.triu(np.ones_like(d), 1) > 0, d, np.inf))), len(d))
        (a, na), (b, nb) = groups[i], groups[j]
        out.append((min(a), min(b), float(d[i, j]), na + nb))
        row = (na * d[i] + nb * d[j]) / (na + nb)
        keep = [k for k in range(len(groups)) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], row[keep][:, None]], [row[keep][None, :], np.array([[np.inf]])]])
        groups = [groups[k] for k in keep] + [(a + b, na + nb)]
    return out
