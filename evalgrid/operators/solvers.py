"""Solvers on small matrices that Spark has summed up: hulls, minima on the simplex, interpolants, contrast and linear probes.

What reaches the driver is a Gram matrix or as many rows as there are classes; rows of the table meet their small matrices within
their own tasks, a batch at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.operators import vectors as v


def project_simplex(rows: np.ndarray) -> np.ndarray:
    """Each row's nearest point with weights >= 0 that sum to 1."""
    down = -np.sort(-rows, axis=1)
    excess = (np.cumsum(down, axis=1) - 1) / np.arange(1, rows.shape[1] + 1)
    last = (down > excess).sum(axis=1) - 1
    return np.maximum(rows - excess[np.arange(len(rows)), last][:, None], 0)


def simplex_minimum(value: Callable[[np.ndarray], np.ndarray], gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 4000, close: float = 1e-15) -> np.ndarray:
    """Minimises convex functions on the simplex, one a row of ``start``, by projected gradient steps.

    A row's step is halved until it lowers the row's value enough, and doubled after each success; rows that no longer move are left alone.
    """
    c, step = project_simplex(start), np.ones(len(start))
    now, live = value(c), np.ones(len(start), bool)
    for _ in range(rounds):
        g = gradient(c)
        wait, new, after = live.copy(), c.copy(), now.copy()
        while wait.any():
            tried = project_simplex(c - step[:, None] * g)
            got = value(tried)
            fine = wait & ((got <= now - 1e-4 * ((c - tried) * g).sum(axis=1)) | (step < 1e-14))
            new[fine], after[fine] = tried[fine], got[fine]
            wait &= ~fine
            step[wait] /= 2
        moved = after < now - close * np.maximum(1, np.abs(now))
        c, now = np.where((after <= now)[:, None], new, c), np.minimum(after, now)
        live &= moved
        if not live.any():
            break
        step = np.minimum(step * 2, 1e6)
    return c


def log_sum_exp(x: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of each row, without overflow."""
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


def hull_by_faces(bank: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of many points to the hull of a few, exactly: each face is factorised once for all points."""
    k, best = len(bank), np.full(len(x), np.inf)
    for face in itertools.chain.from_iterable(itertools.combinations(range(k), n) for n in range(1, k + 1)):
        own = bank[list(face)]
        across = (own[1:] - own[0]).T
        w = np.linalg.pinv(across) @ (x - own[0]).T if len(face) > 1 else np.empty((0, len(x)))
        w = np.vstack([1 - w.sum(axis=0), w])
        far = np.linalg.norm(x - w.T @ own, axis=1)
        best = np.where((w >= -1e-10).all(axis=0), np.minimum(best, far), best)
    return best


def hull_by_descent(bank: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same distances by minimising on the simplex; only inner products with the bank are needed."""
    g, c, own = bank @ bank.T, x @ bank.T, (x * x).sum(axis=1)
    scale = max(float(np.linalg.eigvalsh(g)[-1]), 1e-300)
    value = lambda w: (0.5 * np.einsum("nk,kl,nl->n", w, g, w) - (w * c).sum(axis=1)) / scale
    w = simplex_minimum(value, lambda w: (w @ g - c) / scale, np.full((len(x), len(bank)), 1 / len(bank)))
    return np.sqrt(np.maximum(0, np.einsum("nk,kl,nl->n", w, g, w) - 2 * (w * c).sum(axis=1) + own))


def hull_distances(points: DataFrame, key: list[str], bank: Column, vector: str, dim: int) -> DataFrame:
    """``key`` columns, ``distance`` by descent and ``by_faces``; each row carries its bank (flat), and the rows of one bank in a batch are solved at once."""
    kinds = ", ".join(f"{points.schema[k].name} {points.schema[k].dataType.simpleString()}" for k in key)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[key].assign(distance=0.0, by_faces=0.0)
            for _, rows in batch.groupby(batch["__bank"].map(lambda x: np.asarray(x).tobytes()), sort=False).indices.items():
                own = np.asarray(batch["__bank"].iloc[rows[0]]).reshape(-1, dim)
                x = np.stack(batch[vector].iloc[rows].to_numpy())
                out.iloc[rows, len(key)], out.iloc[rows, len(key) + 1] = hull_by_descent(own, x), hull_by_faces(own, x)
            yield out

    return points.select(*key, vector, bank.alias("__bank")).mapInPandas(solve, f"{kinds}, distance double, by_faces double")


def regression_sums(df: DataFrame, vector: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x x' and of x y' over all rows: two small matrices."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x, y = (np.stack(batch[c].to_numpy()) for c in (vector, target))
            part = x.T @ np.hstack([x, y])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    rows = df.select(vector, target).mapInPandas(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    m = np.zeros((rows["i"].max() + 1, rows["j"].max() + 1))
    m[rows["i"], rows["j"]] = rows["x"]
    return m[:, : len(m)], m[:, len(m) :]


def largest_eigenvalue(g: np.ndarray, close: float = 1e-13, rounds: int = 100_000) -> float:
    """By power iteration, until the quotient no longer moves."""
    x, seen = np.ones(len(g)) / np.sqrt(len(g)) + np.arange(len(g)) * 1e-3, 0.0
    for _ in range(rounds):
        y = g @ x
        now = float(x @ y / (x @ x))
        if abs(now - seen) <= close * max(abs(now), 1e-300):
            break
        x, seen = y / max(np.linalg.norm(y), 1e-300), now
    return now


def minimum_norm(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The least coefficients that fit as well as any."""
    return np.linalg.pinv(g, rcond=1e-10, hermitian=True) @ c


def descend(g: np.ndarray, c: np.ndarray, fraction: float, rounds: int = 20_000, close: float = 1e-9) -> dict[str, float | int | bool]:
    """Gradient descent from 0 with a step of ``fraction`` of 1 / the largest eigenvalue, held against the minimum-norm solution."""
    best, step = minimum_norm(g, c), fraction / largest_eigenvalue(g)
    w, size, error, never_up, n = np.zeros_like(c), 1 + np.linalg.norm(best), np.linalg.norm(best), True, 0
    while n < rounds and close * size < error < 1e3 * size:
        w = w - step * 2 * (g @ w - c)
        now = float(np.linalg.norm(w - best))
        never_up &= now <= error * (1 + 1e-9) + 1e-12
        error, n = now, n + 1
    return {"rounds": n, "error": error / size, "converged": bool(error <= close * size), "monotone": bool(never_up), "diverged": bool(error >= 1e3 * size)}


#: Fixed value: the temperature of the contrast.
TEMPERATURE = 0.2


def contrast(x: np.ndarray, groups: np.ndarray, temperature: float = TEMPERATURE) -> tuple[float, float, float]:
    """Mean cosine, negative variance and grouped contrast (InfoNCE) of a block of vectors; NaN where a block has no pair for one."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    n = len(x)
    s = unit @ unit.T
    cosine = (s.sum() - np.trace(s)) / (n * (n - 1)) if n > 1 else np.nan
    variance = -unit.var(axis=0).mean() if n > 1 else np.nan
    logits = s / temperature
    np.fill_diagonal(logits, -1e9)
    alike = (groups[:, None] == groups[None, :]) & ~np.eye(n, dtype=bool)
    some = alike.any(axis=1)
    if not some.any():
        return cosine, variance, np.nan
    log_p = logits - log_sum_exp(logits)[:, None]
    return cosine, variance, float(-((log_p * alike).sum(axis=1)[some] / alike.sum(axis=1)[some]).mean())


def penalties(df: DataFrame, block: str, group: str, vector: str) -> DataFrame:
    """``block, n, cosine, variance, infonce``: how alike the vectors of each block are. A block is a batch of training, of a size that the caller bounds."""

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part[vector].to_numpy())
        return pd.DataFrame([(part[block].iloc[0], len(x), *contrast(x, part[group].to_numpy()))], columns=["block", "n", "cosine", "variance", "infonce"])

    return df.select(block, group, vector).groupBy(block).applyInPandas(judge, "block long, n long, cosine double, variance double, infonce double")


#: Fixed values of a probe's verdict: accuracy that is near perfect, and margin over the majority that makes a label identifiable.
NEAR_PERFECT, MARGIN = 0.95, 0.2
RIDGE, FOLDS = 1e-2, 5


def verdict(accuracy: float, majority: float) -> str:
    return "near_perfect" if accuracy >= NEAR_PERFECT else "identifiable" if accuracy - majority >= MARGIN else "confusable"


def structure(era: str, env: str) -> str:
    """What the verdicts on eras and on environments say together."""
    e, n = era != "confusable", env != "confusable"
    return "both_identifiable" if e and n else "era_identifiable_env_confusable" if e else "env_identifiable_era_confusable" if n else "neither_identifiable"


def grouped_probes(df: DataFrame, vector: str, targets: list[str], fold: str, variant: str) -> pd.DataFrame:
    """``variant, target, n, classes, accuracy, majority, uniform, margin, verdict``: linear probes, each row judged by a model that hasn't seen its fold.

    ``fold`` deals whole groups (0 to ``FOLDS`` - 1), so no group is on both sides. One pass sums x x' and x y' of every variant and fold
    for all targets at once; the models (ridge regression on standardised components, a column for each class) are solved from
    those sums, and a second pass judges the rows. Only these sums and the classes reach the driver.
    """
    spark = df.sparkSession
    classes = {t: [r[0] for r in v.bounded(df.select(t).distinct().orderBy(t)).itertuples(index=False)] for t in targets}
    at = {t: {c: k for k, c in enumerate(own)} for t, own in classes.items()}
    base = np.cumsum([0, *(len(classes[t]) for t in targets)])
    variants = [r[0] for r in v.bounded(df.select(variant).distinct().orderBy(variant)).itertuples(index=False)]

    def features(batch: pd.DataFrame) -> np.ndarray:
        x = np.stack(batch[vector].to_numpy())
        return np.hstack([x, np.ones((len(x), 1))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for key, part in batch.groupby([variant, fold]):
                x = features(part)
                y = np.zeros((len(x), base[-1]))
                for t, low in zip(targets, base, strict=False):
                    y[np.arange(len(x)), low + part[t].map(at[t]).to_numpy()] = 1
                total[key] = total.get(key, 0) + x.T @ np.hstack([x, y])
        for (name, k), m in total.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"variant": name, "fold": k, "i": i.ravel(), "j": j.ravel(), "x": m.ravel()})

    kind = df.schema[variant].dataType.simpleString()
    own = df.select(variant, F.col(fold).cast("int").alias(fold), vector, *targets)
    sums = own.mapInPandas(partial, f"variant {kind}, fold int, i int, j int, x double").groupBy("variant", "fold", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    models = {}
    for name in variants:
        part = sums[sums["variant"] == name]
        m = np.zeros((FOLDS, part["i"].max() + 1, part["j"].max() + 1))
        m[part["fold"], part["i"], part["j"]] = part["x"]
        for k in range(FOLDS):
            rest = m.sum(axis=0) - m[k]
            d = len(rest) - 1
            g, c, n = rest[: d + 1, : d + 1], rest[: d + 1, d + 1 :], max(rest[d, d], 1)
            mean = g[:d, d] / n
            sd = np.sqrt(np.maximum(np.diag(g)[:d] / n - mean**2, 0))
            scale = np.where(sd < 1e-9, 1.0, sd)
            into = np.block([[np.diag(1 / scale), np.zeros((d, 1))], [(-mean / scale)[None, :], np.ones((1, 1))]])
            lift = np.diag([RIDGE * n] * d + [0.0])
            models[name, k] = into @ np.linalg.lstsq(into.T @ g @ into + lift, into.T @ c, rcond=None)[0]
    shared = spark.sparkContext.broadcast(models)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (name, k), part in batch.groupby([variant, fold]):
                y = features(part) @ shared.value[name, k]
                for t, low, high in zip(targets, base, base[1:], strict=False):
                    hit = np.argmax(y[:, low:high], axis=1) == part[t].map(at[t]).to_numpy()
                    yield pd.DataFrame({"variant": name, "target": t, "n": [len(hit)], "hits": [int(hit.sum())]})

    hits = own.mapInPandas(judge, f"variant {kind}, target string, n long, hits long").groupBy("variant", "target").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toPandas()
    most = {t: int(df.groupBy(variant, t).count().agg(F.max("count")).first()[0]) for t in targets}
    rows = []
    for name in variants:
        for t in targets:
            r = hits[(hits["variant"] == name) & (hits["target"] == t)].iloc[0]
            accuracy, majority = r["hits"] / r["n"], most[t] / r["n"]
            rows.append((name, t, int(r["n"]), len(classes[t]), accuracy, majority, 1 / len(classes[t]), accuracy - majority, verdict(accuracy, majority)))
    return pd.DataFrame(rows, columns=["variant", "target", "n", "classes", "accuracy", "majority", "uniform", "margin", "verdict"])


def augmentation(probes: pd.DataFrame, plain: str, augmented: str, whole: str = "cell") -> pd.DataFrame:
    """``target, plain, augmented, drop, still_near_perfect, verdict``: what augmenting the rows has taken from each probe.

    The verdict is that of the ``whole`` label: not needed where the plain probe isn't near perfect, mitigated where the augmented one no longer is.
    """
    a, z = (probes[probes["variant"] == x].set_index("target") for x in (plain, augmented))
    was, still = a.loc[whole, "verdict"] == "near_perfect", z.loc[whole, "verdict"] == "near_perfect"
    told = "not_needed" if not was else "not_mitigated" if still else "mitigated"
    out = pd.DataFrame({"plain": a["accuracy"], "augmented": z["accuracy"], "drop": a["accuracy"] - z["accuracy"], "still_near_perfect": z["verdict"] == "near_perfect"})
    return out.reset_index().assign(verdict=told)
