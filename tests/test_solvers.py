"""Solvers against closed forms, dense computations and planted frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.operators import solvers
from evalgrid.operators.vectors import hull_distance

RND = np.random.default_rng(7)


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e3])
def test_hulls_by_descent_by_faces_and_one_by_one(scale):
    for trial in range(6):
        bank = RND.normal(size=(RND.integers(2, 7), 8)) * scale
        if trial == 0:
            bank[1] = bank[0]
        if trial == 1:
            bank[-1] = (bank[0] + bank[1]) / 2
        x = np.vstack([RND.normal(size=(20, 8)) * scale, bank, RND.dirichlet(np.ones(len(bank)), 10) @ bank])
        faces = solvers.hull_by_faces(bank, x)
        assert np.allclose(faces, [hull_distance(bank, y) for y in x], atol=1e-7 * scale)
        size = np.linalg.norm(bank, axis=1).max()
        assert np.abs(solvers.hull_by_descent(bank, x) ** 2 - faces**2).max() < 1e-6 * size**2
        assert np.abs(solvers.hull_by_descent(bank, x)[:20] - faces[:20]).max() < 1e-6 * size


def test_projection_and_convex_minima():
    rows = RND.normal(size=(50, 6)) * 3
    p = solvers.project_simplex(rows)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    other = RND.dirichlet(np.ones(6), 2000)
    assert all(np.linalg.norm(r - q) <= np.linalg.norm(r - other, axis=1).min() + 1e-12 for r, q in zip(rows, p))
    a = RND.normal(size=(6, 5))
    value = lambda c: solvers.log_sum_exp(c @ a)
    gradient = lambda c: np.exp(c @ a - solvers.log_sum_exp(c @ a)[:, None]) @ a.T
    least = value(solvers.simplex_minimum(value, gradient, RND.dirichlet(np.ones(6), 4)))
    assert np.ptp(least) < 1e-8 and least.max() <= value(other).min() + 1e-9
    assert np.allclose(solvers.log_sum_exp(np.array([[1000.0, 1000.0], [-1000.0, 0.0]])), [1000 + np.log(2), 0])


def test_interpolants_and_descent(spark):
    x, y = RND.normal(size=(40, 5)), RND.normal(size=(40, 2))
    x[:, 4] = x[:, 3] * 0.5 + 0.2 * x[:, 4]
    frame = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "v array<double>, y array<double>")
    g, c = solvers.regression_sums(frame, "v", "y")
    assert np.allclose(g, x.T @ x) and np.allclose(c, x.T @ y)
    assert abs(solvers.largest_eigenvalue(g) / np.linalg.eigvalsh(g)[-1] - 1) < 1e-9
    best = solvers.minimum_norm(g, c)
    assert np.allclose(best, np.linalg.lstsq(x, y, rcond=None)[0])
    for fraction in (0.5, 0.99):
        r = solvers.descend(g, c, fraction)
        assert r["converged"] and r["monotone"] and not r["diverged"]
    assert solvers.descend(g, c, 1.05)["diverged"]
    thin = RND.normal(size=(3, 5))
    w = solvers.minimum_norm(thin.T @ thin, thin.T @ y[:3])
    assert np.allclose(thin @ w, y[:3]) and np.allclose(w, np.linalg.pinv(thin) @ y[:3])
    with_null = w + (np.eye(5) - np.linalg.pinv(thin) @ thin) @ RND.normal(size=w.shape)
    assert np.allclose(thin @ with_null, y[:3]) and np.linalg.norm(with_null) > np.linalg.norm(w)


def test_contrast():
    x, groups = RND.normal(size=(9, 4)), np.array([0, 0, 1, 1, 1, 2, 3, 3, 0])
    cosine, variance, nce = solvers.contrast(x, groups)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(9) for j in range(9) if i != j]
    assert np.isclose(cosine, np.mean([u[i] @ u[j] for i, j in pairs])) and np.isclose(variance, -np.mean([np.var(u[:, k]) for k in range(4)]))
    want = []
    for i in range(9):
        total = np.log(sum(np.exp(u[i] @ u[j] / 0.2) for j in range(9) if j != i))
        own = [u[i] @ u[j] / 0.2 - total for j in range(9) if j != i and groups[j] == groups[i]]
        want += [np.mean(own)] if own else []
    assert np.isclose(nce, -np.mean(want))
    alike = solvers.contrast(np.ones((5, 3)) + 1e-9 * RND.normal(size=(5, 3)), np.arange(5))
    assert alike[0] > 0.999 and np.isnan(alike[2]) and np.isnan(solvers.contrast(x[:1], groups[:1])[0])


def frame(spark, era_shift, env_shift, noise=0.3, n=600):
    rows = []
    for k in range(n):
        era, env = int(RND.integers(3)), int(RND.integers(4))
        plain = np.zeros(8)
        plain[era] += era_shift
        plain[3 + env] += env_shift
        for name, more in (("plain", noise), ("augmented", 8.0)):
            rows.append((k, k // 3 % solvers.FOLDS, era, env, era * 4 + env, name, (plain + RND.normal(size=8) * more).tolist()))
    return spark.createDataFrame(rows, "id long, fold int, era int, env int, cell int, variant string, v array<double>")


@pytest.mark.parametrize("era, env, told", [(4, 0, "era_identifiable_env_confusable"), (0, 4, "env_identifiable_era_confusable"), (4, 4, "both_identifiable"), (0, 0, "neither_identifiable")])
def test_probes_of_known_frames(spark, era, env, told):
    found = solvers.grouped_probes(frame(spark, era, env), "v", ["era", "env", "cell"], "fold", "variant")
    plain = found[found["variant"] == "plain"].set_index("target")
    assert solvers.structure(plain.loc["era", "verdict"], plain.loc["env", "verdict"]) == told
    assert (plain["n"] == 600).all() and (plain["classes"] == [3, 4, 12]).all() and (plain["accuracy"] <= 1).all()
    report = solvers.augmentation(found, "plain", "augmented").set_index("target")
    assert (report["verdict"] == ("mitigated" if era and env else "not_needed")).all()
    if era and env:
        assert report.loc["cell", "drop"] > 0.5 and plain.loc["cell", "verdict"] == "near_perfect"
