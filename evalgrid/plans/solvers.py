"""Queries that solve: hulls, interpolants, mixtures by concatenation, contrast and grouped probes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions.rng import draw
from evalgrid.operators import solvers
from evalgrid.plans import register
from evalgrid.plans.ctes import sql
from evalgrid.plans.vectors import DIM, VECS, E, cells, embedded

S = SparkSession


@register("vec15_hull_solver")
def vec15_solver(spark: S, d: str) -> DataFrame:
    """The distance of each vector to the hull of its label's six era means, by projected gradients and by faces; ``gap`` is their difference in millionths."""
    bank = cells(spark, d).groupBy(F.col("env").alias("label")).agg(F.flatten(F.array_sort(F.collect_list(F.struct("era", "v"))).getField("v")).alias("bank"))  # six vectors a label
    e = embedded(spark, d).withColumn("label", F.col("label").cast("long")).join(bank, "label")
    found = solvers.hull_distances(e, ["vec_id", "label"], F.col("bank"), "v", DIM)
    return found.select("vec_id", "label", F.round("distance", 5).alias("distance"), F.round((F.col("distance") - F.col("by_faces")) * 1e6).cast("long").alias("gap"))


@register("vec15_log_sum_exp", sql("SELECT vec_id, round(list_max(v) + ln(list_sum([exp(x - list_max(v)) FOR x IN v])), 6) AS lse, round(0.1 * (list_max(v) * 10 + ln(list_sum([exp((x - list_max(v)) * 10) FOR x IN v]))), 6) AS soft_max FROM e", more=E))
def vec15_lse(spark: S, d: str) -> DataFrame:
    """The logarithm of the sum of exponentials of each vector, and its soft maximum at temperature 0.1."""
    total = lambda k: F.aggregate("v", F.lit(0.0), lambda s, x: s + F.exp((x - F.col("m")) * k))
    e = embedded(spark, d).withColumn("m", F.array_max("v"))
    return e.select("vec_id", F.round(F.col("m") + F.ln(total(1.0)), 6).alias("lse"), F.round(0.1 * (F.col("m") * 10 + F.ln(total(10.0))), 6).alias("soft_max"))


@register("vec17_descent_to_interpolant")
def vec17_descent(spark: S, d: str) -> DataFrame:
    """Gradient descent from 0 on all vectors against their labels, at steps within and beyond the bound, held against the minimum-norm solution."""
    labels = [r["label"] for r in embedded(spark, d).select("label").distinct().orderBy("label").limit(1000).collect()]
    e = embedded(spark, d).withColumn("y", F.array(*[(F.col("label") == k).cast("double") for k in labels]))
    g, c = solvers.regression_sums(e, "v", "y")
    rows = []
    for fraction in (0.5, 0.99, 1.05):
        r = solvers.descend(g, c, fraction)
        rows.append((fraction, r["rounds"], round(float(r["error"]), 9) if not r["diverged"] else None, r["converged"], r["monotone"], r["diverged"]))
    return spark.createDataFrame(rows, "fraction double, rounds long, error double, converged boolean, monotone boolean, diverged boolean")


@register("vec12_diversity_penalties", sql(f"""SELECT block, n, round(cosine, 6) AS cosine, round(variance, 6) AS variance, round(infonce, 6) AS infonce FROM (SELECT block, count(*) AS n FROM u GROUP BY 1)
  JOIN (SELECT a.block, avg(list_dot_product(a.u, z.u)) AS cosine FROM u a JOIN u z ON a.block = z.block AND a.vec_id <> z.vec_id GROUP BY 1) USING (block)
  JOIN (SELECT block, -avg(s) AS variance FROM (SELECT block, i, var_pop(u[i]) AS s FROM (SELECT block, u, unnest(range(1, 65)) AS i FROM u) GROUP BY ALL) GROUP BY 1) USING (block)
  LEFT JOIN (SELECT block, -avg(m) AS infonce FROM (SELECT a.block, a.vec_id, avg(list_dot_product(a.u, z.u) / {solvers.TEMPERATURE} - l) FILTER (a.label = z.label) AS m FROM u a JOIN u z ON a.block = z.block AND a.vec_id <> z.vec_id
    JOIN (SELECT a.vec_id, ln(sum(exp(list_dot_product(a.u, z.u) / {solvers.TEMPERATURE}))) AS l FROM u a JOIN u z ON a.block = z.block AND a.vec_id <> z.vec_id GROUP BY 1) t ON t.vec_id = a.vec_id GROUP BY 1, 2) WHERE m IS NOT NULL GROUP BY 1) USING (block)""",
    more=E | {"u": "SELECT vec_id, label, vec_id // 64 AS block, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS u FROM e"}))
def vec12_penalties(spark: S, d: str) -> DataFrame:
    """How alike the vectors of each block of 64 ids are: mean cosine, negative variance, and how well those of one label stand out."""
    e = embedded(spark, d).withColumn("block", F.floor(F.col("vec_id") / 64))
    found = solvers.penalties(e, "block", "label", "v")
    return found.select("block", "n", *[F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(c) for c in ("cosine", "variance", "infonce")])


#: Weights of the six eras in a mixture, by era.
SHARE = "(era + 1) / 21.0"
FLAT = VECS | {
    "fa": "SELECT env, era, r, j, v[1 + r * 8 + j] AS x FROM vecs, range(4) a(r), range(8) z(j)",
    "fb": "SELECT env, era, i, r, v[33 + i * 4 + r] AS x FROM vecs, range(8) a(i), range(4) z(r)",
}


@register("vec08_concatenated_mixture", sql(f"""SELECT env, i, j, mixed + 0.0 AS mixed, round(sum(a.ma * z.mb), 6) + 0.0 AS factor_mode, 24::BIGINT AS rank_out, TRUE AS exact FROM (SELECT env, i, j, round(sum({SHARE} * fa.x * fb.x), 6) AS mixed FROM fa JOIN fb USING (env, era, r) GROUP BY ALL)
  JOIN (SELECT env, r, j, sum({SHARE} * x) AS ma FROM fa GROUP BY ALL) a USING (env, j) JOIN (SELECT env, i, r, sum({SHARE} * x) AS mb FROM fb GROUP BY ALL) z USING (env, i, r) GROUP BY ALL""", more=FLAT))
def vec08_concatenated(spark: S, d: str) -> DataFrame:
    """Each environment's mixture of its eras' products, from factors put side by side (rank 24), against the product of the mixed factors, whose cross terms it lacks.

    The factors are arrays in the order of the eras, and the product is taken within the row. ``exact`` says whether it is within
    0.000001 of the sum of the single products, relative to that sum's size.
    """
    c = cells(spark, d).groupBy("env").agg(F.array_sort(F.collect_list(F.struct("era", "v"))).alias("part"))  # six eras
    n, out = F.size("part"), F.sequence(F.lit(0), F.lit(63))
    share = lambda p: (p.era + 1) / 21.0
    # Rows of A scaled by the weights one below the other, and columns of B side by side.
    a = F.flatten(F.transform("part", lambda p: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.slice(p.v, r * 8 + 1, 8), lambda x: x * share(p)))))
    z = F.flatten(F.transform("part", lambda p: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(p.v, 32 + i * 4 + r)))))
    wide = c.select("env", "part", a.alias("a"), z.alias("z"), n.alias("n"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    got = F.transform(out, lambda t: total(F.zip_with("a", "z", lambda x, y: F.get(x, t % 8) * F.get(y, F.floor(t / 8).cast("int")))))
    one = lambda p, t: total(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.get(p.v, r * 8 + t % 8) * F.get(p.v, 32 + F.floor(t / 8).cast("int") * 4 + r)))
    want = F.transform(out, lambda t: total(F.transform("part", lambda p: share(p) * one(p, t))))
    mean = lambda k: total(F.transform("part", lambda p: share(p) * F.get(p.v, k)))
    crossed = F.transform(out, lambda t: total(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: mean(r * 8 + t % 8) * mean(32 + F.floor(t / 8).cast("int") * 4 + r))))
    m = wide.select("env", F.size("a").cast("long").alias("rank_out"), got.alias("got"), want.alias("want"), crossed.alias("crossed"))
    off = total(F.zip_with("got", "want", lambda x, y: F.abs(x - y))) / total(F.transform("want", F.abs))
    m = m.select("env", "rank_out", (off < 1e-6).alias("exact"), F.posexplode(F.arrays_zip("got", "crossed")).alias("t", "x"))
    return m.select("env", F.floor(F.col("t") / 8).alias("i"), (F.col("t") % 8).cast("long").alias("j"), (F.round("x.got", 6) + 0.0).alias("mixed"), (F.round("x.crossed", 6) + 0.0).alias("factor_mode"), "rank_out", "exact")


def probed(spark: S, d: str) -> pd.DataFrame:
    """Probes for era, environment and cell of all vectors, plain and with noise on each component; four neighbouring ids are one page."""
    e = embedded(spark, d).select("vec_id", F.col("label").cast("long").alias("env"), (F.col("vec_id") % 6).alias("era"), "v")
    e = e.withColumn("cell", F.col("env") * 6 + F.col("era")).withColumn("fold", draw("probe", F.floor(F.col("vec_id") / 4)) % solvers.FOLDS)
    noise = F.transform("v", lambda x, i: x + 2 * (draw("noise", F.col("vec_id"), i) / 2147483648.0 - 1))
    both = e.withColumn("variant", F.lit("plain")).unionByName(e.withColumn("v", noise).withColumn("variant", F.lit("augmented")))
    return solvers.grouped_probes(both, "v", ["era", "env", "cell"], "fold", "variant")


@register("stat11_grouped_probes")
def stat11_grouped(spark: S, d: str) -> DataFrame:
    """What a linear probe recovers of a vector's era, environment and cell, whole pages held out, with the verdict on each and on all."""
    p = probed(spark, d)
    p["structure"] = p["variant"].map({x: solvers.structure(*(q.set_index("target").loc[t, "verdict"] for t in ("era", "env"))) for x, q in p.groupby("variant")})
    return spark.createDataFrame(p.round(6), "variant string, target string, n long, classes long, accuracy double, majority double, uniform double, margin double, verdict string, structure string")


@register("stat12_augmentation_report")
def stat12_augmented(spark: S, d: str) -> DataFrame:
    """What noise takes from each probe, and whether it makes the cell's no lookup any more."""
    report = solvers.augmentation(probed(spark, d), "plain", "augmented")
    return spark.createDataFrame(report.round(6), "target string, plain double, augmented double, drop double, still_near_perfect boolean, verdict string")
