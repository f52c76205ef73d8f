"""Queries over embeddings: similarity, centring, factors, mixtures, norms and probes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.functions.rng import draw, draw_sql
from evalgrid.functions.text import l2_normalised
from evalgrid.operators import vectors as v
from evalgrid.operators.resampling import N_PERM, N_PERM_PAIRS, times
from evalgrid.operators.selection import next_within, rank_within
from evalgrid.plans import register
from evalgrid.plans.ctes import sql
from evalgrid.sources import bindings as b

S = SparkSession
DIM = 64
E = {"e": "SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings"}
VECS = E | {"vecs": "SELECT label::BIGINT AS env, era, label * 6 + era AS cell, list(m ORDER BY i) AS v FROM (SELECT label, vec_id % 6 AS era, i, avg(v[i]) AS m FROM (SELECT vec_id, label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL) GROUP BY ALL"}
PAIR = E | {"pair": "SELECT * FROM (SELECT vec_id, label, v AS a, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM e) WHERE b IS NOT NULL"}
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def embedded(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def cells(spark: S, d: str) -> DataFrame:
    """Mean vectors of the cells (label, vec_id mod 6): sixty rows, whatever the table's size."""
    m = v.mean_vector(embedded(spark, d).withColumn("era", F.col("vec_id") % 6), ["label", "era"], "v", DIM)
    return m.select(F.col("label").cast("long").alias("env"), "era", (F.col("label") * 6 + F.col("era")).alias("cell"), "v")


def successors(spark: S, d: str) -> DataFrame:
    """Each vector with the next one of its label; a label's vectors are sorted in ranges of their ids."""
    e = embedded(spark, d).select("vec_id", "label", F.col("v").alias("a"))
    return next_within(e, ["label"], F.shiftright("vec_id", 13), "vec_id", "a", "b").where("b IS NOT NULL").select("vec_id", "label", "a", "b")


def cell_pairs(spark: S, d: str) -> DataFrame:
    c = cells(spark, d)
    x, y = c.select(*[F.col(k).alias(f"a_{k}") for k in c.columns]), c.select(*[F.col(k).alias(f"b_{k}") for k in c.columns])
    return x.join(y, F.col("a_cell") != F.col("b_cell"))


@register("src09_vector_store", "SELECT vec_id, label::BIGINT AS label, len(embedding)::BIGINT AS dim, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 6) AS norm, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings")
def src09(spark: S, d: str) -> DataFrame:
    e = embedded(spark, d).select("vec_id", F.col("label").cast("long").alias("label"), F.size("v").cast("long").alias("dim"), F.round(v.norm(F.col("v")), 6).alias("norm"))
    return rank_within(e, ["label"], F.shiftright("vec_id", 13), ["vec_id"], "place")


NEAR = f"SELECT a.cell, a.env, a.era, z.cell AS near, z.era AS near_era, {COS.format(a='a.v', b='z.v')} AS sim FROM vecs a JOIN vecs z ON a.env <> z.env"


@register("jn10_nearest_cross_env", sql(f"SELECT cell, near, round(sim, 6) AS sim, near_era = era AS era_match FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sim DESC, near) AS rn FROM ({NEAR})) WHERE rn = 1", more=VECS))
def jn10(spark: S, d: str) -> DataFrame:
    sims = cell_pairs(spark, d).where("a_env <> b_env").withColumn("sim", v.cosine(F.col("a_v"), F.col("b_v")))
    best = sims.withColumn("rn", F.row_number().over(Window.partitionBy("a_cell").orderBy(F.desc("sim"), "b_cell"))).where("rn = 1")
    return best.select(F.col("a_cell").alias("cell"), F.col("b_cell").alias("near"), F.round("sim", 6).alias("sim"), (F.col("a_era") == F.col("b_era")).alias("era_match"))


@register("jn10_neighbour_summary", sql(f"SELECT count(*) AS n, round(avg((near_era = era)::DOUBLE), 6) AS top1_match, round(avg(abs(near_era - era)), 6) AS mean_gap, round(1.0 / (SELECT count(DISTINCT era) FROM vecs), 6)::DOUBLE AS chance FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sim DESC, near) AS rn FROM ({NEAR})) WHERE rn = 1", more=VECS))
def jn10b(spark: S, d: str) -> DataFrame:
    """How often the nearest cell of another environment is of the same era, how far off it is otherwise, and chance."""
    p = cell_pairs(spark, d).where("a_env <> b_env").withColumn("sim", v.cosine(F.col("a_v"), F.col("b_v")))
    best = p.withColumn("rn", F.row_number().over(Window.partitionBy("a_cell").orderBy(F.desc("sim"), "b_cell"))).where("rn = 1")
    n_eras = cells(spark, d).agg(F.count_distinct("era").alias("k"))
    return best.crossJoin(n_eras).agg(F.count("*").alias("n"), F.round(F.avg((F.col("a_era") == F.col("b_era")).cast("double")), 6).alias("top1_match"), F.round(F.avg(F.abs(F.col("a_era") - F.col("b_era"))), 6).alias("mean_gap"), F.round(1 / F.max("k"), 6).alias("chance"))


@register("jn11_training_neighbour", sql(f"SELECT cell, arg_max(near, (sim, near)) AS by_similarity, arg_min(near, (abs(era - near_era), near)) AS by_year FROM ({NEAR}) WHERE era >= 4 AND near_era < 4 GROUP BY cell", more=VECS))
def jn11(spark: S, d: str) -> DataFrame:
    p = cell_pairs(spark, d).where("a_env <> b_env AND a_era >= 4 AND b_era < 4").withColumn("sim", v.cosine(F.col("a_v"), F.col("b_v")))
    gap = F.struct(F.abs(F.col("a_era") - F.col("b_era")).alias("g"), F.col("b_cell").alias("c"))
    return p.groupBy(F.col("a_cell").alias("cell")).agg(F.max(F.struct("sim", "b_cell")).getField("b_cell").alias("by_similarity"), F.min(gap).getField("c").alias("by_year"))


@register("ag18_group_mean_direction", sql("SELECT label::BIGINT AS label, i - 1 AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL)", more=E))
def ag18(spark: S, d: str) -> DataFrame:
    m = v.mean_vector(embedded(spark, d), ["label"], "v", DIM).select(F.col("label").cast("long").alias("label"), F.posexplode(l2_normalised(F.col("v"))).alias("pos", "x"))
    return m.select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("ag13_cluster_purity", sql("SELECT count(*) AS n, round(sum(best_label) / sum(n), 6) AS by_label, count(*) AS clusters FROM (SELECT c, max(k) AS best_label, sum(k) AS n FROM (SELECT list_position(v[1:8], list_max(v[1:8])) AS c, label, count(*) AS k FROM e GROUP BY 1, 2) GROUP BY c)", more=E))
def ag13(spark: S, d: str) -> DataFrame:
    head = F.slice("v", 1, 8)
    k = embedded(spark, d).groupBy(F.array_position(head, F.array_max(head)).alias("c"), "label").agg(F.count("*").alias("k"))
    per = k.groupBy("c").agg(F.max("k").alias("best"), F.sum("k").alias("size"))
    return per.agg(F.count("*").alias("n"), F.round(F.sum("best") / F.sum("size"), 6).alias("by_label"), F.count("*").alias("clusters"))


@register("vec01_centred_vectors", sql("SELECT cell, round(sqrt(sum(x * x)), 6) AS norm FROM (SELECT cell, m - avg(m) OVER (PARTITION BY env, i) AS x FROM (SELECT cell, env, v[i] AS m, i FROM (SELECT *, unnest(range(1, 65)) AS i FROM vecs))) GROUP BY cell", more=VECS))
def vec01(spark: S, d: str) -> DataFrame:
    c = cells(spark, d)
    mean = v.mean_vector(c, ["env"], "v", DIM).withColumnRenamed("v", "m")
    return c.join(F.broadcast(mean), "env").select("cell", F.round(v.norm(F.zip_with("v", "m", lambda x, y: x - y)), 6).alias("norm"))


@register("vec02_pairwise_summary", sql(f"SELECT round(min(dist), 6) AS low, round(quantile_cont(dist, 0.5), 6) AS median, round(max(dist), 6) AS high, round(avg(sim), 6) AS mean_cosine, count(*) AS pairs FROM (SELECT list_distance(a.v, z.v) AS dist, {COS.format(a='a.v', b='z.v')} AS sim FROM vecs a JOIN vecs z ON a.cell < z.cell)", more=VECS))
def vec02(spark: S, d: str) -> DataFrame:
    p = cell_pairs(spark, d).where("a_cell < b_cell").select(v.norm(F.zip_with("a_v", "b_v", lambda x, y: x - y)).alias("dist"), v.cosine(F.col("a_v"), F.col("b_v")).alias("sim"))
    return p.agg(F.round(F.min("dist"), 6).alias("low"), F.round(F.percentile("dist", 0.5), 6).alias("median"), F.round(F.max("dist"), 6).alias("high"), F.round(F.avg("sim"), 6).alias("mean_cosine"), F.count("*").alias("pairs"))


@register("vec03_effective_rank")
def vec03(spark: S, d: str) -> DataFrame:
    e = embedded(spark, d)
    rows = [(c, *(round(x, 6) for x in v.effective_ranks(e, "v", c).values())) for c in (True, False)]
    return spark.createDataFrame(rows, "centred boolean, by_value double, by_energy double, participation double")


@register("vec04_diversity_collapse")
def vec04(spark: S, d: str) -> DataFrame:
    e = embedded(spark, d)
    g, total, n = v.gram(e, "v")
    mean = total / n
    ratio = float(np.sqrt(max(np.trace(g) / n - mean @ mean, 0)) / max(np.linalg.norm(mean), 1e-300))
    rank = v.effective_ranks(e, "v")["by_value"] / min(n - 1, DIM)
    return spark.createDataFrame([(round(ratio, 6), round(rank, 6), ratio < 0.1 or rank < 0.25)], "variance_ratio double, rank_fraction double, collapsed boolean")


def collapse(ratio: float, fraction: float) -> str:
    """Which signal says that the vectors have collapsed: their spread is under a tenth of their mean, or they use under a quarter of the directions they have."""
    return {(True, True): "both", (True, False): "variance", (False, True): "rank", (False, False): "none"}[ratio < 0.1, fraction < 0.25]


@register("vec04_collapse_signals")
def vec04_signals(spark: S, d: str) -> DataFrame:
    """Both signals of collapse and which of them fires, for the vectors, for those drawn close to their mean, and for those flattened to one direction."""
    e = embedded(spark, d)
    mean = e.agg(*[F.avg(F.get("v", i)).alias(f"m{i}") for i in range(DIM)]).first()  # one row
    m, at = F.array(*[F.lit(float(x)) for x in mean]), e.withColumn("w", v.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in mean])))
    sets = {"as_given": e, "near_mean": e.withColumn("v", F.zip_with("v", m, lambda x, y: 1000 * y + x)), "one_direction": at.withColumn("v", F.transform(m, lambda y: y * (1 + 100 * F.col("w"))))}
    rows = []
    for name, x in sets.items():
        g, total, n = v.gram(x, "v")
        centre = total / n
        ratio = float(np.sqrt(max(np.trace(g) / n - centre @ centre, 0)) / max(np.linalg.norm(centre), 1e-300))
        fraction = v.effective_ranks(x, "v")["by_value"] / min(n - 1, DIM)
        rows.append((name, round(ratio, 6), round(fraction, 6), collapse(ratio, fraction)))
    return spark.createDataFrame(rows, "name string, variance_ratio double, rank_fraction double, signal string")


#: <B1 A1, B2 A2> without the products: A is the first 32 components (4 x 8), B the last 32 (8 x 4).
def inner_sql(x: str, y: str) -> str:
    return f"list_sum([list_sum([{x}[33 + i * 4 + t // 4] * {y}[33 + i * 4 + t % 4] FOR i IN range(8)]) * list_sum([{x}[1 + (t // 4) * 8 + j] * {y}[1 + (t % 4) * 8 + j] FOR j IN range(8)]) FOR t IN range(16)])"


def inner(x: str, y: str):
    return F.expr(
        f"aggregate(sequence(0, 15), 0D, (s, t) -> s + aggregate(sequence(0, 7), 0D, (u, i) -> u + {x}[32 + i * 4 + int(t / 4)] * {y}[32 + i * 4 + t % 4])"
        f" * aggregate(sequence(0, 7), 0D, (u, j) -> u + {x}[int(t / 4) * 8 + j] * {y}[(t % 4) * 8 + j]))")


@register("vec05_weight_distance", sql(f"SELECT vec_id, round(1 - {COS.format(a='a', b='b')}, 6) AS factor_cosine, round(list_distance(a, b), 6) AS factor_frobenius, round(1 - ab / sqrt(aa * bb), 6) AS delta_cosine, round(sqrt(greatest(0, aa + bb - 2 * ab)), 6) AS delta_frobenius FROM (SELECT *, {inner_sql('a', 'a')} AS aa, {inner_sql('b', 'b')} AS bb, {inner_sql('a', 'b')} AS ab FROM pair)", more=PAIR))
def vec05(spark: S, d: str) -> DataFrame:
    p = successors(spark, d).select("vec_id", "a", "b", inner("a", "a").alias("aa"), inner("b", "b").alias("bb"), inner("a", "b").alias("ab"))
    return p.select(
        "vec_id", F.round(1 - v.cosine(F.col("a"), F.col("b")), 6).alias("factor_cosine"), F.round(v.norm(F.zip_with("a", "b", lambda x, y: x - y)), 6).alias("factor_frobenius"),
        F.round(1 - F.expr("ab / sqrt(aa * bb)"), 6).alias("delta_cosine"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.expr("aa + bb - 2 * ab"))), 6).alias("delta_frobenius"))


@register("vec06_average_linkage")
def vec06(spark: S, d: str) -> DataFrame:
    pdf = v.bounded(cells(spark, d).orderBy("cell"))
    x = np.stack(pdf["v"].to_numpy())
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    merges = v.merge_order([f"{c:03d}" for c in pdf["cell"]], 1 - x @ x.T)
    return spark.createDataFrame([(i, a, z, round(h, 6), n) for i, (a, z, h, n) in enumerate(merges)], "step long, left string, right string, height double, size long")


WEIGHTS = VECS | {
    "distances": f"SELECT least(a.era * 5 + a.env, z.era * 5 + z.env) AS p, greatest(a.era * 5 + a.env, z.era * 5 + z.env) AS q, 1 - {COS.format(a='a.v', b='z.v')} AS x FROM vecs a JOIN vecs z ON a.cell < z.cell WHERE a.env < 5 AND z.env < 5 AND a.era < 5 AND z.era < 5",
    "both_ways": "SELECT least(src, dst) AS p, greatest(src, dst) AS q, avg(value) AS y FROM matrix WHERE value IS NOT NULL AND src <> dst GROUP BY 1, 2",
    "paired_up": "SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, row_number() OVER (ORDER BY p, q) AS pos FROM (SELECT p, q, round(x, 9) AS x, round(y, 9) AS y FROM distances JOIN both_ways USING (p, q))",
}


@register("vec07_distance_agreement", sql(f"""SELECT pairs, round(rho, 6) AS rho, (1 + hits) / {N_PERM_PAIRS + 1}.0::DOUBLE AS p, rho <= -0.3 AND (1 + hits) / {N_PERM_PAIRS + 1}.0 < 0.05 AS agree FROM (SELECT count(*) AS pairs, corr(rx, ry) AS rho FROM paired_up), (
    SELECT count(*) FILTER (abs(r) >= abs(o) - 1e-12) AS hits FROM (SELECT perm, corr(a.rx, z.ry) AS r FROM (
      SELECT perm, rx, row_number() OVER (PARTITION BY perm ORDER BY {draw_sql('agree', 'perm', 'pos')}, pos) AS slot FROM paired_up, range(0::BIGINT, {N_PERM_PAIRS}::BIGINT) u(perm)) a JOIN paired_up z ON z.pos = a.slot GROUP BY perm), (SELECT corr(rx, ry) AS o FROM paired_up))""", "matrix", more=WEIGHTS))
def vec07(spark: S, d: str) -> DataFrame:
    """Whether cells whose vectors are far apart transfer less: rank correlation over unordered pairs, with a permutation p."""
    near = cell_pairs(spark, d).where("a_cell < b_cell AND a_env < 5 AND b_env < 5 AND a_era < 5 AND b_era < 5")
    place = lambda side: F.col(f"{side}_era") * 5 + F.col(f"{side}_env")
    x = near.select(F.least(place("a"), place("b")).alias("p"), F.greatest(place("a"), place("b")).alias("q"), F.round(1 - v.cosine(F.col("a_v"), F.col("b_v")), 9).alias("x"))
    y = b.transfer(spark, d).where("value IS NOT NULL AND src <> dst").groupBy(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).agg(F.round(F.avg("value"), 9).alias("y"))
    rank = lambda c: (F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2).cast("double")
    r = x.join(y, ["p", "q"]).select(rank("x").alias("rx"), rank("y").alias("ry"), F.row_number().over(Window.orderBy("p", "q")).cast("long").alias("pos"))  # some hundred pairs
    slot = F.row_number().over(Window.partitionBy("perm").orderBy(draw("agree", "perm", "pos"), "pos")).cast("long")
    moved = times(r.select("pos", "rx"), N_PERM_PAIRS).withColumn("slot", slot).join(r.select(F.col("pos").alias("slot"), "ry"), "slot").groupBy("perm").agg(F.corr("rx", "ry").alias("r"))
    seen = r.agg(F.count("*").alias("pairs"), F.corr("rx", "ry").alias("rho"))
    hits = moved.crossJoin(seen).agg(F.count_if(F.abs("r") >= F.abs("rho") - 1e-12).alias("hits"))
    p = (1 + F.col("hits")) / (N_PERM_PAIRS + 1)
    return seen.crossJoin(hits).select("pairs", F.round("rho", 6).alias("rho"), p.alias("p"), ((F.col("rho") <= -0.3) & (p < 0.05)).alias("agree"))


COO = E | {"fa": "SELECT vec_id, label, (p // 8) AS r, p % 8 AS j, v[p + 1] AS x FROM (SELECT *, unnest(range(32)) AS p FROM e)", "fb": "SELECT vec_id, label, (p // 4) AS i, p % 4 AS r, v[p + 33] AS x FROM (SELECT *, unnest(range(32)) AS p FROM e)", "bank": "SELECT label, count(*) AS k FROM e GROUP BY 1"}


def factors(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    """The two factors of each vector as coordinate rows: A (r, j) and B (i, r)."""
    flat = embedded(spark, d).select("vec_id", "label", F.posexplode("v").alias("p", "x"))
    a = flat.where("p < 32").select("vec_id", "label", F.expr("int(p / 8)").alias("r"), F.expr("p % 8").alias("j"), "x")
    z = flat.where("p >= 32").select("vec_id", F.expr("int((p - 32) / 4)").alias("i"), F.expr("(p - 32) % 4").alias("r"), F.col("x").alias("y"))
    return a, z


@register("vec08_exact_mixture", sql("SELECT fa.label::BIGINT AS label, i::BIGINT AS i, j::BIGINT AS j, round(sum(fb.x * fa.x) / any_value(k), 6) AS mixed, round(avg(sum_b) , 6) AS factor_mode FROM fa JOIN fb USING (vec_id, r) JOIN bank ON bank.label = fa.label JOIN (SELECT label AS l, i AS bi, j AS bj, sum(ma * mb) AS sum_b FROM (SELECT label, r, j, avg(x) AS ma FROM fa GROUP BY ALL) JOIN (SELECT label, i, r, avg(x) AS mb FROM fb GROUP BY ALL) USING (label, r) GROUP BY ALL) f ON f.l = fa.label AND f.bi = fb.i AND f.bj = fa.j GROUP BY fa.label, i, j", more=COO))
def vec08(spark: S, d: str) -> DataFrame:
    a, z = factors(spark, d)
    size = embedded(spark, d).groupBy("label").agg(F.count("*").alias("k"))
    mixed = a.join(z, ["vec_id", "r"]).groupBy("label", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s")).join(F.broadcast(size), "label")
    labels = embedded(spark, d).select("vec_id", "label")
    ma = a.groupBy("label", "r", "j").agg(F.avg("x").alias("ma"))
    mb = z.join(labels, "vec_id").groupBy("label", "i", "r").agg(F.avg("y").alias("mb"))
    crossed = ma.join(mb, ["label", "r"]).groupBy("label", "i", "j").agg(F.sum(F.col("ma") * F.col("mb")).alias("f"))
    out = mixed.join(crossed, ["label", "i", "j"])
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("label", "i", "j")], F.round(F.col("s") / F.col("k"), 6).alias("mixed"), F.round("f", 6).alias("factor_mode"))


@register("vec09_bank_mean_factor", sql("SELECT label::BIGINT AS label, r::BIGINT AS r, j::BIGINT AS j, round(avg(x), 6) AS a FROM fa GROUP BY ALL", more=COO))
def vec09(spark: S, d: str) -> DataFrame:
    a, _ = factors(spark, d)
    return a.groupBy("label", "r", "j").agg(F.round(F.avg("x"), 6).alias("a")).select(*[F.col(c).cast("long").alias(c) for c in ("label", "r", "j")], "a")


@register("vec10_factored_norms", sql(f"SELECT vec_id, round(sqrt({inner_sql('v', 'v')}), 6) AS norm FROM e", more=E))
def vec10(spark: S, d: str) -> DataFrame:
    return embedded(spark, d).select("vec_id", F.round(F.sqrt(inner("v", "v")), 6).alias("norm"))


@register("vec10_pairwise_products", sql(f"SELECT same_env, count(*) AS pairs, round(avg(ab / sqrt(aa * bb)), 6) AS mean_cosine FROM (SELECT a.env = z.env AS same_env, {inner_sql('a.v', 'z.v')} AS ab, {inner_sql('a.v', 'a.v')} AS aa, {inner_sql('z.v', 'z.v')} AS bb FROM vecs a JOIN vecs z ON a.cell < z.cell) GROUP BY 1", more=VECS))
def vec10b(spark: S, d: str) -> DataFrame:
    """Cosines of the products of the cells' factors, never multiplied out, within an environment and across."""
    p = cell_pairs(spark, d).where("a_cell < b_cell").select((F.col("a_env") == F.col("b_env")).alias("same_env"), inner("a_v", "b_v").alias("ab"), inner("a_v", "a_v").alias("aa"), inner("b_v", "b_v").alias("bb"))
    return p.groupBy("same_env").agg(F.count("*").alias("pairs"), F.round(F.avg(F.expr("ab / sqrt(aa * bb)")), 6).alias("mean_cosine"))


RANDOM_SQL = f"[{draw_sql('random', 'vec_id', 'i')} / 2147483648.0 - 1 FOR i IN range(64)]"


@register("vec11_random_control", sql(f"SELECT vec_id, round(sqrt(t / c), 6) AS factor, round(c, 6) AS raw, round(c * sqrt(t / c) * sqrt(t / c), 6) AS matched FROM (SELECT vec_id, sqrt({inner_sql('v', 'v')}) AS t, sqrt({inner_sql('r', 'r')}) AS c FROM (SELECT vec_id, v, {RANDOM_SQL} AS r FROM e))", more=E))
def vec11b(spark: S, d: str) -> DataFrame:
    """Random factors for each vector, both scaled by the root of the ratio of norms, so their product is as large as the vector's own."""
    r = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: draw("random", F.col("vec_id"), i) / 2147483648.0 - 1)
    e = embedded(spark, d).withColumn("r", r).select("vec_id", F.sqrt(inner("v", "v")).alias("t"), F.sqrt(inner("r", "r")).alias("c"))
    f = F.sqrt(F.col("t") / F.col("c"))
    return e.select("vec_id", F.round(f, 6).alias("factor"), F.round("c", 6).alias("raw"), F.round(F.col("c") * f * f, 6).alias("matched"))


@register("vec11_rescale_to_target", sql(f"SELECT vec_id, round(t / n, 6) AS factor, round(sqrt(list_sum([(x * t / n) * (x * t / n) FOR x IN v[33:64]])), 6) AS b_norm FROM (SELECT vec_id, v, sqrt({inner_sql('v', 'v')}) AS n, avg(sqrt({inner_sql('v', 'v')})) OVER (PARTITION BY label) AS t FROM e)", more=E))
def vec11(spark: S, d: str) -> DataFrame:
    e = embedded(spark, d).select("vec_id", "label", "v", F.sqrt(inner("v", "v")).alias("n"))
    target = e.groupBy("label").agg(F.avg("n").alias("t"))
    out = e.join(F.broadcast(target), "label").withColumn("f", F.col("t") / F.col("n"))
    return out.select("vec_id", F.round("f", 6).alias("factor"), F.round(v.norm(F.slice("v", 33, 32)) * F.col("f"), 6).alias("b_norm"))


def sign_vector(name: str) -> list[int]:
    """Fixed signs of a projection, from md5."""
    import hashlib

    return [1 - 2 * (int(hashlib.md5(f"{name}|{i}".encode()).hexdigest()[:8], 16) % 2) for i in range(8)]


U, V = sign_vector("u"), sign_vector("v")


@register("vec12_projection_sketch", sql(f"SELECT vec_id, round(list_sum([list_sum([{V}[i + 1] * v[33 + i * 4 + r] FOR i IN range(8)]) * list_sum([{U}[j + 1] * v[1 + r * 8 + j] FOR j IN range(8)]) FOR r IN range(4)]), 6) AS sketch FROM e", more=E))
def vec12(spark: S, d: str) -> DataFrame:
    left = lambda r: sum((F.get("v", 32 + i * 4 + r) * V[i] for i in range(8)), F.lit(0.0))
    right = lambda r: sum((F.get("v", r * 8 + j) * U[j] for j in range(8)), F.lit(0.0))
    return embedded(spark, d).select("vec_id", F.round(sum((left(r) * right(r) for r in range(4)), F.lit(0.0)), 6).alias("sketch"))


@register("vec13_between_conditioning_ratio", sql("SELECT i - 1 AS pos, round(var_samp(m), 6) AS between_var, round(avg(s), 6) AS within_var, var_samp(m) = 0 AS zero FROM (SELECT label, i, avg(v[i]) AS m, var_samp(v[i]) AS s FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL) GROUP BY i", more=E))
def vec13(spark: S, d: str) -> DataFrame:
    per = embedded(spark, d).select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"), F.var_samp("x").alias("s"))
    return per.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.var_samp("m"), 6).alias("between_var"), F.round(F.avg("s"), 6).alias("within_var"), (F.var_samp("m") == 0).alias("zero"))


@register("vec14_reconstruction_loss", sql(f"SELECT vec_id, round(list_sum([abs(a[i] - b[i]) FOR i IN range(1, 65)]) / 64, 6) AS l1, round(list_sum([(a[i] - b[i]) ** 2 FOR i IN range(1, 65)]) / 64, 6) AS mse, round(1 - {COS.format(a='a', b='b')} + abs(ln(sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)))), 6) AS cosine_logmag FROM pair", more=PAIR))
def vec14(spark: S, d: str) -> DataFrame:
    diff = F.zip_with("a", "b", lambda x, y: x - y)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return successors(spark, d).select(
        "vec_id", F.round(total(F.transform(diff, F.abs)) / DIM, 6).alias("l1"), F.round(total(F.transform(diff, lambda x: x * x)) / DIM, 6).alias("mse"),
        F.round(1 - v.cosine(F.col("a"), F.col("b")) + F.abs(F.ln(v.norm(F.col("a")) / v.norm(F.col("b")))), 6).alias("cosine_logmag"))


@register("vec15_hull_distance")
def vec15(spark: S, d: str) -> DataFrame:
    """The distance of each vector to the hull of its label's mean vectors of the six eras: a bank of six, sent to each row by a join."""
    bank = cells(spark, d).groupBy(F.col("env").alias("label")).agg(F.flatten(F.array_sort(F.collect_list(F.struct("era", "v"))).getField("v")).alias("bank"))

    @F.pandas_udf("double")
    def far(bank: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([round(v.hull_distance(np.asarray(k).reshape(-1, DIM), np.asarray(y)), 6) for k, y in zip(bank, x, strict=True)])

    e = embedded(spark, d).withColumn("label", F.col("label").cast("long"))
    return e.join(F.broadcast(bank), "label").select("vec_id", "label", far("bank", "v").alias("distance"))


@register("vec16_quadratic_identity", sql("SELECT label::BIGINT AS label, round(sum(spread), 6) AS spread, round(abs(sum(spread) - sum(sq - m * m)), 6) AS violation, sum(m * m) <= sum(sq) + 1e-9 AS jensen FROM (SELECT label, i, avg(v[i]) AS m, avg(v[i] * v[i]) AS sq, var_pop(v[i]) AS spread FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL) GROUP BY label", more=E))
def vec16(spark: S, d: str) -> DataFrame:
    flat = embedded(spark, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("sq"), F.var_pop("x").alias("spread"))
    gap = F.abs(F.sum("spread") - F.sum(F.col("sq") - F.col("m") * F.col("m")))
    return flat.groupBy(F.col("label").cast("long").alias("label")).agg(F.round(F.sum("spread"), 6).alias("spread"), F.round(gap, 6).alias("violation"), (F.sum(F.col("m") * F.col("m")) <= F.sum("sq") + 1e-9).alias("jensen"))


@register("vec17_minimum_norm_interpolant")
def vec17(spark: S, d: str) -> DataFrame:
    """How well the labels' mean vectors span the eras' means: the residual after the minimum-norm interpolant."""
    pdf = v.bounded(cells(spark, d).orderBy("cell"))
    x = np.stack(pdf.groupby("env")["v"].apply(lambda s: np.mean(np.stack(s.to_numpy()), axis=0)).to_numpy()).T
    rows = []
    for era, part in pdf.groupby("era"):
        y = np.mean(np.stack(part["v"].to_numpy()), axis=0)
        c = np.linalg.lstsq(x.T @ x, x.T @ y, rcond=None)[0]
        rows.append((int(era), round(float(np.linalg.norm(c)), 6), round(float(np.linalg.norm(x @ c - y)), 6)))
    return spark.createDataFrame(rows, "era long, norm double, residual double")


@register("vec18_routing_coefficients", sql("SELECT vec_id, k - 1 AS k, round(exp((v[k] - m) / 0.5) / s, 6) AS weight FROM (SELECT vec_id, v, m, list_sum([exp((x - m) / 0.5) FOR x IN v]) AS s, unnest(range(1, 65)) AS k FROM (SELECT vec_id, v, list_max(v) AS m FROM e))", more=E))
def vec18(spark: S, d: str) -> DataFrame:
    e = embedded(spark, d).select("vec_id", F.col("v").alias("l")).withColumn("m", F.array_max("l"))
    w = F.transform("l", lambda x: F.exp((x - F.col("m")) / 0.5))
    out = e.select("vec_id", w.alias("w")).withColumn("s", F.aggregate("w", F.lit(0.0), lambda s, x: s + x)).select("vec_id", "s", F.posexplode("w").alias("k", "x"))
    return out.select("vec_id", F.col("k").cast("long").alias("k"), F.round(F.col("x") / F.col("s"), 6).alias("weight"))


LSE = "(list_max({v}) + ln(list_sum([exp(x - list_max({v})) FOR x IN {v}])))"


@register("vec19_kl_divergence", sql("SELECT vec_id, round(list_sum([exp(a[i] - la) * ((a[i] - la) - (b[i] - lb)) FOR i IN range(1, 65)]), 6) AS kl FROM (SELECT *, " + LSE.format(v="a") + " AS la, " + LSE.format(v="b") + " AS lb FROM pair)", more=PAIR))
def vec19(spark: S, d: str) -> DataFrame:
    p = successors(spark, d).select("vec_id", "a", "b", F.array_max("a").alias("ma"), F.array_max("b").alias("mb"))
    lse = lambda c, m: F.col(m) + F.ln(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x - F.col(m))))
    p = p.withColumn("la", lse("a", "ma")).withColumn("lb", lse("b", "mb"))
    term = F.zip_with("a", "b", lambda x, y: F.exp(x - F.col("la")) * ((x - F.col("la")) - (y - F.col("lb"))))
    return p.select("vec_id", F.round(F.aggregate(term, F.lit(0.0), lambda s, x: s + x), 6).alias("kl"))


PERM = f"SELECT perm, cell, env, row_number() OVER (PARTITION BY perm, env ORDER BY {draw_sql('era', 'perm', 'cell')}, cell) AS slot FROM vecs, range(0::BIGINT, {N_PERM}::BIGINT) r(perm)"


@register("stat08_era_permutation", sql(f"""SELECT round(any_value(o), 6) AS observed, (1 + count(*) FILTER (s >= o - 1e-12)) / {N_PERM + 1} AS p, round(avg(s), 6) AS null_mean, round((list_sort(list(s)))[{int(0.95 * N_PERM) + 1}], 6) AS null_p95 FROM (
    SELECT p.perm, avg(sim) AS s FROM ({PERM}) p JOIN ({PERM}) q ON p.perm = q.perm AND p.slot = q.slot AND p.env < q.env JOIN ({NEAR}) n ON n.cell = p.cell AND n.near = q.cell GROUP BY 1), (SELECT avg(sim) AS o FROM ({NEAR}) WHERE era = near_era)""", more=VECS))
def stat08(spark: S, d: str) -> DataFrame:
    """Whether eras look alike across environments: one-sided, against eras dealt anew within each environment; with the null's 95th percentile."""
    sims = cell_pairs(spark, d).where("a_env <> b_env").select("a_cell", "b_cell", "a_era", "b_era", v.cosine(F.col("a_v"), F.col("b_v")).alias("sim"))
    slot = F.row_number().over(Window.partitionBy("perm", "env").orderBy(draw("era", "perm", "cell"), "cell"))
    moved = times(cells(spark, d).select("cell", "env"), N_PERM).withColumn("slot", slot)
    a = moved.select("perm", "slot", F.col("cell").alias("a_cell"), F.col("env").alias("a_env"))
    z = moved.select("perm", "slot", F.col("cell").alias("b_cell"), F.col("env").alias("b_env"))
    null = a.join(z, ["perm", "slot"]).where("a_env < b_env").join(F.broadcast(sims), ["a_cell", "b_cell"]).groupBy("perm").agg(F.avg("sim").alias("s"))  # sixty cells squared
    seen = sims.where("a_era = b_era").agg(F.avg("sim").alias("o"))
    ordered = F.sort_array(F.collect_list("s"))  # a number a draw
    return null.crossJoin(seen).agg(
        F.round(F.max("o"), 6).alias("observed"), ((1 + F.count_if(F.col("s") >= F.col("o") - 1e-12)) / (N_PERM + 1)).alias("p"), F.round(F.avg("s"), 6).alias("null_mean"),
        F.round(F.get(ordered, int(0.95 * N_PERM)), 6).alias("null_p95"))


def probe(spark: S, d: str, target: str) -> tuple[str, float, float, float]:
    """Held-out accuracy of a multinomial logistic probe for a label, with majority and uniform chance."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    e = embedded(spark, d).withColumn("era", F.col("vec_id") % 6).withColumn("y", F.col(target).cast("double"))
    e = e.select("vec_id", "y", array_to_vector("v").alias("raw")).withColumn("test", draw("probe", "vec_id") % 10 < 3)
    train, test = e.where("NOT test"), e.where("test")
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
    model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-3, maxIter=50).fit(scaler.transform(train))
    hit, n, classes = model.transform(scaler.transform(test)).agg(F.avg((F.col("prediction") == F.col("y")).cast("double")), F.count("*"), F.count_distinct("y")).first()
    most = test.groupBy("y").count().agg(F.max("count")).first()[0]
    return target, round(hit, 6), round(most / n, 6), round(1 / classes, 6)


@register("stat11_identity_probe")
def stat11(spark: S, d: str) -> DataFrame:
    return spark.createDataFrame([probe(spark, d, "label")], "target string, accuracy double, majority double, uniform double")


@register("stat12_probe_decomposition")
def stat12(spark: S, d: str) -> DataFrame:
    return spark.createDataFrame([probe(spark, d, t) for t in ("label", "era")], "target string, accuracy double, majority double, uniform double")


@register("vec15_simplex_projection", sql("SELECT vec_id, round(theta, 6) AS theta, len([x FOR x IN v IF x > theta])::BIGINT AS support, round(list_sum([greatest(0, x - theta) FOR x IN v]), 6) AS total FROM (SELECT vec_id, any_value(v) AS v, max((s - 1) / k) AS theta FROM (SELECT vec_id, v, k, sum(x) OVER (PARTITION BY vec_id ORDER BY k) AS s FROM (SELECT vec_id, v, unnest(list_sort(v, 'DESC')) AS x, unnest(range(1, len(v) + 1)) AS k FROM e)) GROUP BY 1)", more=E))
def vec15b(spark: S, d: str) -> DataFrame:
    """Each vector's projection onto the simplex: what a threshold leaves of it, found from the sums of its largest components."""
    sums = F.aggregate(F.sort_array("v", asc=False), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"), F.lit(float("-inf")).alias("t")),
        lambda acc, x: F.struct((acc.s + x).alias("s"), (acc.k + 1).alias("k"), F.greatest(acc.t, (acc.s + x - 1) / (acc.k + 1)).alias("t")))
    e = embedded(spark, d).select("vec_id", "v", sums.getField("t").alias("t"))
    return e.select("vec_id", F.round("t", 6).alias("theta"), F.size(F.filter("v", lambda x: x > F.col("t"))).cast("long").alias("support"),
        F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), x - F.col("t"))), 6).alias("total"))


INVARIANTS = VECS | {
    "n": "SELECT env, count(*) AS n, min(era) AS low FROM vecs GROUP BY 1",
    "c": "SELECT v.env, era, v, 1.0::DOUBLE / n AS w, 1.0::DOUBLE / n - (era = low)::INTEGER AS dw FROM vecs v JOIN n ON n.env = v.env",
    "m": "SELECT env, i, sum(w * v[i]) AS m, sum(dw * v[i]) AS dm FROM (SELECT env, w, dw, v, unnest(range(1, 65)) AS i FROM c) GROUP BY ALL",
    "g": "SELECT a.env, sum(a.w * z.w * list_dot_product(a.v, z.v)) AS q, sum(a.dw * z.dw * list_dot_product(a.v, z.v)) AS dq FROM c a JOIN c z ON a.env = z.env GROUP BY 1",
}


@register("vec16_mixture_invariants", sql("SELECT g.env, round(abs(q - mm), 6) AS norm_violation, round(abs(dq - dd), 6) AS contrast_violation, sqrt(mm) <= most + 1e-9 AS within_largest, q >= -1e-9 AS positive FROM g JOIN (SELECT env, sum(m * m) AS mm, sum(dm * dm) AS dd FROM m GROUP BY 1) s ON s.env = g.env JOIN (SELECT env, max(sqrt(list_dot_product(v, v))) AS most FROM c GROUP BY 1) k ON k.env = g.env", more=INVARIANTS))
def vec16b(spark: S, d: str) -> DataFrame:
    """For uniform mixtures of each environment's cells: norms and contrasts by the Gram matrix equal those of the vectors, and no mixture is longer than its longest part."""
    c = cells(spark, d)
    n = c.groupBy("env").agg(F.count("*").alias("n"), F.min("era").alias("low"))
    c = c.join(n, "env").select("env", "era", "v", (1 / F.col("n")).alias("w"), (1 / F.col("n") - (F.col("era") == F.col("low")).cast("int")).alias("dw"))
    m = c.select("env", "w", "dw", F.posexplode("v").alias("i", "x")).groupBy("env", "i").agg(F.sum(F.col("w") * F.col("x")).alias("m"), F.sum(F.col("dw") * F.col("x")).alias("dm"))
    sums = m.groupBy("env").agg(F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("dm") * F.col("dm")).alias("dd"))
    z = c.select("env", F.col("v").alias("z"), F.col("w").alias("zw"), F.col("dw").alias("zdw"))
    dot = F.aggregate(F.zip_with("v", "z", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    g = c.join(z, "env").groupBy("env").agg(F.sum(F.col("w") * F.col("zw") * dot).alias("q"), F.sum(F.col("dw") * F.col("zdw") * dot).alias("dq"))
    most = c.groupBy("env").agg(F.max(v.norm(F.col("v"))).alias("most"))
    return g.join(sums, "env").join(most, "env").select(
        "env", F.round(F.abs(F.col("q") - F.col("mm")), 6).alias("norm_violation"), F.round(F.abs(F.col("dq") - F.col("dd")), 6).alias("contrast_violation"),
        (F.sqrt("mm") <= F.col("most") + 1e-9).alias("within_largest"), (F.col("q") >= -1e-9).alias("positive"))


#: Sources of a conditioning vector by label: stored ones up to 3, one constant for 4 and 5, a hash beyond.
KIND = "CASE WHEN vec_id % 5 = 0 THEN 'sample' WHEN label < 4 THEN 'stored' WHEN label < 6 THEN 'constant' ELSE 'hash' END"


@register("ag20_whole_conditioning", sql(f"""SELECT vec_id, kind, round(list_sum(x), 6) AS total, round(sqrt(list_sum([y * y FOR y IN x])), 6) AS norm, round(x[64], 6) + 0.0 AS last FROM (SELECT vec_id, {KIND} AS kind,
    CASE {KIND} WHEN 'sample' THEN v WHEN 'stored' THEN m WHEN 'constant' THEN [0.125::DOUBLE FOR i IN range(64)] ELSE [{draw_sql('cond', 'label', 'i')} / 4294967296.0 FOR i IN range(64)] END AS x FROM e LEFT JOIN (SELECT env, list(s ORDER BY i) AS m FROM (SELECT label AS env, i, avg(v[i]) AS s FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL) GROUP BY 1) ON env = label)""", more=E))
def ag20_whole(spark: S, d: str) -> DataFrame:
    """Every vector's conditioning, all components: its own, else its label's stored mean, else a constant of length 1, else a hash of the label. A label that should be stored and isn't is an error."""
    e = embedded(spark, d)
    stored = v.mean_vector(e, ["label"], "v", DIM).withColumnRenamed("v", "m").where("label < 4")
    return conditioned(e.withColumn("own", F.when(F.col("vec_id") % 5 == 0, F.col("v"))), stored, F.col("label") < 4, F.col("label") < 6).select(
        "vec_id", "kind", F.round(F.aggregate("x", F.lit(0.0), lambda s, y: s + y), 6).alias("total"), F.round(v.norm(F.col("x")), 6).alias("norm"), (F.round(F.element_at("x", -1), 6) + 0.0).alias("last"))


def conditioned(rows: DataFrame, stored: DataFrame, is_stored, is_constant) -> DataFrame:
    """``rows`` (label, own) with ``kind`` and ``x``: the vector by precedence. ``stored`` (label, m) has a row a label that is stored; one that is missing there raises."""
    j = rows.join(F.broadcast(stored), "label", "left")
    hashed = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: draw("cond", F.col("label"), i) / 4294967296.0)
    kind = F.when(F.col("own").isNotNull(), "sample").when(is_stored, "stored").when(is_constant, "constant").otherwise("hash")
    told = F.raise_error(F.concat(F.lit("no stored vector for label "), F.col("label").cast("string"))).cast("array<double>")
    x = F.when(F.col("kind") == "sample", F.col("own")).when(F.col("kind") == "stored", F.when(F.col("m").isNull(), told).otherwise(F.col("m"))).when(F.col("kind") == "constant", F.array_repeat(F.lit(DIM**-0.5), DIM)).otherwise(hashed)
    return j.withColumn("kind", kind).withColumn("x", x)
