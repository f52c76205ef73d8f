"""Queries over transfer matrices and site matrices, and the tests on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.functions.rng import draw, draw_sql
from evalgrid.operators import evals
from evalgrid.operators.resampling import N_PERM, N_PERM_PAIRS, bootstrap, bootstrap_sql, line, line_sql, numbered, sign_flips, sign_flips_sql, times
from evalgrid.operators.selection import rank_within
from evalgrid.plans import register
from evalgrid.plans.ctes import sql
from evalgrid.sources import bindings as b
from evalgrid.sources import files

S = SparkSession


def kind():
    """What a pair of cells shares."""
    return F.when(F.col("src") == F.col("dst"), "diagonal").when(F.col("src_era") == F.col("dst_era"), "theme").when(F.col("src_env") == F.col("dst_env"), "env").otherwise("neither")


KIND_SQL = "CASE WHEN src = dst THEN 'diagonal' WHEN src_era = dst_era THEN 'theme' WHEN src_env = dst_env THEN 'env' ELSE 'neither' END"
CLASSED = {"classed": f"SELECT *, {KIND_SQL} AS kind FROM matrix"}
#: How a mean and a deviation are rounded everywhere.
MEAN_SQL = "round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(value) AS n"


def mean_columns() -> list:
    """Mean, deviation and number of the values that are there."""
    return [F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd"), F.count("value").alias("n")]


def classed(spark: S, d: str, m: DataFrame | None = None) -> DataFrame:
    """The matrix (``m``, or the given tables') with the kind of each pair. It must have two environments and two eras at least."""
    m = b.transfer(spark, d) if m is None else m
    factors = b.cells(spark, d).agg(F.count_distinct("env").alias("env"), F.count_distinct("era").alias("era")).first()
    if min(factors) < 2:
        raise ValueError("a dissociation needs two environments and two eras at least")
    return m.withColumn("kind", kind())


@register("src10_matrix_from_runs", sql("""SELECT a.cell || '__on__' || z.cell AS pair, round(value, 6) AS value, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN value IS NULL THEN 'unreadable' ELSE 'ok' END AS status FROM cells a CROSS JOIN cells z LEFT JOIN (
    SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n, avg((l_quantity >= 25)::DOUBLE) FILTER (l_quantity IS NOT NULL) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) ON src = a.cell AND dst = z.cell""", "cells"))
def src10(spark: S, d: str) -> DataFrame:
    """The matrix from runs named by their pair: names are taken apart, rates recomputed from the records at the caller's threshold, pairs that never ran stay, and failures are told."""
    line = b.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    s = b.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    c = b.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(b.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    runs = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("l_orderkey") == F.col("o_orderkey"))
    named = runs.select(F.concat_ws("__on__", "s_nationkey", "c_nationkey").alias("pair"), F.col("l_quantity").alias("score"))
    return matrix_from_runs(named, b.cells(spark, d).select(F.col("cell").cast("string").alias("cell")), 25.0)


def matrix_from_runs(runs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """``pair, value, n, status`` of the whole grid, from records (``pair, score``): the share of scores that reach the threshold. A pair without records is missing, one without any score unreadable."""
    side = lambda i: F.split_part("pair", F.lit("__on__"), F.lit(i))
    counted = runs.groupBy("pair").agg(F.count("*").alias("n"), F.avg((F.col("score") >= threshold).cast("double")).alias("value"))
    counted = counted.select(side(1).alias("a"), side(2).alias("z"), "n", "value")
    grid = cells.select(F.col("cell").alias("a")).crossJoin(F.broadcast(cells.select(F.col("cell").alias("z"))))  # the grid of the design
    out = grid.join(counted, ["a", "z"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("value").isNull(), "unreadable").otherwise("ok")
    return out.select(F.concat_ws("__on__", "a", "z").alias("pair"), F.round("value", 6).alias("value"), F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


@register("jn04_pair_grid_coverage", sql("SELECT src_env AS env, count(*) AS pairs, count(value) AS filled, count(*) FILTER (value IS NULL OR n < 20) AS missing, round(count(value) / count(*), 6) AS coverage FROM matrix WHERE src <> dst GROUP BY 1", "matrix"))
def jn04(spark: S, d: str) -> DataFrame:
    m = b.transfer(spark, d).where("src <> dst")
    return m.groupBy(F.col("src_env").alias("env")).agg(F.count("*").alias("pairs"), F.count("value").alias("filled"), F.count_if(F.col("value").isNull() | (F.col("n") < 20)).alias("missing"), F.round(F.count("value") / F.count("*"), 6).alias("coverage"))


@register("jn05_dissociation_scores", sql(f"SELECT kind, {MEAN_SQL}, count(*) AS total FROM classed GROUP BY kind", "matrix", more=CLASSED))
def jn05(spark: S, d: str) -> DataFrame:
    return classed(spark, d).groupBy("kind").agg(*mean_columns(), F.count("*").alias("total"))


PER_SOURCE = "SELECT src, src_env, src_era, avg(value) FILTER (kind = 'theme') - avg(value) FILTER (kind = 'env') AS diff, avg(value) FILTER (kind = 'theme') AS theme, avg(value) FILTER (kind = 'env') AS env FROM classed GROUP BY 1, 2, 3"


def per_source(spark: S, d: str, m: DataFrame | None = None) -> DataFrame:
    of = lambda k: F.avg(F.when(F.col("kind") == k, F.col("value")))
    return classed(spark, d, m).groupBy("src", "src_env", "src_era").agg(of("theme").alias("theme"), of("env").alias("env")).withColumn("diff", F.col("theme") - F.col("env"))


@register("jn05_dissociation_per_source", sql(f"SELECT src, round(theme, 6) AS theme_mean, round(env, 6) AS env_mean, round(diff, 6) AS difference FROM ({PER_SOURCE})", "matrix", more=CLASSED))
def jn05b(spark: S, d: str) -> DataFrame:
    return per_source(spark, d).select("src", F.round("theme", 6).alias("theme_mean"), F.round("env", 6).alias("env_mean"), F.round("diff", 6).alias("difference"))


@register("jn05_dissociation_per_target", sql("SELECT dst, round(avg(value) FILTER (kind = 'theme'), 6) AS theme_mean, round(avg(value) FILTER (kind = 'env'), 6) AS env_mean, round(avg(value) FILTER (kind = 'neither'), 6) AS neither_mean, count(value) FILTER (kind <> 'diagonal') AS n FROM classed GROUP BY 1", "matrix", more=CLASSED))
def jn05c(spark: S, d: str) -> DataFrame:
    of = lambda k: F.round(F.avg(F.when(F.col("kind") == k, F.col("value"))), 6).alias(f"{k}_mean")
    return classed(spark, d).groupBy("dst").agg(of("theme"), of("env"), of("neither"), F.count(F.when(F.col("kind") != "diagonal", F.col("value"))).alias("n"))


DECAY = """SELECT a.src_env = a.dst_env AS same_env, abs(a.src_year - a.dst_year) AS gap, coalesce((a.value + z.value) / 2, a.value, z.value) AS value, a.src, a.dst
  FROM matrix a JOIN matrix z ON a.src = z.dst AND a.dst = z.src WHERE a.src < a.dst AND a.src_year IS NOT NULL AND a.dst_year IS NOT NULL"""


def decay_points(spark: S, d: str) -> DataFrame:
    """Unordered pairs: whether they share an environment, the gap of years, and the mean of both directions."""
    m = b.transfer(spark, d).where("src_year IS NOT NULL AND dst_year IS NOT NULL")
    pair = m.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.max(F.col("src_env") == F.col("dst_env")).alias("same_env"), F.max(F.abs(F.col("src_year") - F.col("dst_year"))).alias("gap"), F.avg("value").alias("value"))
    return pair.where("src <> dst")


@register("jn06_distance_decay", sql(f"SELECT same_env, {line_sql('gap', 'value')} FROM ({DECAY}) GROUP BY same_env", "matrix"))
def jn06(spark: S, d: str) -> DataFrame:
    return decay_points(spark, d).groupBy("same_env").agg(*line(F.col("gap"), F.col("value")))


@register("jn06_decay_by_gap", sql(f"SELECT same_env, gap, {MEAN_SQL} FROM ({DECAY}) GROUP BY same_env, gap", "matrix"))
def jn06b(spark: S, d: str) -> DataFrame:
    return decay_points(spark, d).groupBy("same_env", "gap").agg(*mean_columns())


@register("jn07_asymmetry", sql("""SELECT round(avg(abs(a.value - z.value)), 6) AS mean_abs, count(*) AS n,
    round(avg(a.value) FILTER (a.src_env = a.dst_env AND a.src_year < a.dst_year), 6) AS older_on_newer, round(avg(z.value) FILTER (a.src_env = a.dst_env AND a.src_year < a.dst_year), 6) AS newer_on_older
  FROM matrix a JOIN matrix z ON a.src = z.dst AND a.dst = z.src WHERE a.src < a.dst AND a.value IS NOT NULL AND z.value IS NOT NULL""", "matrix"))
def jn07(spark: S, d: str) -> DataFrame:
    m = b.transfer(spark, d)
    back = m.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("value").alias("back"))
    both = m.where("src < dst").join(back, ["src", "dst"]).where("value IS NOT NULL AND back IS NOT NULL")
    aged = (F.col("src_env") == F.col("dst_env")) & (F.col("src_year") < F.col("dst_year"))
    return both.agg(F.round(F.avg(F.abs(F.col("value") - F.col("back"))), 6).alias("mean_abs"), F.count("*").alias("n"), F.round(F.avg(F.when(aged, F.col("value"))), 6).alias("older_on_newer"), F.round(F.avg(F.when(aged, F.col("back"))), 6).alias("newer_on_older"))


NORMAL = "SELECT m.*, CASE WHEN o.value >= 0.05 THEN m.value / o.value END AS normal, coalesce(o.value >= 0.05, false) AS kept FROM matrix m JOIN (SELECT dst, value FROM matrix WHERE src = dst) o USING (dst)"


def normalised(spark: S, d: str, least: float = 0.05, m: DataFrame | None = None) -> DataFrame:
    """Each entry as a share of its column's diagonal; columns whose diagonal is missing or below ``least`` are null."""
    m = b.transfer(spark, d) if m is None else m
    own = m.where("src = dst").select("dst", F.col("value").alias("own"))
    ok = F.coalesce(F.col("own") >= least, F.lit(False))
    return m.join(F.broadcast(own), "dst").withColumn("normal", F.when(ok, F.col("value") / F.col("own"))).withColumn("kept", ok)


@register("jn08_normalised_transfer", sql(f"SELECT src, dst, round(normal, 6) AS normal, kept FROM ({NORMAL})", "matrix"))
def jn08(spark: S, d: str) -> DataFrame:
    return normalised(spark, d).select("src", "dst", F.round("normal", 6).alias("normal"), "kept")


@register("jn08_normalisation_usable", sql(f"SELECT count(DISTINCT dst) FILTER (NOT kept) AS dropped, count(DISTINCT dst) AS columns, count(DISTINCT dst) FILTER (NOT kept) < count(DISTINCT dst) // 2 AS usable FROM ({NORMAL})", "matrix"))
def jn08b(spark: S, d: str) -> DataFrame:
    return usability(normalised(spark, d))


def usability(normal: DataFrame) -> DataFrame:
    """How many columns the normalisation drops, and whether it is fit for use."""
    out = normal.agg(F.count_distinct(F.when(~F.col("kept"), F.col("dst"))).alias("dropped"), F.count_distinct("dst").alias("columns"))
    return out.withColumn("usable", F.col("dropped") < F.floor(F.col("columns") / 2))


@register("ag08_breakdown_by_era", sql("SELECT src_era AS era, round(avg(value) FILTER (kind = 'theme'), 6) AS theme, round(avg(value) FILTER (kind = 'env'), 6) AS env, round(avg(value) FILTER (kind = 'neither'), 6) AS neither, rank() OVER (ORDER BY round(avg(value) FILTER (kind = 'theme'), 6) DESC)::BIGINT AS place FROM classed GROUP BY 1", "matrix", more=CLASSED))
def ag08(spark: S, d: str) -> DataFrame:
    wide = classed(spark, d).groupBy(F.col("src_era").alias("era")).pivot("kind", ["theme", "env", "neither"]).agg(F.round(F.avg("value"), 6))
    return wide.withColumn("place", F.rank().over(Window.orderBy(F.desc("theme"))).cast("long"))


@register("snk06_pivoted_matrix", sql("SELECT src, " + ", ".join(f"coalesce(any_value(format('{{:.1f}}', round(100 * value, 1))) FILTER (dst = {k}), '.') AS d{k}" for k in range(25)) + " FROM matrix GROUP BY src", "matrix"))
def snk06(spark: S, d: str) -> DataFrame:
    shown = b.transfer(spark, d).select("src", "dst", F.format_string("%.1f", F.round(100 * F.col("value"), 1)).alias("text"), "value")
    wide = shown.withColumn("text", F.when(F.col("value").isNotNull(), F.col("text"))).groupBy("src").pivot("dst", list(range(25))).agg(F.first("text"))
    return wide.select("src", *[F.coalesce(F.col(str(k)), F.lit(".")).alias(f"d{k}") for k in range(25)])


# Site matrices: arms against task groups.

SITE = {"site_units": "SELECT arm, grp, era AS version, seed, count(*) AS k, count(*) FILTER (reward >= 1) AS s, avg((reward >= 1)::DOUBLE) AS m FROM evals GROUP BY ALL",
        "site": "SELECT arm, grp, sum(k)::BIGINT AS n, sum(s)::BIGINT AS solved, sum(s) / sum(k) AS success, sqrt(sum(s) / sum(k) * (1 - sum(s) / sum(k)) / sum(k)) AS se, count(*) AS n_units, avg(m) AS unit_mean FROM site_units GROUP BY arm, grp"}


def site_units(spark: S, d: str) -> DataFrame:
    """One aggregate for each arm, task group, version and seed; everything else about sites comes from it."""
    return b.eval_records(spark, d).groupBy("arm", "grp", F.col("era").alias("version"), "seed").agg(
        F.count("*").alias("k"), F.count_if(F.col("reward") >= 1).alias("s"), F.avg((F.col("reward") >= 1).cast("double")).alias("m"))


def site_matrix(units: DataFrame) -> DataFrame:
    out = units.groupBy("arm", "grp").agg(F.sum("k").alias("n"), F.sum("s").alias("solved"), F.count("*").alias("n_units"), F.avg("m").alias("unit_mean"))
    return out.withColumn("success", F.col("solved") / F.col("n")).withColumn("se", evals.binomial(F.col("n"), F.col("solved")))


@register("ag09_site_matrix", sql("""SELECT arm, g.grp, coalesce(n, 0)::BIGINT AS n, coalesce(solved, 0)::BIGINT AS solved, round(success, 6) AS success, round(se, 6) AS se, coalesce(n_units, 0) AS n_units, round(unit_mean, 6) AS unit_mean, coalesce(dropped, 0) AS dropped
  FROM arms CROSS JOIN (VALUES ('wiki'), ('news'), ('shop'), ('multi')) g(grp) LEFT JOIN (SELECT * FROM site WHERE n_units > 0) USING (arm, grp) LEFT JOIN (SELECT arm, count(*) AS dropped FROM evals WHERE grp IS NULL OR reward IS NULL GROUP BY 1) USING (arm)""", "evals", "arms", more=SITE))
def ag09(spark: S, d: str) -> DataFrame:
    """Episode pool and unit mean of every arm and group, the whole grid kept, and each arm's records without a group or a reward."""
    m = site_matrix(site_units(spark, d))
    grid = b.arms(spark).select("arm").crossJoin(spark.createDataFrame([(g,) for g in b.GROUPS], "grp string"))
    dropped = b.eval_records(spark, d).groupBy("arm").agg(F.count_if(F.col("grp").isNull() | F.col("reward").isNull()).alias("dropped"))
    out = grid.join(m, ["arm", "grp"], "left").join(dropped, "arm", "left").fillna(0, ["n", "solved", "n_units", "dropped"])
    return out.select("arm", "grp", "n", "solved", *[F.round(c, 6).alias(c) for c in ("success", "se", "unit_mean")], "n_units", "dropped")


def own():
    """Whether a row is its column's own."""
    return F.col("arm") == F.concat(F.lit("L_"), F.col("grp"))


GAP = """SELECT version, avg(m) FILTER (own) - avg(m) FILTER (NOT own) AS gap, count(*) FILTER (own) AS n_diag, count(*) FILTER (NOT own) AS n_off, sqrt(var_samp(m) FILTER (own) / count(*) FILTER (own) + var_samp(m) FILTER (NOT own) / count(*) FILTER (NOT own)) AS unit_se, NULL::DOUBLE AS pool_se FROM single GROUP BY version
  UNION ALL SELECT NULL, pd - po, nd, no_, unit_se, sqrt(pd * (1 - pd) / kd + po * (1 - po) / ko) FROM (SELECT sum(s) FILTER (own) AS sd, sum(k) FILTER (own) AS kd, sum(s) FILTER (NOT own) AS so, sum(k) FILTER (NOT own) AS ko, sd / kd AS pd, so / ko AS po, count(DISTINCT arm || grp) FILTER (own) AS nd, count(DISTINCT arm || grp) FILTER (NOT own) AS no_,
    sqrt(var_samp(m) FILTER (own) / count(*) FILTER (own) + var_samp(m) FILTER (NOT own) / count(*) FILTER (NOT own)) AS unit_se FROM single)"""


@register("ag10_diagonal_gap", sql(f"SELECT version, round(gap, 6) AS gap, n_diag, n_off, round(unit_se, 6) AS unit_se, round(pool_se, 6) AS pool_se FROM ({GAP})", "evals", more=SITE | {"single": "SELECT *, arm = 'L_' || grp AS own FROM site_units WHERE arm <> 'M_all'"}))
def ag10(spark: S, d: str) -> DataFrame:
    """Diagonal less the rest by version and pooled, with the standard error over units, and the binomial one of the pools."""
    u = site_units(spark, d).where("arm <> 'M_all'").withColumn("own", own())
    side = lambda c, o: F.when(F.col("own") == o, F.col(c))
    cells = lambda o: F.count_distinct(F.when(F.col("own") == o, F.concat("arm", "grp")))
    unit_se = F.sqrt(F.var_samp(side("m", True)) / F.count_if("own") + F.var_samp(side("m", False)) / F.count_if(~F.col("own")))
    per = u.groupBy("version").agg((F.avg(side("m", True)) - F.avg(side("m", False))).alias("gap"), F.count_if("own").alias("n_diag"), F.count_if(~F.col("own")).alias("n_off"), unit_se.alias("unit_se")).withColumn("pool_se", F.lit(None).cast("double"))
    rate = lambda o: F.sum(side("s", o)) / F.sum(side("k", o))
    var = lambda o: rate(o) * (1 - rate(o)) / F.sum(side("k", o))
    whole = u.agg((rate(True) - rate(False)).alias("gap"), cells(True).alias("n_diag"), cells(False).alias("n_off"), unit_se.alias("unit_se"), F.sqrt(var(True) + var(False)).alias("pool_se")).withColumn("version", F.lit(None).cast("long"))
    return per.unionByName(whole).select("version", F.round("gap", 6).alias("gap"), "n_diag", "n_off", F.round("unit_se", 6).alias("unit_se"), F.round("pool_se", 6).alias("pool_se"))


LOSO = {**SITE, "loso": """SELECT arm, pl, sl, pr, sr, ql, tl, qr, tr, pr - pl AS penalty, qr - ql AS seen_delta FROM (
    SELECT a.arm, any_value(s.success) FILTER (s.grp = a.held_out) AS pl, any_value(s.se) FILTER (s.grp = a.held_out) AS sl, any_value(r.success) FILTER (s.grp = a.held_out) AS pr, any_value(r.se) FILTER (s.grp = a.held_out) AS sr,
      sum(s.solved) FILTER (list_contains(seen, s.grp)) / sum(s.n) FILTER (list_contains(seen, s.grp)) AS ql, sum(r.solved) FILTER (list_contains(seen, s.grp)) / sum(r.n) FILTER (list_contains(seen, s.grp)) AS qr,
      sum(s.n) FILTER (list_contains(seen, s.grp)) AS nl, sum(r.n) FILTER (list_contains(seen, s.grp)) AS nr, sqrt(ql * (1 - ql) / nl) AS tl, sqrt(qr * (1 - qr) / nr) AS tr
    FROM arms a JOIN site s USING (arm) JOIN site r ON r.arm = 'M_all' AND r.grp = s.grp WHERE held_out IS NOT NULL GROUP BY a.arm)"""}


def loso(spark: S, d: str) -> DataFrame:
    """Each leave-one-out arm against the reference: held-out column, pooled seen columns."""
    m = site_matrix(site_units(spark, d))
    ref = m.where("arm = 'M_all'").select("grp", *[F.col(c).alias(f"r_{c}") for c in ("n", "solved", "success", "se")])
    both = b.arms(spark).where("held_out IS NOT NULL").join(m, "arm").join(F.broadcast(ref), "grp")
    held, seen = F.col("grp") == F.col("held_out"), F.array_contains("seen", F.col("grp"))
    one = lambda c: F.max(F.when(held, F.col(c)))
    all_ = lambda c: F.sum(F.when(seen, F.col(c)))
    g = both.groupBy("arm").agg(one("success").alias("pl"), one("se").alias("sl"), one("r_success").alias("pr"), one("r_se").alias("sr"), all_("n").alias("nl"), all_("solved").alias("kl"), all_("r_n").alias("nr"), all_("r_solved").alias("kr"))
    g = g.withColumn("ql", F.col("kl") / F.col("nl")).withColumn("qr", F.col("kr") / F.col("nr")).withColumn("tl", evals.binomial(F.col("nl"), F.col("kl"))).withColumn("tr", evals.binomial(F.col("nr"), F.col("kr")))
    return g.withColumn("penalty", F.col("pr") - F.col("pl")).withColumn("seen_delta", F.col("qr") - F.col("ql"))


@register("ag11_leave_one_out_table", sql("""SELECT arm, round(penalty, 6) AS penalty, round(retention, 6) AS retention, round(seen_delta, 6) AS seen_delta, round(penalty - seen_delta, 6) AS did, round(se, 6) AS did_se,
    CASE WHEN se IS NULL OR se <= 0 THEN 'insufficient' WHEN (penalty - seen_delta) / se >= 2 THEN 'specific' WHEN abs((penalty - seen_delta) / se) < 1 THEN 'general' ELSE 'indeterminate' END AS verdict
  FROM (SELECT arm, penalty, pl / pr AS retention, seen_delta, se FROM rows_ UNION ALL SELECT '_pooled', avg(penalty), sum(pl) / sum(pr), avg(seen_delta), sqrt(sum(se * se)) / count(*) FROM rows_)""", "evals", "arms", more=LOSO | {"rows_": "SELECT *, sqrt(sl * sl + sr * sr + tl * tl + tr * tr) AS se FROM loso"}))
def ag11(spark: S, d: str) -> DataFrame:
    """Penalty, retention and difference in differences of each arm, and of all of them pooled, with errors added in quadrature."""
    g = loso(spark, d).withColumn("se", F.sqrt(F.expr("sl * sl + sr * sr + tl * tl + tr * tr")))
    pooled = g.agg(F.lit("_pooled").alias("arm"), F.avg("penalty").alias("penalty"), (F.sum("pl") / F.sum("pr")).alias("retention"), F.avg("seen_delta").alias("seen_delta"), (F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count("*")).alias("se"))
    rows = g.select("arm", "penalty", F.expr("pl / pr").alias("retention"), "seen_delta", "se").unionByName(pooled).withColumn("did", F.col("penalty") - F.col("seen_delta"))
    z = F.col("did") / F.col("se")
    verdict = F.when(F.col("se").isNull() | (F.col("se") <= 0), "insufficient").when(z >= 2, "specific").when(F.abs(z) < 1, "general").otherwise("indeterminate")
    return rows.select("arm", *[F.round(c, 6).alias(c) for c in ("penalty", "retention", "seen_delta", "did")], F.round("se", 6).alias("did_se"), verdict.alias("verdict"))


OOD = {"keyed": "SELECT arm, era, seed, task_id, arg_min(sites, episode_id) AS sites, avg(reward) AS reward FROM evals GROUP BY 1, 2, 3, 4",
       "binned": "SELECT k.arm, k.sites, k.reward, r.reward AS ref, len(list_filter(k.sites, lambda s: s = a.held_out)) || '/' || len(k.sites) AS frac, len(list_filter(k.sites, lambda s: s = a.held_out)) / len(k.sites) AS f FROM keyed k JOIN arms a USING (arm) JOIN keyed r ON r.arm = 'M_all' AND r.era = k.era AND r.seed = k.seed AND r.task_id = k.task_id WHERE a.held_out IN ('wiki', 'news', 'shop')"}


def ood_bins(spark: S, d: str) -> DataFrame:
    """Pairs of arm and reference records of one task, with the share of the task's sites that the arm never saw."""
    keyed = b.eval_records(spark, d).groupBy("arm", "era", "seed", "task_id").agg(F.avg("reward").alias("reward"), F.first("sites").alias("sites"))
    ref = keyed.where("arm = 'M_all'").select("era", "seed", "task_id", F.col("reward").alias("ref"))
    own = F.broadcast(b.arms(spark).where(F.col("held_out").isin(*b.SITES)).select("arm", "held_out"))
    unseen = F.size(F.filter("sites", lambda s: s == F.col("held_out")))
    return keyed.join(own, "arm").join(ref, ["era", "seed", "task_id"]).withColumn("f", unseen / F.size("sites")).withColumn("frac", F.concat_ws("/", unseen, F.size("sites")))


@register("ag12_ood_gradient", sql("SELECT arm, round(f, 6) AS f, count(*) AS n, round(avg(ref - reward), 6) AS penalty, round(avg(ref - reward) - lag(avg(ref - reward)) OVER (PARTITION BY arm ORDER BY f), 6) AS rise FROM binned GROUP BY arm, f", "evals", "arms", more=OOD))
def ag12(spark: S, d: str) -> DataFrame:
    g = ood_bins(spark, d).groupBy("arm", "f").agg(F.count("*").alias("n"), F.avg(F.col("ref") - F.col("reward")).alias("p"))
    rise = F.col("p") - F.lag("p").over(Window.partitionBy("arm").orderBy("f"))
    return g.select("arm", F.round("f", 6).alias("f"), "n", F.round("p", 6).alias("penalty"), F.round(rise, 6).alias("rise"))


@register("ag12_ood_subgroups", sql("SELECT arm, array_to_string(sites, '+') AS sites_key, round(any_value(f), 6) AS f, count(*) AS n, round(avg(ref - reward), 6) AS penalty FROM binned GROUP BY ALL", "evals", "arms", more=OOD))
def ag12b(spark: S, d: str) -> DataFrame:
    """The same penalties by the sites that a task needs."""
    g = ood_bins(spark, d).groupBy("arm", F.array_join("sites", "+").alias("sites_key"))
    return g.agg(F.round(F.max("f"), 6).alias("f"), F.count("*").alias("n"), F.round(F.avg(F.col("ref") - F.col("reward")), 6).alias("penalty"))


BINS = {"bins": "SELECT arm, f, avg(ref - reward) AS p FROM binned GROUP BY arm, f",
        "ranks": "SELECT arm, rank() OVER (PARTITION BY arm ORDER BY f) AS rf, rank() OVER (PARTITION BY arm ORDER BY p) + (count(*) OVER (PARTITION BY arm, p) - 1) / 2 AS rp, p - lag(p) OVER (PARTITION BY arm ORDER BY f) AS rise FROM bins"}


@register("ag12_ood_trend", sql("SELECT arm, count(*) AS bins, coalesce(bool_and(rise >= 0), true) AS monotone, round(corr(rf, rp), 6) AS rho FROM ranks GROUP BY arm", "evals", "arms", more=OOD | BINS))
def ag12c(spark: S, d: str) -> DataFrame:
    """Whether an arm's penalty rises with the unseen share, and the rank correlation of the two over its bins."""
    g = ood_bins(spark, d).groupBy("arm", "f").agg(F.avg(F.col("ref") - F.col("reward")).alias("p"))
    w = Window.partitionBy("arm")
    r = g.select("arm", F.rank().over(w.orderBy("f")).alias("rf"), (F.rank().over(w.orderBy("p")) + (F.count("*").over(Window.partitionBy("arm", "p")) - 1) / 2).alias("rp"), (F.col("p") - F.lag("p").over(w.orderBy("f"))).alias("rise"))
    return r.groupBy("arm").agg(F.count("*").alias("bins"), F.coalesce(F.bool_and(F.col("rise") >= 0), F.lit(True)).alias("monotone"), F.round(F.corr("rf", "rp"), 6).alias("rho"))


@register("win04_column_winners", sql("SELECT grp, arg_max(arm, (success, arm)) AS best_row, round(max(success), 6) AS best, arg_max(arm, (success, arm)) = 'L_' || grp AS own_is_best FROM site GROUP BY grp", "evals", more=SITE))
def win04(spark: S, d: str) -> DataFrame:
    m = site_matrix(site_units(spark, d))
    best = F.max(F.struct("success", "arm"))
    return m.groupBy("grp").agg(best.alias("b")).select("grp", F.col("b.arm").alias("best_row"), F.round("b.success", 6).alias("best"), (F.col("b.arm") == F.concat(F.lit("L_"), "grp")).alias("own_is_best"))


# Tests.

DIFFS = {"diffs": f"SELECT src, diff FROM ({PER_SOURCE}) WHERE diff IS NOT NULL"}


@register("stat01_sign_flip", sql(sign_flips_sql("diffs", "src", "diff", N_PERM, "flip"), "matrix", more=CLASSED | DIFFS))
def stat01(spark: S, d: str) -> DataFrame:
    # A row a source, kept, so the matrix is built once however often the test looks at them.
    return sign_flips(files.kept(per_source(spark, d).where("diff IS NOT NULL").select("src", "diff"), "diffs"), "src", "diff", N_PERM, "flip")


UNIT_DIFFS = {**SITE, "unit_diffs": "SELECT a.arm, a.grp, a.version * 10 + a.seed AS unit, o.m - a.m AS diff FROM site_units a JOIN site_units o ON o.arm = 'L_' || a.grp AND o.grp = a.grp AND o.version = a.version AND o.seed = a.seed WHERE a.arm <> o.arm"}


@register("jn09_paired_unit_tests", sql(sign_flips_sql("unit_diffs", "unit", "diff", N_PERM, "units", ["arm", "grp"]), "evals", more=UNIT_DIFFS))
def jn09(spark: S, d: str) -> DataFrame:
    u = site_units(spark, d)
    mine = u.where(own()).select("grp", "version", "seed", F.col("m").alias("own_m"))
    diffs = u.where(~own()).join(mine, ["grp", "version", "seed"]).select("arm", "grp", (F.col("version") * 10 + F.col("seed")).alias("unit"), (F.col("own_m") - F.col("m")).alias("diff"))
    return sign_flips(diffs, "unit", "diff", N_PERM, "units", ["arm", "grp"])


POINTS = {"points": f"SELECT * FROM ({DECAY}) WHERE same_env AND value IS NOT NULL"}
RANKED = "SELECT src, dst, rank() OVER (ORDER BY gap) + (count(*) OVER (PARTITION BY gap) - 1) / 2 AS rx, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS ry, row_number() OVER (ORDER BY src, dst) AS pos FROM points"


def ranked_points(spark: S, d: str) -> DataFrame:
    p = decay_points(spark, d).where("same_env AND value IS NOT NULL")
    rank = lambda c: (F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2).cast("double")
    return p.select("src", "dst", rank("gap").alias("rx"), rank("value").alias("ry"), F.row_number().over(Window.orderBy("src", "dst")).cast("long").alias("pos"))


@register("stat02_spearman", sql(f"""SELECT n, round(rho, 6) AS rho, (1 + hits) / {N_PERM_PAIRS + 1}.0::DOUBLE AS p FROM (SELECT count(*) AS n, corr(rx, ry) AS rho FROM ({RANKED})), (
    SELECT count(*) FILTER (abs(r) >= abs(o) - 1e-12) AS hits FROM (SELECT perm, corr(a.rx, z.ry) AS r FROM (
      SELECT perm, rx, row_number() OVER (PARTITION BY perm ORDER BY {draw_sql('rho', 'perm', 'pos')}, pos) AS slot FROM ({RANKED}), range(0::BIGINT, {N_PERM_PAIRS}::BIGINT) p(perm)) a JOIN ({RANKED}) z ON z.pos = a.slot GROUP BY perm), (SELECT corr(rx, ry) AS o FROM ({RANKED})))""", "matrix", more=POINTS))
def stat02(spark: S, d: str) -> DataFrame:
    r = ranked_points(spark, d)
    slot = F.row_number().over(Window.partitionBy("perm").orderBy(draw("rho", "perm", "pos"), "pos"))
    moved = times(r.select("pos", "rx"), N_PERM_PAIRS).withColumn("slot", slot.cast("long")).join(r.select(F.col("pos").alias("slot"), "ry"), "slot").groupBy("perm").agg(F.corr("rx", "ry").alias("r"))
    seen = r.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))
    hits = moved.crossJoin(seen).agg(F.count_if(F.abs("r") >= F.abs("rho") - 1e-12).alias("hits"))
    return seen.crossJoin(hits).select("n", F.round("rho", 6).alias("rho"), ((1 + F.col("hits")) / (N_PERM_PAIRS + 1)).alias("p"))


@register("stat03_ols", "SELECT l_returnflag, " + line_sql("l_quantity", "l_extendedprice") + " FROM lineitem GROUP BY 1")
def stat03(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "lineitem").groupBy("l_returnflag").agg(*line(F.col("l_quantity"), F.col("l_extendedprice")))


@register("stat03_slope_permutation", sql(f"""SELECT n, round(slope, 6) AS slope, round(r2, 6) AS r2, (1 + hits) / {N_PERM_PAIRS + 1}.0::DOUBLE AS p FROM (SELECT count(*) AS n, regr_slope(value, gap) AS slope, corr(gap, value) ** 2 AS r2 FROM points), (
    SELECT count(*) FILTER (abs(b) >= abs(o) - 1e-12) AS hits FROM (SELECT perm, regr_slope(z.value, a.gap) AS b FROM (
      SELECT perm, gap, row_number() OVER (PARTITION BY perm ORDER BY {draw_sql('slope', 'perm', 'pos')}, pos) AS slot FROM numbered_points, range(0::BIGINT, {N_PERM_PAIRS}::BIGINT) p(perm)) a JOIN numbered_points z ON z.pos = a.slot GROUP BY perm), (SELECT regr_slope(value, gap) AS o FROM points))""",
    "matrix", more=POINTS | {"numbered_points": "SELECT *, row_number() OVER (ORDER BY src, dst) AS pos FROM points"}))
def stat03b(spark: S, d: str) -> DataFrame:
    """The slope of transfer over the gap of years, with a permutation p: values are dealt anew to the gaps."""
    points = decay_points(spark, d).where("same_env AND value IS NOT NULL")
    r = points.withColumn("pos", F.row_number().over(Window.orderBy("src", "dst")).cast("long"))
    slot = F.row_number().over(Window.partitionBy("perm").orderBy(draw("slope", "perm", "pos"), "pos")).cast("long")
    moved = times(r.select("pos", "gap"), N_PERM_PAIRS).withColumn("slot", slot).join(r.select(F.col("pos").alias("slot"), "value"), "slot").groupBy("perm").agg(F.regr_slope("value", "gap").alias("b"))
    seen = r.agg(F.count("*").alias("n"), F.regr_slope("value", "gap").alias("slope"), F.pow(F.corr("gap", "value"), 2).alias("r2"))
    hits = moved.crossJoin(seen).agg(F.count_if(F.abs("b") >= F.abs("slope") - 1e-12).alias("hits"))
    return seen.crossJoin(hits).select("n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), ((1 + F.col("hits")) / (N_PERM_PAIRS + 1)).alias("p"))


@register("stat04_bootstrap_mean", sql(bootstrap_sql("diffs", "src", "diff", N_PERM, "boot"), "matrix", more=CLASSED | DIFFS))
def stat04(spark: S, d: str) -> DataFrame:
    return bootstrap(files.kept(per_source(spark, d).select("src", "diff"), "diffs"), "src", "diff", N_PERM, "boot")


CLUSTERS = {"clusters": f"SELECT row_number() OVER (ORDER BY src) - 1 AS unit, theme, env FROM ({PER_SOURCE}) WHERE theme IS NOT NULL OR env IS NOT NULL"}


@register("stat05_cluster_bootstrap", sql(f"""SELECT round(quantile_cont(t, 0.025), 6) AS theme_low, round(quantile_cont(t, 0.975), 6) AS theme_high, round(quantile_cont(e, 0.025), 6) AS env_low, round(quantile_cont(e, 0.975), 6) AS env_high, round(quantile_cont(t - e, 0.025), 6) AS diff_low, round(quantile_cont(t - e, 0.975), 6) AS diff_high FROM (
    SELECT perm, avg(v.theme) AS t, avg(v.env) AS e FROM (SELECT perm, {draw_sql('cluster', 'perm', 'unit')} % (SELECT count(*) FROM clusters) AS pick FROM clusters, range(0::BIGINT, {N_PERM}::BIGINT) p(perm)) JOIN clusters v ON v.unit = pick GROUP BY perm)""", "matrix", more=CLASSED | CLUSTERS))
def stat05(spark: S, d: str) -> DataFrame:
    """Both means and their difference from one resample of the cells that have any."""
    u = files.kept(numbered(per_source(spark, d).where("theme IS NOT NULL OR env IS NOT NULL").select("src", "theme", "env"), "src"), "clusters")
    size = u.agg(F.count("*").alias("size"))
    drawn = times(u.select("unit").crossJoin(size), N_PERM).select("perm", (draw("cluster", "perm", "unit") % F.col("size")).alias("unit"))
    means = drawn.join(u, "unit").groupBy("perm").agg(F.avg("theme").alias("t"), F.avg("env").alias("e"))
    q = lambda c, p, n: F.round(F.percentile(c, p), 6).alias(n)
    diff = F.col("t") - F.col("e")
    return means.agg(q("t", 0.025, "theme_low"), q("t", 0.975, "theme_high"), q("e", 0.025, "env_low"), q("e", 0.975, "env_high"), q(diff, 0.025, "diff_low"), q(diff, 0.975, "diff_high"))


@register("stat06_label_permutation", sql(f"""SELECT round(any_value(o), 6) AS observed, (1 + count(*) FILTER (abs(x) >= abs(o) - 1e-12)) / {N_PERM_PAIRS + 1} AS p FROM (
    SELECT s.perm, avg(value) FILTER (le = re AND s.src <> z.src) - avg(value) FILTER (ln = rn AND le <> re) AS x FROM
      (SELECT p.perm, p.cell AS src, c.era AS le, c.env AS ln FROM slots p JOIN cells c ON c.cell = p.slot) s
      JOIN (SELECT p.perm, p.cell AS src, c.era AS re, c.env AS rn FROM slots p JOIN cells c ON c.cell = p.slot) z ON s.perm = z.perm JOIN matrix m ON m.src = s.src AND m.dst = z.src GROUP BY s.perm),
  (SELECT avg(value) FILTER (kind = 'theme') - avg(value) FILTER (kind = 'env') AS o FROM classed)""", "matrix", more=CLASSED | {"slots": f"SELECT perm, cell, row_number() OVER (PARTITION BY perm ORDER BY {draw_sql('label', 'perm', 'cell')}, cell) - 1 AS slot FROM cells, range(0::BIGINT, {N_PERM_PAIRS}::BIGINT) r(perm)"}))
def stat06(spark: S, d: str) -> DataFrame:
    c = b.cells(spark, d)
    slot = (F.row_number().over(Window.partitionBy("perm").orderBy(draw("label", "perm", "cell"), "cell")) - 1).cast("long")
    labels = times(c.select("cell"), N_PERM_PAIRS).withColumn("slot", slot).join(c.select(F.col("cell").alias("slot"), "env", "era"), "slot").select("perm", "cell", "env", "era")
    whole = files.kept(b.transfer(spark, d), "matrix")
    m = whole.where("value IS NOT NULL AND src <> dst").select("src", "dst", "value")
    side = lambda n: labels.select("perm", F.col("cell").alias(n), F.col("env").alias(f"{n}_env"), F.col("era").alias(f"{n}_era"))
    moved = m.join(F.broadcast(side("src")), "src").join(F.broadcast(side("dst")), ["perm", "dst"])
    x = F.avg(F.when(F.col("src_era") == F.col("dst_era"), F.col("value"))) - F.avg(F.when((F.col("src_env") == F.col("dst_env")) & (F.col("src_era") != F.col("dst_era")), F.col("value")))
    seen = classed(spark, d, whole).agg((F.avg(F.when(F.col("kind") == "theme", F.col("value"))) - F.avg(F.when(F.col("kind") == "env", F.col("value")))).alias("o"))
    return moved.groupBy("perm").agg(x.alias("x")).crossJoin(seen).agg(F.round(F.max("o"), 6).alias("observed"), ((1 + F.count_if(F.abs("x") >= F.abs("o") - 1e-12)) / (N_PERM_PAIRS + 1)).alias("p"))


NORMAL_DIFFS = {
    "normals": f"SELECT *, {KIND_SQL} AS kind FROM ({NORMAL})",
    "normal_diffs": "SELECT src, diff FROM (SELECT src, avg(normal) FILTER (kind = 'theme') - avg(normal) FILTER (kind = 'env') AS diff FROM normals GROUP BY 1) WHERE diff IS NOT NULL",
}


def ladder_sql(tests: str) -> str:
    return f"SELECT observed, p_two, CASE WHEN observed IS NULL OR p_two IS NULL OR p_two >= 0.05 OR abs(observed) < 0.02 THEN 'inconclusive' WHEN observed > 0 THEN 'organizes_by_theme' ELSE 'organizes_by_environment' END AS verdict FROM ({tests})"


def ladder(tests: DataFrame) -> DataFrame:
    """The decision on one matrix: significant at .05 and an effect of .02 at least, else inconclusive."""
    undecided = F.col("observed").isNull() | F.col("p_two").isNull() | (F.col("p_two") >= 0.05) | (F.abs("observed") < 0.02)
    return tests.select("observed", "p_two", F.when(undecided, "inconclusive").when(F.col("observed") > 0, "organizes_by_theme").otherwise("organizes_by_environment").alias("verdict"))


@register("stat07_verdict", sql(f"""SELECT r.observed AS raw_difference, r.p_two AS raw_p, r.verdict AS raw_verdict, z.observed AS normal_difference, z.p_two AS normal_p, z.verdict AS normal_verdict, usable, CASE WHEN usable THEN z.verdict ELSE r.verdict END AS verdict, r.verdict <> z.verdict AS disagree
  FROM ({ladder_sql(sign_flips_sql('diffs', 'src', 'diff', N_PERM, 'flip'))}) r, ({ladder_sql(sign_flips_sql('normal_diffs', 'src', 'diff', N_PERM, 'flip'))}) z, (SELECT count(DISTINCT dst) FILTER (NOT kept) < count(DISTINCT dst) // 2 AS usable FROM normals)""", "matrix", more=CLASSED | DIFFS | NORMAL_DIFFS))
def stat07(spark: S, d: str) -> DataFrame:
    """The ladder on the raw and on the normalised matrix; the normalised one leads while it is usable."""
    m = files.kept(b.transfer(spark, d), "matrix")
    raw = ladder(sign_flips(per_source(spark, d, m).where("diff IS NOT NULL").select("src", "diff"), "src", "diff", N_PERM, "flip"))
    of = lambda k: F.avg(F.when(F.col("kind") == k, F.col("normal")))
    normal = normalised(spark, d, m=m).withColumn("kind", kind()).groupBy("src").agg((of("theme") - of("env")).alias("diff")).where("diff IS NOT NULL")
    second = ladder(sign_flips(normal, "src", "diff", N_PERM, "flip"))
    both = raw.toDF("raw_difference", "raw_p", "raw_verdict").crossJoin(second.toDF("normal_difference", "normal_p", "normal_verdict")).crossJoin(usability(normalised(spark, d, m=m)).select("usable"))
    return both.withColumn("verdict", F.when(F.col("usable"), F.col("normal_verdict")).otherwise(F.col("raw_verdict"))).withColumn("disagree", F.col("raw_verdict") != F.col("normal_verdict"))


SCORES = {"pair_diffs": "SELECT a.era * 1000 + a.seed * 231 + a.task_id AS unit, a.m - z.m AS diff, a.m >= 1 AS wa, z.m >= 1 AS wz FROM (SELECT task_id, seed, era, avg(reward) AS m FROM evals WHERE arm = 'L_wiki' GROUP BY ALL) a JOIN (SELECT task_id, seed, era, avg(reward) AS m FROM evals WHERE arm = 'M_all' GROUP BY ALL) z USING (task_id, seed, era)"}
CONTROL = "CASE WHEN p IS NULL THEN 'inconclusive' WHEN p >= 0.05 OR coalesce(abs(dz) < 0.2, false) THEN 'does_nothing' WHEN observed > 0 THEN 'functional' ELSE 'harmful' END"


def control_verdict():
    """Whether an adapter beats its random control: significant at .05 with an effect of .2 deviations at least."""
    return F.when(F.col("p").isNull(), "inconclusive").when((F.col("p") >= 0.05) | F.coalesce(F.abs("dz") < 0.2, F.lit(False)), "does_nothing").when(F.col("observed") > 0, "functional").otherwise("harmful")


def pair_scores(spark: S, d: str) -> DataFrame:
    from evalgrid.plans.records import paired

    return paired(spark, d).select((F.col("era") * 1000 + F.col("seed") * 231 + F.col("task_id")).alias("unit"), (F.col("ma") - F.col("mb")).alias("diff"), (F.col("ma") >= 1).alias("wa"), (F.col("mb") >= 1).alias("wz"))


@register("stat09_random_control", sql(f"SELECT n_units, observed, p, dz, low, high, b, c, {CONTROL} AS verdict FROM (SELECT n_units, observed, p_two AS p, d_z AS dz FROM ({sign_flips_sql('pair_diffs', 'unit', 'diff', N_PERM, 'control')})) t, (SELECT low, high FROM ({bootstrap_sql('pair_diffs', 'unit', 'diff', N_PERM, 'control-ci')})) i, (SELECT count(*) FILTER (wa AND NOT wz) AS b, count(*) FILTER (wz AND NOT wa) AS c FROM pair_diffs)", "evals", more=SCORES))
def stat09(spark: S, d: str) -> DataFrame:
    """The paired control: sign flips, an interval of the mean difference, and the discordant pairs."""
    p = files.kept(pair_scores(spark, d), "pairs")
    counts = p.agg(F.count_if(F.col("wa") & ~F.col("wz")).alias("b"), F.count_if(F.col("wz") & ~F.col("wa")).alias("c"))
    t = sign_flips(p.select("unit", "diff"), "unit", "diff", N_PERM, "control").select("n_units", "observed", F.col("p_two").alias("p"), F.col("d_z").alias("dz"))
    interval = bootstrap(p.select("unit", "diff"), "unit", "diff", N_PERM, "control-ci").select("low", "high")
    return t.crossJoin(interval).crossJoin(counts).withColumn("verdict", control_verdict())


POOLED = {
    "pooled": "SELECT row_number() OVER (ORDER BY g DESC, unit) - 1 AS i, g, x, count(*) FILTER (g) OVER () AS k FROM (SELECT true AS g, era * 1000 + seed * 231 + task_id AS unit, avg(reward) AS x FROM evals WHERE arm = 'L_wiki' GROUP BY ALL UNION ALL SELECT false, era * 1000 + seed * 231 + task_id, avg(reward) FROM evals WHERE arm = 'M_all' GROUP BY ALL)",
    "dealt": f"SELECT perm, x, row_number() OVER (PARTITION BY perm ORDER BY {draw_sql('unpaired', 'perm', 'i')}, i) <= k AS side FROM pooled, range(0::BIGINT, 500::BIGINT) p(perm)",
    "observed_arms": "SELECT avg(x) FILTER (g) - avg(x) FILTER (NOT g) AS o, sqrt((var_samp(x) FILTER (g) + var_samp(x) FILTER (NOT g)) / 2) AS sd FROM pooled",
}


@register("stat09_unpaired_control", sql(f"SELECT observed, p, dz, {CONTROL} AS verdict FROM (SELECT round(any_value(o), 6) AS observed, (1 + count(*) FILTER (abs(t) >= abs(o) - 1e-12)) / 501.0::DOUBLE AS p, round(any_value(o / sd), 6) AS dz FROM (SELECT perm, avg(x) FILTER (side) - avg(x) FILTER (NOT side) AS t FROM dealt GROUP BY perm), observed_arms)", "evals", more=POOLED))
def stat09b(spark: S, d: str, n: int = 500) -> DataFrame:
    """The unpaired control: labels of the arms are dealt anew. Its units are some thousands, so the draws number ``n``."""
    e = b.eval_records(spark, d).where(F.col("arm").isin("L_wiki", "M_all"))
    x = e.groupBy((F.col("arm") == "L_wiki").alias("g"), (F.col("era") * 1000 + F.col("seed") * 231 + F.col("task_id")).alias("unit")).agg(F.avg("reward").alias("x"))
    pooled = x.withColumn("i", (F.row_number().over(Window.orderBy(F.desc("g"), "unit")) - 1).cast("long")).crossJoin(x.agg(F.count_if("g").alias("k")))
    side = F.row_number().over(Window.partitionBy("perm").orderBy(draw("unpaired", "perm", "i"), "i")) <= F.col("k")
    moved = times(pooled, n).withColumn("side", side).groupBy("perm").agg((F.avg(F.when(F.col("side"), F.col("x"))) - F.avg(F.when(~F.col("side"), F.col("x")))).alias("t"))
    arm = lambda f, own: f(F.when(F.col("g") if own else ~F.col("g"), F.col("x")))
    seen = x.agg((arm(F.avg, True) - arm(F.avg, False)).alias("o"), F.sqrt((arm(F.var_samp, True) + arm(F.var_samp, False)) / 2).alias("sd"))
    out = moved.crossJoin(seen).agg(F.round(F.max("o"), 6).alias("observed"), ((1 + F.count_if(F.abs("t") >= F.abs("o") - 1e-12)) / (n + 1)).alias("p"), F.round(F.max(F.col("o") / F.col("sd")), 6).alias("dz"))
    return out.withColumn("verdict", control_verdict())


@register("stat10_stratified_split", f"SELECT vec_id, label, CASE WHEN rn <= greatest(1, least(n - 1, round(0.3 * n))) THEN 'test' ELSE 'train' END AS side FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {draw_sql('split', 'vec_id')}, vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def stat10(spark: S, d: str) -> DataFrame:
    """A share of each class is held out. Ranks are taken within ranges of the draws, whose counts are summed up first, so a large class is sorted in many tasks."""
    e = b.table(spark, d, "embeddings").select("vec_id", "label").withColumn("u", draw("split", "vec_id"))
    ranked = rank_within(e, ["label"], F.shiftright("u", 24), ["u", "vec_id"], "rn")
    most = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.round(0.3 * F.col("n"))))
    return ranked.join(F.broadcast(e.groupBy("label").agg(F.count("*").alias("n"))), "label").select("vec_id", "label", F.when(F.col("rn") <= most, "test").otherwise("train").alias("side"))


@register("stat10_grouped_holdout", f"""WITH groups AS (SELECT g, row_number() OVER (ORDER BY {draw_sql('groups', 'g')}, g) <= greatest(1, round(0.3 * count(*) OVER ())) AS test FROM (SELECT DISTINCT source AS g FROM documents WHERE source IS NOT NULL))
  SELECT lang AS label, count(*) FILTER (test) AS n_test, count(*) FILTER (NOT test) AS n_train, count(*) FILTER (NOT test) = 0 AS absent_from_train, count(DISTINCT source) FILTER (test) AS test_groups FROM documents JOIN groups ON g = source GROUP BY 1""")
def stat10b(spark: S, d: str) -> DataFrame:
    """Whole groups go to one side; fewer than four can't be split. Classes that the training side lacks are marked."""
    docs = b.table(spark, d, "documents").select("source", "lang").where("source IS NOT NULL")
    groups = docs.select(F.col("source").alias("g")).distinct()
    n = groups.count()
    if n < 4:
        raise ValueError(f"a grouped split needs four groups at least, not {n}")
    sides = groups.withColumn("test", F.row_number().over(Window.orderBy(draw("groups", "g"), "g")) <= F.greatest(F.lit(1), F.round(0.3 * F.lit(n))))
    g = docs.join(F.broadcast(sides), F.col("source") == F.col("g")).groupBy(F.col("lang").alias("label"))
    train = F.count_if(~F.col("test"))
    return g.agg(F.count_if("test").alias("n_test"), train.alias("n_train"), (train == 0).alias("absent_from_train"), F.count_distinct(F.when(F.col("test"), F.col("source"))).alias("test_groups"))


@register("stat13_trust_gate", sql("""SELECT check_name, required, status, required AND status <> 'ok' AS blocking, NOT bool_or(required AND status <> 'ok') OVER () AS trusted FROM (
    SELECT 'episodes' AS check_name, true AS required, CASE WHEN count(*) = 0 THEN 'skipped' WHEN count(*) FILTER (n_steps = 0) * 2 > count(*) THEN 'failed' ELSE 'ok' END AS status FROM episodes
    UNION ALL SELECT 'matrix_filled', false, CASE WHEN count(value) = 0 THEN 'skipped' WHEN count(value) < count(*) THEN 'failed' ELSE 'ok' END FROM matrix
    UNION ALL SELECT 'identity_labels', true, CASE WHEN count(label) = 0 THEN 'skipped' WHEN count(label) < count(*) OR count(DISTINCT label) < 2 THEN 'failed' ELSE 'ok' END FROM embeddings
    UNION ALL SELECT 'random_control', true, CASE WHEN count(*) < 2 THEN 'skipped' ELSE 'ok' END FROM pair_diffs)""", "evals", "matrix", more=SCORES))
def stat13(spark: S, d: str) -> DataFrame:
    """Checks with their status; a required one that was skipped blocks like one that failed."""
    one = lambda df, name, required, skipped, failed: df.agg(F.when(skipped, "skipped").when(failed, "failed").otherwise("ok").alias("status")).select(F.lit(name).alias("check_name"), F.lit(required).alias("required"), "status")
    n, never = F.count("*"), F.lit(False)
    rows = (
        one(b.episodes(spark, d), "episodes", True, n == 0, F.count_if(F.col("n_steps") == 0) * 2 > n)
        .unionByName(one(b.transfer(spark, d), "matrix_filled", False, F.count("value") == 0, F.count("value") < n))
        .unionByName(one(b.table(spark, d, "embeddings"), "identity_labels", True, F.count("label") == 0, (F.count("label") < n) | (F.count_distinct("label") < 2)))
        .unionByName(one(pair_scores(spark, d), "random_control", True, n < 2, never)))
    blocking = F.col("required") & (F.col("status") != "ok")
    return rows.withColumn("blocking", blocking).withColumn("trusted", ~F.bool_or(blocking).over(Window.partitionBy()))


CONTROLLED = sql(f"SELECT verdict, n_units FROM (SELECT n_units, observed, p, dz, {CONTROL} AS verdict FROM (SELECT n_units, observed, p_two AS p, d_z AS dz FROM ({sign_flips_sql('pair_diffs', 'unit', 'diff', N_PERM, 'control')})))", "evals", more=SCORES)


@register("stat13_control_gate", f"""SELECT 'random_control' AS check_name, CASE WHEN n_units < 2 OR verdict = 'inconclusive' THEN 'skipped' WHEN verdict = 'functional' THEN 'ok' ELSE 'failed' END AS status, verdict, coalesce(n_units < 2 OR verdict <> 'functional', true) AS blocking FROM ({CONTROLLED})""")
def stat13_control(spark: S, d: str) -> DataFrame:
    """The gate's own look at the random control: it fails where the adapter does nothing or harms, and a control that decides nothing counts as skipped, which blocks as well."""
    t = sign_flips(files.kept(pair_scores(spark, d).select("unit", "diff"), "pairs"), "unit", "diff", N_PERM, "control")
    return control_gate(t.select("n_units", "observed", F.col("p_two").alias("p"), F.col("d_z").alias("dz")).withColumn("verdict", control_verdict()))


def control_gate(control: DataFrame) -> DataFrame:
    """``check_name, status, verdict, blocking`` from the paired control's row (columns n_units, verdict)."""
    status = F.when((F.col("n_units") < 2) | (F.col("verdict") == "inconclusive"), "skipped").when(F.col("verdict") == "functional", "ok").otherwise("failed")
    return control.select(F.lit("random_control").alias("check_name"), status.alias("status"), "verdict").withColumn("blocking", F.col("status") != "ok")


@register("snk06_marked_matrix", sql("SELECT src, '| **' || src || '** | ' || string_agg(CASE WHEN value IS NULL THEN '.' WHEN src = dst THEN '**' || format('{:.1f}', round(100 * value, 1)) || '**' ELSE format('{:.1f}', round(100 * value, 1)) END, ' | ' ORDER BY dst) || ' |' AS line FROM matrix GROUP BY src", "matrix"))
def snk06_marked(spark: S, d: str) -> DataFrame:
    """The matrix as lines of a table, a row a cell: what is missing is a dot, and each cell's own entry is emphasised."""
    number = F.format_string("%.1f", F.round(100 * F.col("value"), 1))
    text = F.when(F.col("value").isNull(), F.lit(".")).when(F.col("src") == F.col("dst"), F.concat(F.lit("**"), number, F.lit("**"))).otherwise(number)
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", text.alias("t")))), lambda x: x.t), " | ")  # as many as there are cells
    return b.transfer(spark, d).groupBy("src").agg(row.alias("r")).select("src", F.concat(F.lit("| **"), F.col("src").cast("string"), F.lit("** | "), "r", F.lit(" |")).alias("line"))
