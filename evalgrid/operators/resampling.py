"""Permutation and bootstrap tests as plain plans: a range of draws times the units.

Units number a few dozen to a few thousand (cells, versions, seeds), never rows of a fact table;
they are aggregates, so the draws are what is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.functions.rng import draw


def times(units: DataFrame, n: int, name: str = "perm") -> DataFrame:
    """Every unit once for each of ``n`` draws. Units are few and may stand in one file, so they are dealt over the tasks first."""
    spread = units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def sign_flips(diffs: DataFrame, unit: str, value: str, n: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """Paired sign-flip test: observed mean, two-sided and one-sided p, the null's mean and deviation, d_z.

    ``diffs`` has a row for each unit. p counts the observed arrangement: (1 + hits) / (1 + n).
    Groups of fewer than two units get no p.
    """
    by = by or []
    seen = diffs.groupBy(*by).agg(F.avg(value).alias("observed"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n_units"))
    sign = F.lit(1) - 2 * (draw(seed, "perm", unit) % 2)
    null = times(diffs, n).groupBy(*by, "perm").agg(F.avg(F.col(value) * sign).alias("x"))
    joined = null.join(seen, by) if by else null.crossJoin(seen)
    tests = joined.groupBy(*by).agg(
        F.count_if(F.abs("x") >= F.abs("observed") - 1e-12).alias("two"), F.count_if(F.col("x") >= F.col("observed") - 1e-12).alias("one"),
        F.avg("x").alias("null_mean"), F.stddev_samp("x").alias("null_sd"))
    out = seen.join(tests, by) if by else seen.crossJoin(tests)
    enough = lambda c: F.when(F.col("n_units") >= 2, c)
    return out.select(
        *by, "n_units", F.round("observed", 6).alias("observed"), enough((1 + F.col("two")) / (1 + n)).alias("p_two"), enough((1 + F.col("one")) / (1 + n)).alias("p_one"),
        F.round("null_mean", 6).alias("null_mean"), F.round("null_sd", 6).alias("null_sd"), F.when(F.col("sd") > 1e-12, F.round(F.col("observed") / F.col("sd"), 6)).alias("d_z"))


def sign_flips_sql(diffs: str, unit: str, value: str, n: int, seed: str, by: list[str] | None = None) -> str:
    """The same test in DuckDB's SQL, over a table expression ``diffs``."""
    from evalgrid.functions.rng import draw_sql

    by = by or []
    keys = "".join(f"{c}, " for c in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    join = f"JOIN seen USING ({', '.join(by)})" if by else "CROSS JOIN seen"
    join_t = f"JOIN tests USING ({', '.join(by)})" if by else "CROSS JOIN tests"
    return f"""
SELECT {keys}n_units, round(observed, 6) AS observed, CASE WHEN n_units >= 2 THEN (1 + two) / {1 + n} END AS p_two, CASE WHEN n_units >= 2 THEN (1 + one) / {1 + n} END AS p_one,
  round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, CASE WHEN sd > 1e-12 THEN round(observed / sd, 6) END AS d_z
FROM (SELECT {keys}avg({value}) AS observed, stddev_samp({value}) AS sd, count({value}) AS n_units FROM {diffs} {group}) seen {join_t.replace('tests', f'''(
  SELECT {keys}count(*) FILTER (abs(x) >= abs(observed) - 1e-12) AS two, count(*) FILTER (x >= observed - 1e-12) AS one, avg(x) AS null_mean, stddev_samp(x) AS null_sd
  FROM (SELECT {keys}perm, avg({value} * (1 - 2 * ({draw_sql(seed, 'perm', unit)} % 2))) AS x FROM {diffs}, range(0::BIGINT, {n}::BIGINT) r(perm) GROUP BY {keys}perm) null_
  {join.replace('seen', f'(SELECT {keys}avg({value}) AS observed FROM {diffs} {group}) seen')} {group}) tests''')}"""


#: Draws of permutation and bootstrap tests, and of those over pairs of cells (fixed values of the design).
N_PERM, N_PERM_PAIRS = 10_000, 2_000


def numbered(units: DataFrame, order: str, name: str = "unit") -> DataFrame:
    """Units numbered from 0 without gaps. They are aggregates, a few thousand at most, so one sort is enough."""
    return units.withColumn(name, (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))


def bootstrap(units: DataFrame, order: str, value: str, n: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """Percentile bootstrap of a mean, with linear percentiles; units are numbered by ``order``, whatever gaps it has."""
    own = numbered(units.where(F.col(value).isNotNull()).select(order, value), order)
    size = own.agg(F.count("*").alias("size"))
    drawn = times(own.select("unit").crossJoin(size), n).select("perm", (draw(seed, "perm", "unit") % F.col("size")).alias("unit"))
    means = drawn.join(own.select("unit", value), "unit").groupBy("perm").agg(F.avg(value).alias("x"))
    return means.agg(F.round(F.percentile("x", alpha / 2), 6).alias("low"), F.round(F.percentile("x", 1 - alpha / 2), 6).alias("high")).crossJoin(
        own.agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n_units")))


def bootstrap_sql(units: str, order: str, value: str, n: int, seed: str) -> str:
    """The same interval in DuckDB's SQL."""
    from evalgrid.functions.rng import draw_sql

    own = f"(SELECT row_number() OVER (ORDER BY {order}) - 1 AS unit, {value} FROM {units} WHERE {value} IS NOT NULL)"
    return f"""SELECT low, high, mean, n_units FROM (SELECT round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM (
    SELECT perm, avg(v.{value}) AS x FROM (SELECT perm, {draw_sql(seed, 'perm', 'unit')} % (SELECT count(*) FROM {own}) AS pick FROM {own}, range(0::BIGINT, {n}::BIGINT) p(perm)) JOIN {own} v ON v.unit = pick GROUP BY perm)),
  (SELECT round(avg({value}), 6) AS mean, count(*) AS n_units FROM {own})"""


def line(x: Column, y: Column) -> list[Column]:
    """Slope, intercept, r and r squared of y on x; null with fewer than three points or without spread."""
    ok = (F.count(x) >= 3) & (F.coalesce(F.stddev_samp(x), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_samp(y), F.lit(0.0)) > 0)
    return [
        F.when(ok, F.round(F.regr_slope(y, x), 6)).alias("slope"), F.when(ok, F.round(F.regr_intercept(y, x), 6)).alias("intercept"),
        F.when(ok, F.round(F.corr(x, y), 6)).alias("r"), F.when(ok, F.round(F.corr(x, y) * F.corr(x, y), 6)).alias("r2"), F.count(x).alias("n")]


def line_sql(x: str, y: str) -> str:
    ok = f"count({x}) >= 3 AND coalesce(stddev_samp({x}), 0) > 0 AND coalesce(stddev_samp({y}), 0) > 0"
    return (f"CASE WHEN {ok} THEN round(regr_slope({y}, {x}), 6) END AS slope, CASE WHEN {ok} THEN round(regr_intercept({y}, {x}), 6) END AS intercept, "
            f"CASE WHEN {ok} THEN round(corr({x}, {y}), 6) END AS r, CASE WHEN {ok} THEN round(corr({x}, {y}) * corr({x}, {y}), 6) END AS r2, count({x}) AS n")
