"""Queries over evaluation records: aggregates, lookups, censuses, windows and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.functions.rng import draw, draw_sql
from evalgrid.operators import evals
from evalgrid.operators.selection import prefix_within, rank_within, smallest
from evalgrid.plans import register
from evalgrid.plans.ctes import sql
from evalgrid.sources import bindings as b

S = SparkSession


@register("ag01_episode_aggregate", sql(f"SELECT grp, {evals.SUMMARIES} FROM evals GROUP BY grp", "evals"))
def ag01(spark: S, d: str) -> DataFrame:
    return evals.aggregate(b.eval_records(spark, d), ["grp"])


@register("jn02_group_lookup_with_unknown", sql(f"""
  SELECT g.grp, count(e.episode_id) AS n, round(avg(reward), 6) AS avg_reward, count(e.episode_id) FILTER (reward >= 1) AS solved
  FROM (VALUES ('wiki'), ('news'), ('shop'), ('multi'), ('_unknown')) g(grp)
  LEFT JOIN (SELECT r.*, coalesce(t.grp, '_unknown') AS g FROM (SELECT episode_id, reward, episode_id % 240 + 1 AS task_id FROM episodes) r LEFT JOIN tasks t USING (task_id)) e ON e.g = g.grp
  GROUP BY g.grp""", "episodes"))
def jn02(spark: S, d: str) -> DataFrame:
    known = b.tasks(spark).select("task_id", "grp")
    records = b.episodes(spark, d).select("episode_id", "reward", (F.col("episode_id") % 240 + 1).alias("task_id"))
    found = records.join(F.broadcast(known), "task_id", "left").withColumn("grp", F.coalesce("grp", F.lit("_unknown")))
    counted = found.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("avg_reward"), F.count_if(F.col("reward") >= 1).alias("solved"))
    groups = spark.createDataFrame([(g,) for g in (*b.GROUPS, "_unknown")], "grp string")
    return groups.join(counted, "grp", "left").fillna(0, ["n", "solved"])


@register("jn01_task_dimension_lookup", sql("SELECT sites_key, grp, split, count(*) AS n, count(DISTINCT task_id) AS n_tasks, sum(n_steps)::BIGINT AS steps FROM episodes GROUP BY ALL", "episodes"))
def jn01(spark: S, d: str) -> DataFrame:
    facts = b.episodes(spark, d).select("task_id", "n_steps")
    found = facts.join(F.broadcast(b.tasks(spark)), "task_id", "left")
    return found.groupBy("sites_key", "grp", "split").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("n_tasks"), F.sum("n_steps").alias("steps"))


@register("src01_scan_episodes", sql("""
  SELECT episode_id, era, regexp_extract(name, 'run\\.(\\d+)_(\\d+)$', 1)::BIGINT AS task_id, regexp_extract(name, 'run\\.(\\d+)_(\\d+)$', 2)::BIGINT AS seed, reward, n_steps,
    CASE WHEN len(sites) = 1 THEN sites[1] || '_e' || era END AS cell
  FROM (SELECT *, 'trial_on_run.' || task_id || '_' || seed AS name FROM episodes)""", "episodes"))
def src01(spark: S, d: str) -> DataFrame:
    named = b.episodes(spark, d).withColumn("name", F.format_string("trial_on_run.%d_%d", "task_id", "seed"))
    part = lambda i: F.regexp_extract("name", r"run\.(\d+)_(\d+)$", i).cast("long")
    cell = F.when(F.size("sites") == 1, F.concat(F.col("sites")[0], F.lit("_e"), F.col("era").cast("string")))
    return named.select("episode_id", "era", part(1).alias("task_id"), part(2).alias("seed"), "reward", "n_steps", cell.alias("cell"))


@register("src02_load_nested_episode", """
  SELECT l_orderkey AS episode_id, count(*) AS n_steps, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS steps, arg_max(l_partkey, (l_linenumber, l_partkey)) AS last_step
  FROM lineitem GROUP BY l_orderkey""")
def src02(spark: S, d: str) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    nested = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode_id")).agg(steps.alias("s"))
    return nested.select("episode_id", F.size("s").cast("long").alias("n_steps"), F.array_join(F.transform("s", lambda x: x.l_partkey.cast("string")), ",").alias("steps"), F.element_at("s", -1).l_partkey.alias("last_step"))


@register("win01_latest_trial_dedup", """
  SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value, count(DISTINCT event_id) AS n_attempts FROM events GROUP BY 1, 2""")
def win01(spark: S, d: str) -> DataFrame:
    last = evals.latest(b.table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], "event_id")
    return last.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"), "n_attempts")


@register("ag02_drift_gap", sql("""
  SELECT arm, n_train, n_test, round(tr - te, 6) AS gap, round(sqrt(tr * (1 - tr) / n_train + te * (1 - te) / n_test), 6) AS se FROM (
    SELECT arm, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
      avg((reward >= 1)::DOUBLE) FILTER (split = 'train') AS tr, avg((reward >= 1)::DOUBLE) FILTER (split = 'test') AS te FROM evals GROUP BY arm)""", "evals"))
def ag02(spark: S, d: str) -> DataFrame:
    side = lambda s: F.avg(F.when(F.col("split") == s, (F.col("reward") >= 1).cast("double")))
    g = b.eval_records(spark, d).groupBy("arm").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"), side("train").alias("tr"), side("test").alias("te"))
    var = F.expr("tr * (1 - tr) / n_train + te * (1 - te) / n_test")
    return g.select("arm", "n_train", "n_test", F.round(F.col("tr") - F.col("te"), 6).alias("gap"), F.round(F.sqrt(var), 6).alias("se"))


CENSUS = """
  SELECT u.env, u.era, count(e.episode_id) AS n, count(e.episode_id) FILTER (reward >= 1) AS verified, count(e.episode_id) FILTER (reward >= 1) >= 20 AS ok
  FROM (SELECT env, era FROM (VALUES ('wiki'), ('news'), ('shop')) a(env), range(1::BIGINT, 7::BIGINT) r(era)) u
  LEFT JOIN episodes e ON e.era = u.era AND e.grp = u.env GROUP BY u.env, u.era"""


def grid(spark: S) -> DataFrame:
    """All (env, era) units."""
    envs = spark.createDataFrame([(e,) for e in b.SITES], "env string")
    return envs.crossJoin(spark.range(1, b.ERAS + 1).withColumnRenamed("id", "era"))


@register("ag03_census_with_zero_rows", sql(CENSUS, "episodes"))
def ag03(spark: S, d: str) -> DataFrame:
    counted = b.episodes(spark, d).where("grp <> 'multi'").groupBy(F.col("grp").alias("env"), "era").agg(F.count("*").alias("n"), F.count_if(F.col("reward") >= 1).alias("verified"))
    return grid(spark).join(counted, ["env", "era"], "left").fillna(0).withColumn("ok", F.col("verified") >= 20)


UNITS = [("wiki", "single"), ("news", "single"), ("shop", "single"), ("multi", "multi"), ("wiki+news", "composite"), ("wiki+shop", "composite"), ("news+shop", "composite"), ("wiki+news+shop", "composite"), ("all", "all")]
ACCEPTS = "(u.unit = 'all' OR (u.unit = 'multi' AND grp = 'multi') OR (grp <> 'multi' AND list_contains(string_split(u.unit, '+'), grp)))"
UNITS_SQL = ", ".join(f"('{u}', '{k}')" for u, k in UNITS)


def accepted(spark: S, facts: DataFrame) -> DataFrame:
    """Facts once for every unit that accepts them; a fact may count in several."""
    units = F.broadcast(spark.createDataFrame(UNITS, "unit string, kind string"))
    member = (F.col("unit") == "all") | ((F.col("unit") == "multi") & (F.col("grp") == "multi")) | ((F.col("grp") != "multi") & F.array_contains(F.split("unit", r"\+"), F.col("grp")))
    return facts.join(units, member)


@register("pf01_membership_predicate", sql(f"""
  SELECT u.unit, u.kind, count(*) AS n, round(avg(len(list_filter(sites, lambda s: u.unit <> 'all' AND NOT list_contains(string_split(u.unit, '+'), s))) / len(sites)), 6) AS unseen
  FROM episodes JOIN (VALUES {UNITS_SQL}) u(unit, kind) ON {ACCEPTS} WHERE era IN (2, 3, 4) GROUP BY 1, 2""", "episodes"))
def pf01(spark: S, d: str) -> DataFrame:
    found = accepted(spark, b.episodes(spark, d).where(F.col("era").isin(2, 3, 4)).select("episode_id", "grp", "sites"))
    unseen = F.when(F.col("unit") == "all", 0.0).otherwise(F.size(F.array_except("sites", F.split("unit", r"\+"))) / F.size("sites"))
    return found.groupBy("unit", "kind").agg(F.count("*").alias("n"), F.round(F.avg(unseen), 6).alias("unseen"))


@register("ag04_overlapping_unit_census", sql(f"""
  SELECT unit, n, verified, steps, per_era, min(steps) OVER () AS matched_dose FROM (
    SELECT unit, sum(k)::BIGINT AS n, sum(v)::BIGINT AS verified, sum(s)::BIGINT AS steps, string_agg(era || ':' || v, ',' ORDER BY era) AS per_era FROM (
      SELECT u.unit, era, count(*) AS k, count(*) FILTER (reward >= 1) AS v, sum(n_steps) FILTER (reward >= 1) AS s
      FROM episodes JOIN (VALUES {UNITS_SQL}) u(unit, kind) ON {ACCEPTS} GROUP BY 1, 2) GROUP BY unit)""", "episodes"))
def ag04(spark: S, d: str) -> DataFrame:
    per_era = b.episodes(spark, d).groupBy("grp", "era").agg(F.count("*").alias("k"), F.count_if(F.col("reward") >= 1).alias("v"), F.sum(F.when(F.col("reward") >= 1, F.col("n_steps"))).alias("s"))
    units = accepted(spark, per_era).groupBy("unit", "era").agg(*[F.sum(c).alias(c) for c in "kvs"])
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("era", "v"))), lambda x: F.concat_ws(":", x.era, x.v)), ",")
    out = units.groupBy("unit").agg(F.sum("k").alias("n"), F.sum("v").alias("verified"), F.sum("s").alias("steps"), named.alias("per_era"))
    return out.crossJoin(out.agg(F.min("steps").alias("matched_dose")))


@register("ag05_grouping_sets_census", sql("""
  SELECT era, grp, grouping(era)::BIGINT * 2 + grouping(grp)::BIGINT AS level, count(*) AS n, count(*) FILTER (reward >= 1) AS verified, round(avg((reward >= 1)::DOUBLE), 6) AS verify_rate
  FROM episodes GROUP BY GROUPING SETS ((era, grp), (era), ())""", "episodes"))
def ag05(spark: S, d: str) -> DataFrame:
    facts = b.episodes(spark, d).select("era", "grp", "reward")
    return facts.groupingSets([["era", "grp"], ["era"], []], "era", "grp").agg(
        F.grouping_id("era", "grp").alias("level"), F.count("*").alias("n"), F.count_if(F.col("reward") >= 1).alias("verified"), F.round(F.avg((F.col("reward") >= 1).cast("double")), 6).alias("verify_rate"))


@register("ag06_group_split_crosstab", sql("""
  SELECT grp, count(DISTINCT task_id) FILTER (split = 'train') AS train, count(DISTINCT task_id) FILTER (split = 'test') AS test, count(*) FILTER (split NOT IN ('train', 'test')) AS other, count(DISTINCT sites_key) AS subgroups
  FROM episodes GROUP BY grp""", "episodes"))
def ag06(spark: S, d: str) -> DataFrame:
    side = lambda s: F.count_distinct(F.when(F.col("split") == s, F.col("task_id")))
    return b.episodes(spark, d).groupBy("grp").agg(side("train").alias("train"), side("test").alias("test"), F.count_if(~F.col("split").isin("train", "test")).alias("other"), F.count_distinct("sites_key").alias("subgroups"))


@register("ag07_mean_sd_n", """
  SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(value) AS n FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1""")
def ag07(spark: S, d: str) -> DataFrame:
    finite = b.table(spark, d, "events").where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
    return finite.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd"), F.count("value").alias("n"))


@register("pf02_row_predicates", sql("""
  SELECT grp, count(*) FILTER (reward >= 1) AS verified, count(*) FILTER (last_action LIKE 'send_msg_to_user(%' OR last_action LIKE 'send_message_to_user(%') AS answered, count(*) FILTER (err) AS errored
  FROM (SELECT *, CASE WHEN n_steps = 0 THEN NULL WHEN terminated THEN 'send_msg_to_user(' || task_id || ')' ELSE 'click(' || n_steps || ')' END AS last_action FROM episodes) GROUP BY grp""", "episodes"))
def pf02(spark: S, d: str) -> DataFrame:
    action = F.when(F.col("terminated"), F.format_string("send_msg_to_user(%d)", "task_id")).otherwise(F.format_string("click(%d)", "n_steps"))
    actions = F.when(F.col("n_steps") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("click(1)"), action, F.lit("")))
    last = F.try_element_at(F.filter(actions, lambda a: a != ""), F.lit(-1))
    sends = F.startswith(last, F.lit("send_msg_to_user(")) | F.startswith(last, F.lit("send_message_to_user("))
    return b.episodes(spark, d).groupBy("grp").agg(F.count_if(F.col("reward") >= 1).alias("verified"), F.count_if(sends).alias("answered"), F.count_if("err").alias("errored"))


@register("pf03_rejection_funnel", sql("""
  SELECT grp, CASE WHEN reward < 1 THEN 'reward' WHEN err THEN 'err' WHEN NOT terminated THEN 'no-answer' ELSE 'kept' END AS reason, count(*) AS n, count(*) FILTER (reward >= 1) AS verified, round(avg(reward), 6) AS mean_reward
  FROM episodes GROUP BY 1, 2""", "episodes"))
def pf03(spark: S, d: str) -> DataFrame:
    reason = F.when(F.col("reward") < 1, "reward").when(F.col("err"), "err").when(~F.col("terminated"), "no-answer").otherwise("kept")
    return b.episodes(spark, d).groupBy("grp", reason.alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("reward") >= 1).alias("verified"), F.round(F.avg("reward"), 6).alias("mean_reward"))


CAPPED = f"""SELECT grp, episode_id, n_steps, cum FROM (
    SELECT grp, episode_id, n_steps, sum(n_steps) OVER (PARTITION BY grp ORDER BY {{order}} ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM episodes WHERE reward >= 1 AND terminated) WHERE cum <= {{cap}}"""


@register("win02_running_sum_prefix_cap", sql(CAPPED.format(order="era, task_id, seed, episode_id", cap=770), "episodes"))
def win02(spark: S, d: str) -> DataFrame:
    chosen = b.episodes(spark, d).where("reward >= 1 AND terminated")
    return prefix_within(chosen, ["grp"], F.col("era") * 1000 + F.col("task_id"), [F.col("seed"), F.col("episode_id")], "n_steps", 770).select("grp", "episode_id", "n_steps", "cum")


@register("pf04_select_unit_episodes", sql(CAPPED.format(order=f"{draw_sql('draw3', 'episode_id')}, episode_id", cap=385), "episodes"))
def pf04(spark: S, d: str) -> DataFrame:
    drawn = b.episodes(spark, d).where("reward >= 1 AND terminated").withColumn("u", draw("draw3", "episode_id"))
    return prefix_within(drawn, ["grp"], F.shiftright("u", 20), [F.col("u"), F.col("episode_id")], "n_steps", 385).select("grp", "episode_id", "n_steps", "cum")


@register("pf05_tasks_for_env", sql("""
  SELECT s.env, split, count(DISTINCT task_id) FILTER (len(sites) = 1) AS only_here, count(DISTINCT task_id) AS contains FROM episodes, (VALUES ('wiki'), ('news'), ('shop')) s(env) WHERE list_contains(sites, s.env) GROUP BY 1, 2""", "episodes"))
def pf05(spark: S, d: str) -> DataFrame:
    t = b.episodes(spark, d).select("task_id", "split", "sites", F.explode("sites").alias("env"))
    return t.groupBy("env", "split").agg(F.count_distinct(F.when(F.size("sites") == 1, F.col("task_id"))).alias("only_here"), F.count_distinct("task_id").alias("contains"))


@register("pf06_subset_with_absent_report", sql("""
  SELECT w.id AS task_id, count(e.episode_id) AS n, count(e.episode_id) = 0 AS absent, CASE WHEN count(e.episode_id) > 0 THEN row_number() OVER (PARTITION BY count(e.episode_id) = 0 ORDER BY w.id) <= 20 ELSE false END AS taken FROM (SELECT 7 * k AS id FROM range(1::BIGINT, 41::BIGINT) r(k)) w LEFT JOIN episodes e ON e.task_id = w.id GROUP BY 1""", "episodes"))
def pf06(spark: S, d: str) -> DataFrame:
    return subset(b.episodes(spark, d), "task_id", spark.range(1, 41).select((F.col("id") * 7).alias("task_id")), 20)


def subset(rows: DataFrame, key: str, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """``key, n, absent, taken`` of every wanted key: its rows, whether there are none, and whether it is among the ``limit`` first of those there (the limit is the caller's)."""
    counts = rows.join(F.broadcast(wanted), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))  # a list of ids that the caller named
    out = wanted.join(counts, key, "left").fillna(0, ["n"]).withColumn("absent", F.col("n") == 0)
    place = F.row_number().over(Window.partitionBy("absent").orderBy(key))
    return out.withColumn("taken", ~F.col("absent") & (place <= limit if limit is not None else F.lit(True)))


@register("pf07_train_candidates", sql("SELECT task_id, CASE WHEN grp = 'multi' THEN NULL ELSE grp END AS site, count(*) AS n FROM episodes WHERE split = 'train' GROUP BY 1, 2", "episodes"))
def pf07(spark: S, d: str) -> DataFrame:
    return b.episodes(spark, d).where("split = 'train'").groupBy("task_id", F.when(F.col("grp") != "multi", F.col("grp")).alias("site")).agg(F.count("*").alias("n"))


@register("pf08_arm_own_site", sql("SELECT arm, nullif(regexp_extract(arm, '^L_(wiki|news|shop|multi)$', 1), '') AS held_out, CASE arm WHEN 'L_wiki' THEN 'news+shop' WHEN 'L_news' THEN 'wiki+shop' WHEN 'L_shop' THEN 'wiki+news' WHEN 'L_multi' THEN 'wiki+news+shop' END AS seen, count(*) AS n FROM evals GROUP BY 1", "evals"))
def pf08(spark: S, d: str) -> DataFrame:
    held = F.nullif(F.regexp_extract("arm", r"^L_(wiki|news|shop|multi)$", 1), F.lit(""))
    all_ = F.array(*map(F.lit, b.SITES))
    counted = b.eval_records(spark, d).groupBy("arm").agg(F.count("*").alias("n")).withColumn("held_out", held)
    return counted.withColumn("seen", F.when(F.col("held_out").isNotNull(), F.array_join(F.array_remove(all_, F.col("held_out")), "+")))


@register("pf09_finite_only", "SELECT event_type, count(*) AS n_all, count(*) FILTER (x IS NOT NULL AND isfinite(x)) AS n_finite, round(avg(x) FILTER (x IS NOT NULL AND isfinite(x)), 6) AS mean FROM (SELECT event_type, CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE ELSE value END AS x FROM events) GROUP BY 1")
def pf09(spark: S, d: str) -> DataFrame:
    k = F.col("event_id") % 10
    x = F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("inf")).otherwise(F.col("value"))
    e = b.table(spark, d, "events").select("event_type", x.alias("x"))
    ok = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    return e.groupBy("event_type").agg(F.count("*").alias("n_all"), F.count_if(ok).alias("n_finite"), F.round(F.avg(F.when(ok, F.col("x"))), 6).alias("mean"))


FOLDS = {"forward": ([1, 2, 3], [4, 5]), "backward": ([4, 5], [1, 2, 3]), "interp": ([1, 2, 4, 5], [3]), "neutral_holdout": ([1, 2, 3, 4, 5], [6])}
FOLDS_SQL = ", ".join(f"('{f}', {e}, '{s}')" for f, sides in FOLDS.items() for s, eras in zip(("train", "test"), sides) for e in eras)


@register("pf11_era_fold_units", sql(f"SELECT fold, side, count(DISTINCT grp || era) AS n_units, count(*) AS n FROM episodes JOIN (VALUES {FOLDS_SQL}) f(fold, fera, side) ON fera = era WHERE grp <> 'multi' GROUP BY 1, 2", "episodes"))
def pf11(spark: S, d: str) -> DataFrame:
    folds = spark.createDataFrame([(f, e, s) for f, sides in FOLDS.items() for s, eras in zip(("train", "test"), sides) for e in eras], "fold string, era long, side string")
    facts = b.episodes(spark, d).where("grp <> 'multi'").groupBy("grp", "era").agg(F.count("*").alias("n"))
    return facts.join(F.broadcast(folds), "era").groupBy("fold", "side").agg(F.count("*").alias("n_units"), F.sum("n").alias("n"))


@register("pf12_worklist_reasons", sql("""
  SELECT task_id, CASE WHEN done > 0 THEN 'finished' WHEN made = 0 THEN 'no artefact' WHEN errs = made THEN 'ungated' ELSE 'run' END AS action FROM (
    SELECT t.task_id, count(e.episode_id) FILTER (reward >= 1 AND era = 6 AND seed = 0) AS done, count(e.episode_id) AS made, count(e.episode_id) FILTER (err) AS errs FROM tasks t LEFT JOIN episodes e USING (task_id) GROUP BY 1)""", "episodes"))
def pf12(spark: S, d: str) -> DataFrame:
    made = b.episodes(spark, d).groupBy("task_id").agg(F.count_if((F.col("reward") >= 1) & (F.col("era") == 6) & (F.col("seed") == 0)).alias("done"), F.count("*").alias("made"), F.count_if("err").alias("errs"))
    every = b.tasks(spark).select("task_id").join(made, "task_id", "left").fillna(0)
    return every.select("task_id", F.when(F.col("done") > 0, "finished").when(F.col("made") == 0, "no artefact").when(F.col("errs") == F.col("made"), "ungated").otherwise("run").alias("action"))


PAIRS = """pairs AS (SELECT a.task_id, a.seed, a.era, a.m AS ma, z.m AS mb FROM
  (SELECT task_id, seed, era, avg(reward) AS m FROM evals WHERE arm = 'L_wiki' GROUP BY ALL) a JOIN (SELECT task_id, seed, era, avg(reward) AS m FROM evals WHERE arm = 'M_all' GROUP BY ALL) z USING (task_id, seed, era))"""


def paired(spark: S, d: str, first: str = "L_wiki", second: str = "M_all") -> DataFrame:
    """Mean rewards of two arms on the keys that both ran."""
    means = b.eval_records(spark, d).where(F.col("arm").isin(first, second)).groupBy("task_id", "seed", "era").agg(
        F.avg(F.when(F.col("arm") == first, F.col("reward"))).alias("ma"), F.avg(F.when(F.col("arm") == second, F.col("reward"))).alias("mb"))
    return means.where("ma IS NOT NULL AND mb IS NOT NULL")


@register("jn03_paired_runs", sql("SELECT count(*) AS n_pairs, round(avg(ma - mb), 6) AS mean_diff, count(*) FILTER (ma <> mb) AS discordant FROM pairs", "evals", more={"pairs": PAIRS[len("pairs AS ("):-1]}))
def jn03(spark: S, d: str) -> DataFrame:
    return paired(spark, d).agg(F.count("*").alias("n_pairs"), F.round(F.avg(F.col("ma") - F.col("mb")), 6).alias("mean_diff"), F.count_if(F.col("ma") != F.col("mb")).alias("discordant"))


@register("win03_average_rank", "SELECT event_id, value, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rank FROM events")
def win03(spark: S, d: str) -> DataFrame:
    e = b.table(spark, d, "events").select("event_id", "event_type", "value")
    # Ranks of distinct values, from their counts; the table itself isn't sorted.
    counts = e.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    before = Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("event_type", "value", (F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2).alias("rank"))
    return e.join(ranks, ["event_type", "value"]).select("event_id", "value", "rank")


#: Rows of a range in which episodes are sorted together: 2 ** RANGE ids.
RANGE = 16


@register("win06_round_robin_batches", sql("SELECT episode_id, grp, chunk, row_number() OVER (ORDER BY chunk, grp, era, rn) AS place FROM (SELECT episode_id, grp, era, rn, ((rn - 1) // 8)::BIGINT AS chunk FROM (SELECT episode_id, grp, era, row_number() OVER (PARTITION BY grp, era ORDER BY episode_id) AS rn FROM episodes))", "episodes"))
def win06(spark: S, d: str) -> DataFrame:
    return round_robin(b.episodes(spark, d).select("episode_id", "grp", "era"), ["grp", "era"], "episode_id", 8)


def round_robin(rows: DataFrame, by: list[str], order: str, size: int, most: int | None = None) -> DataFrame:
    """Batches of ``size`` rows of one cell, emitted cell after cell, chunk after chunk, with the row's ``place`` in that order; at most ``most`` rows."""
    ranked = rank_within(rows, by, F.shiftright(order, RANGE), [order], "rn").withColumn("chunk", F.floor((F.col("rn") - 1) / size))
    out = rank_within(ranked, [], F.floor(F.col("chunk") / 512), ["chunk", *by, "rn"], "place")
    return (out if most is None else out.where(F.col("place") <= most)).select(order, by[0], "chunk", "place")


@register("win08_warmup_cosine_schedule", sql("SELECT episode_id, era, round(CASE WHEN k <= 20 THEN k / 20 ELSE 0.5 * (1 + cos(pi() * least(1.0, (k - 20)::DOUBLE / greatest(1, n - 20)))) END, 6) AS lr FROM (SELECT episode_id, era, row_number() OVER (PARTITION BY era ORDER BY episode_id) AS k, count(*) OVER (PARTITION BY era) AS n FROM episodes)", "episodes"))
def win08(spark: S, d: str) -> DataFrame:
    e = b.episodes(spark, d).select("episode_id", "era")
    steps = rank_within(e, ["era"], F.shiftright("episode_id", RANGE), ["episode_id"], "k").join(F.broadcast(e.groupBy("era").agg(F.count("*").alias("n"))), "era")
    down = 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), (F.col("k") - 20) / F.greatest(F.lit(1), F.col("n") - 20))))
    return steps.select("episode_id", "era", F.round(F.when(F.col("k") <= 20, F.col("k") / 20).otherwise(down), 6).alias("lr"))


@register("win09_round_robin_slots", sql("SELECT slot, count(*) AS n, sum(n_steps)::BIGINT AS steps FROM (SELECT n_steps, (row_number() OVER (ORDER BY task_id, episode_id) - 1) % 4 AS slot FROM episodes) GROUP BY slot", "episodes"))
def win09(spark: S, d: str) -> DataFrame:
    """Units in the order of tasks dealt to four slots in turn; a task's episodes are sorted together, whole tasks never are."""
    placed = rank_within(b.episodes(spark, d).select("task_id", "episode_id", "n_steps"), [], F.col("task_id"), ["episode_id"], "place")
    return placed.groupBy(((F.col("place") - 1) % 4).alias("slot")).agg(F.count("*").alias("n"), F.sum("n_steps").alias("steps"))


@register("sort01_canonical_units", sql("SELECT CASE grp WHEN 'wiki' THEN 1 WHEN 'news' THEN 2 WHEN 'shop' THEN 3 ELSE 4 END * 10 + era AS ord, grp || '_e' || era AS unit, count(*) AS n FROM episodes GROUP BY grp, era", "episodes"))
def sort01(spark: S, d: str) -> DataFrame:
    counted = b.episodes(spark, d).groupBy("grp", "era").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, b.GROUPS)), F.col("grp"))
    return counted.select((place * 10 + F.col("era")).alias("ord"), F.concat(F.col("grp"), F.lit("_e"), F.col("era").cast("string")).alias("unit"), "n")


PICK = "row_number() OVER (PARTITION BY grp ORDER BY {u}, task_id)".format(u=draw_sql("pick", "grp", "task_id"))


def picks(spark: S, d: str, k: int) -> DataFrame:
    """A seeded draw of k training tasks of each group; the first j of them are the draw of j."""
    pool = b.episodes(spark, d).where("split = 'train' AND NOT err").select("task_id", "grp").distinct()
    w = Window.partitionBy("grp")
    return pool.withColumn("rn", F.row_number().over(w.orderBy(draw("pick", "grp", "task_id"), "task_id"))).withColumn("pool", F.count("*").over(w)).where(F.col("rn") <= k)


@register("sort02_nested_task_draw", sql(f"SELECT grp, task_id, rn, pool FROM (SELECT grp, task_id, {PICK} AS rn, count(*) OVER (PARTITION BY grp) AS pool FROM (SELECT DISTINCT task_id, grp FROM episodes WHERE split = 'train' AND NOT err)) WHERE rn <= 4", "episodes"))
def sort02(spark: S, d: str) -> DataFrame:
    return picks(spark, d, 4).select("grp", "task_id", F.col("rn").cast("long").alias("rn"), "pool")


@register("sort03_subset_nesting", sql(f"SELECT grp, string_agg(task_id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 2) AS first2, string_agg(task_id::VARCHAR, ',' ORDER BY rn) AS first4, true AS nests FROM (SELECT grp, task_id, {PICK} AS rn FROM (SELECT DISTINCT task_id, grp FROM episodes WHERE split = 'train' AND NOT err)) WHERE rn <= 4 GROUP BY grp", "episodes"))
def sort03(spark: S, d: str) -> DataFrame:
    drawn = lambda k: picks(spark, d, k).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "task_id"))), lambda x: x.task_id.cast("string")).alias(f"a{k}"))
    both = drawn(4).join(drawn(2), "grp")
    return both.select("grp", F.array_join("a2", ",").alias("first2"), F.array_join("a4", ",").alias("first4"), (F.slice("a4", 1, 2) == F.col("a2")).alias("nests"))


@register("sort04_cycled_permutations", sql(f"""
  SELECT copy, episode_id FROM (SELECT copy, episode_id, row_number() OVER (ORDER BY copy, u, episode_id) AS rn FROM (
    SELECT c.copy, episode_id, {draw_sql('cycle', 'c.copy', 'episode_id')} AS u FROM (SELECT episode_id FROM episodes WHERE era = 6 AND grp = 'shop') p, range(0::BIGINT, 3::BIGINT) c(copy)))
  WHERE rn <= (SELECT 5 * count(*) // 2 FROM episodes WHERE era = 6 AND grp = 'shop')""", "episodes"))
def sort04(spark: S, d: str) -> DataFrame:
    pool = b.episodes(spark, d).where("era = 6 AND grp = 'shop'").select("episode_id")
    size = pool.count()
    whole, rest = divmod(5 * size // 2, max(size, 1))
    copies = pool.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(whole - 1, 0)).cast("long")))) if whole else pool.withColumn("copy", F.lit(0).cast("long")).limit(0)
    last = smallest(pool.withColumn("copy", F.lit(whole).cast("long")), draw("cycle", "copy", "episode_id"), ["episode_id"], rest) if rest else copies.limit(0)
    return copies.unionByName(last).select("copy", "episode_id")


@register("sort06_shuffled_epochs", sql(f"SELECT epoch, episode_id, row_number() OVER (PARTITION BY epoch, grp ORDER BY {draw_sql('epoch', 'epoch', 'episode_id')}, episode_id) AS pos FROM episodes, range(0::BIGINT, 2::BIGINT) e(epoch) WHERE n_steps >= 3", "episodes"))
def sort06(spark: S, d: str) -> DataFrame:
    e = b.episodes(spark, d).where("n_steps >= 3").select("grp", "episode_id").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    e = e.withColumn("u", draw("epoch", "epoch", "episode_id"))
    return rank_within(e, ["epoch", "grp"], F.shiftright("u", 24), ["u", "episode_id"], "pos").select("epoch", "episode_id", "pos")


@register("sort07_latest_checkpoint", """
  SELECT u.user_id, CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'final' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'checkpoint-' || max(event_id) FILTER (event_type = 'purchase') END AS artefact,
    CASE WHEN count(event_id) = 0 THEN 'missing' WHEN count(*) FILTER (event_type IN ('signup', 'purchase')) = 0 THEN 'invalid' ELSE 'found' END AS status
  FROM (SELECT DISTINCT c_custkey AS user_id FROM customer UNION SELECT user_id FROM events) u LEFT JOIN events e ON e.user_id = u.user_id GROUP BY 1""")
def sort07(spark: S, d: str) -> DataFrame:
    """Each wanted unit's final artefact, else its highest checkpoint; a unit with neither is invalid, one that left nothing missing."""
    e = b.table(spark, d, "events")
    found = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("final"), F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("step"))
    wanted = b.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).union(e.select("user_id")).distinct()
    artefact = F.when(F.col("final") > 0, "final").otherwise(F.concat(F.lit("checkpoint-"), F.col("step").cast("string")))
    return wanted.join(found, "user_id", "left").select("user_id", artefact.alias("artefact"), F.when(F.col("final").isNull(), "missing").when((F.col("final") == 0) & F.col("step").isNull(), "invalid").otherwise("found").alias("status"))


@register("set01_canonical_site_key", sql("SELECT sites_key, count(*) AS n FROM episodes GROUP BY 1", "episodes"))
def set01(spark: S, d: str) -> DataFrame:
    backwards = b.episodes(spark, d).select(F.transform(F.reverse("sites"), lambda x: F.concat(F.lit(" "), F.upper(x))).alias("sites"))
    return backwards.groupBy(site_key("sites").alias("sites_key")).agg(F.count("*").alias("n"))


def site_key(sites: str):
    """The sites in their fixed order, whatever theirs, case and blanks; an unknown site, or none at all, is an error."""
    tidy = F.transform(sites, lambda x: F.lower(F.trim(x)))
    known = F.array(*map(F.lit, b.SITES))
    bad = F.coalesce((F.size(tidy) < 1) | (F.size(F.array_except(tidy, known)) > 0), F.lit(True))
    return F.when(bad, F.raise_error(F.concat(F.lit("no such sites: "), F.coalesce(F.array_join(tidy, "+"), F.lit(""))))).otherwise(F.array_join(F.array_intersect(known, tidy), "+"))


@register("fn01_nominal_year", sql("SELECT era, round(avg(year), 6) AS mean_year, CASE WHEN count(year) = count(*) THEN max(year) - min(year) END AS spread, count(*) AS n FROM (SELECT era, CASE WHEN era < 6 THEN 1996.0 + era * 4 + CASE grp WHEN 'wiki' THEN 0.0 WHEN 'news' THEN 0.5 ELSE 1.5 END END::DOUBLE AS year FROM episodes WHERE grp <> 'multi') GROUP BY era", "episodes"))
def fn01(spark: S, d: str) -> DataFrame:
    offset = F.when(F.col("grp") == "wiki", 0.0).when(F.col("grp") == "news", 0.5).otherwise(1.5)
    e = b.episodes(spark, d).where("grp <> 'multi'").select("era", F.when(F.col("era") < 6, F.lit(1996.0) + F.col("era") * 4 + offset).alias("year"))
    whole = F.count("year") == F.count("*")
    return e.groupBy("era").agg(F.round(F.avg("year"), 6).alias("mean_year"), F.when(whole, F.max("year") - F.min("year")).alias("spread"), F.count("*").alias("n"))


@register("fn21_optimizer_steps", sql("SELECT grp, sum(n_steps)::BIGINT AS samples, ceil(sum(n_steps) * 3 / 16)::BIGINT AS optim_steps, round(ceil(sum(n_steps) * 3 / 16) * 25 / 3600, 6) AS gpu_hours FROM episodes WHERE reward >= 1 GROUP BY 1", "episodes"))
def fn21(spark: S, d: str) -> DataFrame:
    s = b.episodes(spark, d).where("reward >= 1").groupBy("grp").agg(F.sum("n_steps").alias("samples"))
    steps = F.ceil(F.col("samples") * 3 / 16)
    return s.select("grp", "samples", steps.alias("optim_steps"), F.round(steps * 25 / 3600, 6).alias("gpu_hours"))


#: Fixed values of the plan: batch, seconds of a step, epochs, arms' grid of evaluation, and seconds of an episode.
BATCH, STEP_S, EPOCHS, GRID, EPISODE_S = 16, 25, 3, 18, 120


@register("snk05_cost_table", sql(f"SELECT arm, grp, sum(n_steps)::BIGINT AS samples, ceil(sum(n_steps) * {EPOCHS} / {BATCH})::BIGINT AS steps, round(ceil(sum(n_steps) * {EPOCHS} / {BATCH}) * {STEP_S} / 3600, 6) AS gpu_hours, r AS repeats, {GRID * GRID} * 20 * r AS sweep_episodes, round({GRID * GRID} * 20 * r * {EPISODE_S} / 3600, 6) AS sweep_hours FROM evals, (VALUES (1), (3), (5)) v(r) GROUP BY r, ROLLUP (arm, grp)", "evals"))
def snk05(spark: S, d: str) -> DataFrame:
    """Training cost of each arm and group with totals, and the cost of the sweep over the grid at one, three and five repeats."""
    cost = b.eval_records(spark, d).rollup("arm", "grp").agg(F.sum("n_steps").alias("samples")).withColumn("steps", F.ceil(F.col("samples") * EPOCHS / BATCH))
    cost = cost.withColumn("gpu_hours", F.round(F.col("steps") * STEP_S / 3600, 6)).withColumn("repeats", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    episodes = GRID * GRID * 20 * F.col("repeats")
    return cost.withColumn("sweep_episodes", episodes).withColumn("sweep_hours", F.round(episodes * EPISODE_S / 3600, 6))


@register("ag14_scout_cost", sql("SELECT t.task_id, count(e.episode_id) AS k, count(e.episode_id) FILTER (terminated) AS terminated, count(e.episode_id) FILTER (reward >= 1) AS solved, coalesce(sum(n_steps), 0)::BIGINT AS steps FROM tasks t LEFT JOIN episodes e USING (task_id) GROUP BY 1", "episodes"))
def ag14(spark: S, d: str) -> DataFrame:
    e = b.episodes(spark, d).groupBy("task_id").agg(F.count("*").alias("k"), F.count_if("terminated").alias("terminated"), F.count_if(F.col("reward") >= 1).alias("solved"), F.sum("n_steps").alias("steps"))
    return b.tasks(spark).select("task_id").join(e, "task_id", "left").fillna(0)


@register("ag22_two_level_report", sql("SELECT arm, count(*) AS n_cells, round(avg(m), 6) AS mean_over_cells FROM (SELECT arm, grp, era, avg((reward >= 1)::DOUBLE) AS m FROM evals GROUP BY ALL) GROUP BY arm", "evals"))
def ag22(spark: S, d: str) -> DataFrame:
    per = b.eval_records(spark, d).groupBy("arm", "grp", "era").agg(F.avg((F.col("reward") >= 1).cast("double")).alias("m"))
    return per.groupBy("arm").agg(F.count("*").alias("n_cells"), F.round(F.avg("m"), 6).alias("mean_over_cells"))


@register("st03_arrival_order", sql("SELECT era, row_number() OVER (ORDER BY era)::BIGINT AS arrival, count(*) AS n, (sum(count(*)) OVER (ORDER BY era))::BIGINT AS seen FROM episodes GROUP BY era", "episodes"))
def st03(spark: S, d: str) -> DataFrame:
    per = b.episodes(spark, d).groupBy("era").agg(F.count("*").alias("n"))
    w = Window.orderBy("era")  # six rows
    return per.select("era", F.row_number().over(w).cast("long").alias("arrival"), "n", F.sum("n").over(w).alias("seen"))
