"""Queries of readers and sinks: given rows are written to the shared folder as the files that an evaluation leaves, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.operators import sinks
from evalgrid.plans import register
from evalgrid.plans.ctes import sql
from evalgrid.sources import bindings as b
from evalgrid.sources import files

S = SparkSession
#: Arms of the design without results: one that has only a summary, and one that never ran.
IDLE = {"Z_idle": "empty", "Z_never": "missing"}


def trials(spark: S, d: str) -> DataFrame:
    """Evaluation records as rows of trial tables: repeats of a task are retries, the first three in tables of their own."""
    e = b.eval_records(spark, d)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("episode_id")), "yyyy-MM-dd_HH-mm-ss")
    folder = F.concat(F.lit("/runs/"), stamp, F.format_string("_agent-e%d_on_run.%d_%d/", "era", "task_id", "seed"))
    return e.select(
        "arm", (F.least(F.col("repeat"), F.lit(2)) + 1).cast("int").alias("trial"), folder.alias("exp_dir"), F.format_string("run.%d", "task_id").alias("env.task_name"), F.col("seed").cast("double").alias("env.task_seed"),
        F.col("reward").alias("cum_reward"), F.col("reward").alias("cum_raw_reward"), F.col("n_steps").cast("double").alias("n_steps"), F.when(F.col("err"), "boom: timeout").alias("err_msg"),
        F.when(F.col("terminated"), "True").otherwise("False").alias("terminated"), F.lit("0").alias("truncated"))


def write_trials(spark: S, d: str) -> str:
    """Writes them below a new folder, with each arm's summary; returns the folder."""
    root = files.work_dir(spark, "trials")
    rows = trials(spark, d).withColumn("table", F.format_string("result_df_trial_%d_of_3.csv", "trial")).drop("trial")
    rows.write.option("header", "true").partitionBy("arm", "table").csv(root)
    summary = b.eval_records(spark, d).groupBy("arm").agg(F.round(F.avg("reward"), 6).alias("avg_reward"), F.count("*").alias("n"), F.count_if("err").alias("n_err"))
    idle = spark.createDataFrame([(a, None, 0, 0) for a, s in IDLE.items() if s == "empty"], "arm string, avg_reward double, n long, n_err long")
    out = summary.unionByName(idle).select("arm", F.lit("summary_df.csv").alias("table"), "avg_reward", F.lit(0.0).alias("std_err"), F.concat_ws("/", "n", "n").alias("n_completed"), "n_err")
    out.coalesce(1).write.mode("append").option("header", "true").partitionBy("arm", "table").csv(root)
    return root


@register("src03_discover_trials", sql("SELECT arm, trial, 3 AS of, row_number() OVER (PARTITION BY arm ORDER BY trial)::INTEGER AS place FROM (SELECT DISTINCT arm, (least(repeat, 2) + 1)::INTEGER AS trial FROM evals)", "evals"))
def src03(spark: S, d: str) -> DataFrame:
    """The trial tables of every study, found by name at any depth, once each, in the order in which they were run."""
    from pyspark.sql import Window

    found = files.trial_files(spark, write_trials(spark, d))
    arm = F.regexp_extract("study_dir", r"arm=([^/]*)", 1)
    return found.select(arm.alias("arm"), "trial", "of", F.row_number().over(Window.partitionBy(arm).orderBy("trial")).alias("place"))


LAST = """SELECT arm, era, task_id, seed, arg_max(reward, episode_id) AS reward, arg_max(n_steps, episode_id) AS n_steps, arg_max(err, episode_id) AS err, arg_max(terminated, episode_id) AS terminated, count(*) AS n_attempts FROM evals GROUP BY arm, era, task_id, seed"""


@register("src04_read_results", sql(f"""
  SELECT arm, status, coalesce(n, 0) AS n, coalesce(n_rows, 0)::BIGINT AS n_rows, coalesce(n_retried, 0) AS n_retried, avg_reward, coalesce(solved, 0) AS solved, avg_steps, coalesce(n_err, 0) AS n_err, coalesce(answered, 0) AS answered, summary_reward, summary_errors
  FROM (SELECT arm, 'ok' AS status FROM arms UNION ALL VALUES ('Z_idle', 'empty'), ('Z_never', 'missing')) LEFT JOIN (
    SELECT arm, count(*) AS n, sum(n_attempts) AS n_rows, count(*) FILTER (n_attempts > 1) AS n_retried, round(avg(reward), 6) AS avg_reward, count(*) FILTER (reward >= 1) AS solved, round(avg(n_steps), 6) AS avg_steps, count(*) FILTER (err) AS n_err, count(*) FILTER (terminated) AS answered FROM ({LAST}) GROUP BY arm) USING (arm)
  LEFT JOIN (SELECT arm, round(avg(reward), 6) AS summary_reward, count(*) FILTER (err) AS summary_errors FROM evals GROUP BY arm UNION ALL SELECT 'Z_idle', 0, 0) USING (arm)""", "evals", "arms"))
def src04(spark: S, d: str) -> DataFrame:
    """Each arm's results from its trial tables, beside the harness's own summary; an arm without tables is empty, one without a folder missing."""
    root = write_trials(spark, d)
    arm = F.regexp_extract("study_dir", r"arm=([^/]*)", 1)
    found = files.read_trials(spark, root).groupBy(arm.alias("arm")).agg(
        F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"), F.count_if(F.col("n_attempts") > 1).alias("n_retried"), F.round(F.avg("reward"), 6).alias("avg_reward"),
        F.count_if(F.col("reward") >= 1).alias("solved"), F.round(F.avg("n_steps"), 6).alias("avg_steps"), F.count_if("err").alias("n_err"), F.count_if("terminated").alias("answered"))
    summary = files.read_summaries(spark, root).select(arm.alias("arm"), F.col("avg_reward").alias("summary_reward"), F.col("n_err").alias("summary_errors"))
    there = files.listed(spark, root).select(F.regexp_extract("path", r"arm=([^/]*)", 1).alias("arm"), F.lit(True).alias("there")).distinct()
    arms = b.arms(spark).select("arm").unionByName(spark.createDataFrame([(a,) for a in IDLE], "arm string"))
    out = arms.join(found, "arm", "left").join(summary, "arm", "left").join(there, "arm", "left")
    status = F.when(F.col("n") > 0, "ok").when(F.col("there"), "empty").otherwise("missing")
    return out.withColumn("status", status).drop("there").fillna(0, ["n", "n_rows", "n_retried", "solved", "n_err", "answered"])


@register("src05_json_reader", "SELECT shape, event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events, (VALUES ('array'), ('lines'), ('tasks')) s(shape) GROUP BY ALL")
def src05(spark: S, d: str) -> DataFrame:
    """Events written as a JSON array, an object with tasks, and records a line with blank lines between, read by one reader; a missing file adds nothing."""
    root = files.work_dir(spark, "json")
    e = b.table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    whole = e.select(F.to_json(F.struct("event_type", "k")).alias("r"), F.pmod(F.xxhash64("event_id"), F.lit(64)).alias("part")).groupBy("part").agg(F.collect_list("r").alias("r"))  # files of a bounded share each
    body = F.array_join("r", ",")
    shapes = {"array": F.concat(F.lit("["), body, F.lit("]")), "tasks": F.concat(F.lit('{"tasks": ['), body, F.lit("]}")), "lines": F.concat(F.array_join("r", "\n\n"), F.lit("\n"))}
    out = None
    for name, text in shapes.items():
        whole.select(text.alias("value"), "part").repartition("part").write.partitionBy("part").text(f"{root}/{name}")
        found = files.read_json_records(spark, f"{root}/{name}", "event_type string, k long").withColumn("shape", F.lit(name))
        out = found if out is None else out.unionByName(found)
    nothing = files.read_json_records(spark, f"{root}/missing", "event_type string, k long").withColumn("shape", F.lit("missing"))
    return out.unionByName(nothing).groupBy("shape", "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@register("src06_split_csv", sql("SELECT task_id, arg_max(split, episode_id) AS split, arg_max('a,' || sites_key || ',' || era, episode_id) AS sites FROM episodes GROUP BY 1", "episodes"))
def src06(spark: S, d: str) -> DataFrame:
    """A split table with quoted commas, where a task stands in a row for each of its episodes; the last one wins."""
    root = files.work_dir(spark, "split")
    e = b.episodes(spark, d).select(
        "episode_id", F.when(F.col("episode_id") % 2 == 0, F.format_string("bench.run.%d", "task_id")).otherwise("bench.other").alias("task_name"), "task_id",
        F.concat_ws(",", F.lit("a"), "sites_key", "era").alias("sites"), F.col("split").alias("browsergym_split"))
    e.repartitionByRange(4, "episode_id").sortWithinPartitions("episode_id").drop("episode_id").write.option("header", "true").csv(root)
    return files.read_split(spark, root)


@register("src07_load_chat_corpus", "SELECT conv_id % 6 AS cell, conv_id, human, gpt FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS human, arg_min(text, turn) FILTER (role = 'assistant') AS gpt FROM conversations GROUP BY 1) WHERE human IS NOT NULL AND gpt IS NOT NULL")
def src07(spark: S, d: str) -> DataFrame:
    return load_corpus(b.table(spark, d, "conversations").withColumn("cell", F.col("conv_id") % 6), list(range(6)))


def load_corpus(turns: DataFrame, cells: list, most: int | None = None) -> DataFrame:
    """``cell, conv_id, human, gpt``: the first turn of each side of every conversation that has both, at most ``most`` a cell; cells without any are warned about."""
    import warnings

    from pyspark.sql import Window

    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    whole = turns.groupBy("cell", "conv_id").agg(first("user").alias("human"), first("assistant").alias("gpt")).where("human IS NOT NULL AND gpt IS NOT NULL")
    if most is not None:
        whole = whole.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy("conv_id"))).where(F.col("rn") <= most).drop("rn")
    there = {r["cell"] for r in whole.select("cell").distinct().collect()}  # a row a cell
    if gone := sorted(set(cells) - there):
        warnings.warn(f"no conversation in cells {gone}", stacklevel=2)
    return whole.where(F.col("cell").isin(cells))


TENSORS = """SELECT vec_id, 'base_model.model.layers.' || label || '.mlp.lora_A.weight' AS name, [x::DOUBLE FOR x IN embedding[1:32]] AS v FROM embeddings
  UNION ALL SELECT vec_id, 'layers.' || label || '.mlp.lora_B.weight', [x::DOUBLE FOR x IN embedding[33:64]] FROM embeddings WHERE embedding[33] > 0"""


def tensors(spark: S, d: str) -> DataFrame:
    """Embeddings as adapter files: factor A from the first half, B from the second, which is missing where it begins below 0; their names have different prefixes."""
    e = b.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    a = e.select("vec_id", F.format_string("base_model.model.layers.%d.mlp.lora_A.weight", "label").alias("name"), F.slice("v", 1, 32).alias("v"))
    z = e.where(F.get("v", 32) > 0).select("vec_id", F.format_string("layers.%d.mlp.lora_B.weight", "label").alias("name"), F.slice("v", 33, 32).alias("v"))
    return a.unionByName(z)


def read_adapter(files_: DataFrame, key: str = "vec_id") -> DataFrame:
    """``key, site, a, b``: the pairs of factors of each site, known by its path from ``layers.`` on; only whole pairs."""
    part = lambda i: F.regexp_extract("name", r"(layers\..*)\.lora_([AB])\.weight$", i)
    side = lambda s: F.first(F.when(F.col("side") == s, F.col("v")), ignorenulls=True)
    named = files_.select(key, part(1).alias("site"), part(2).alias("side"), "v").where("site <> ''")
    return named.groupBy(key, "site").agg(side("A").alias("a"), side("B").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


@register("src08_adapter_pairs", f"SELECT vec_id, site, round(list_sum(a), 6) AS a, round(list_sum(b), 6) AS b FROM (SELECT vec_id, regexp_extract(name, '(layers.*).lora', 1) AS site, any_value(v) FILTER (name LIKE '%lora_A%') AS a, any_value(v) FILTER (name LIKE '%lora_B%') AS b FROM ({TENSORS}) GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL")
def src08(spark: S, d: str) -> DataFrame:
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6).alias(c)
    return read_adapter(tensors(spark, d)).select("vec_id", "site", total("a"), total("b"))


#: Shape of the factors.
RANK, D_IN, D_OUT = 4, 8, 8


@register("snk07_shape_validation", f"""SELECT site, count(*) AS n, '{{"r":{RANK},"lora_alpha":{2 * RANK},"target_modules":["mlp"],"peft_type":"LORA"}}' AS config FROM (SELECT vec_id, regexp_extract(name, '(layers.*).lora', 1) AS site, count(*) AS k FROM ({TENSORS}) GROUP BY 1, 2) WHERE k = 2 GROUP BY site""")
def snk07(spark: S, d: str) -> DataFrame:
    """Factors of the right shape, written as adapters with a configuration beside them, and read again."""
    pairs = sinks.check_shapes(read_adapter(tensors(spark, d)), RANK, D_IN, D_OUT)
    root = files.work_dir(spark, "adapters")
    pairs.write.parquet(f"{root}/factors")
    config = F.to_json(F.struct(F.lit(RANK).alias("r"), F.lit(2 * RANK).alias("lora_alpha"), F.array(F.lit("mlp")).alias("target_modules"), F.lit("LORA").alias("peft_type")))
    pairs.select("site").distinct().withColumn("config", config).write.parquet(f"{root}/config")
    made = spark.read.parquet(f"{root}/factors").groupBy("site").agg(F.count("*").alias("n"))
    return made.join(spark.read.parquet(f"{root}/config"), "site")


@register("snk08_scale_preservation", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice * p_size / 8), 6) AS alpha, count(*) FILTER (abs((round(p_retailprice * p_size / 8, 3) / p_size) / (p_retailprice / 8) - 1) > 1e-6) AS off FROM part GROUP BY 1")
def snk08(spark: S, d: str) -> DataFrame:
    """The alpha that keeps each part's scale at its own rank, served with three decimals; ``off`` counts those that rounding moves too far, which ``require_preserved`` refuses."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    alpha, ratio = sinks.preserved_scale(price, F.lit(8), size, F.round(price * size / 8, 3))
    return b.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg(alpha), 6).alias("alpha"), F.count_if(F.abs(ratio - 1) > 1e-6).alias("off"))


@register("snk01_append_projected", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, 0::BIGINT AS notes, CASE WHEN event_type = 'view' THEN '' ELSE 'props,ts,user_id' END AS dropped FROM events GROUP BY 1")
def snk01(spark: S, d: str) -> DataFrame:
    """Findings appended twice to a table under its first header; the columns that fell away are told."""
    path, header = f"{files.work_dir(spark, 'findings')}/rows", ["event_id", "event_type", "value", "note"]
    e = b.table(spark, d, "events")
    first = sinks.append_rows(e.where("event_type = 'view'").select("event_id", "event_type", "value"), path, header)
    second = sinks.append_rows(e.where("event_type <> 'view'"), path, header)
    told = F.when(F.col("event_type") == "view", F.lit(",".join(sorted(first)))).otherwise(F.lit(",".join(sorted(second))))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.count("note").alias("notes")).withColumn("dropped", told)


@register("snk02_matrix_round_trip", sql("SELECT src, dst, round(value, 6) AS value, (SELECT count(value) FROM matrix) AS filled, (SELECT count(*) FROM matrix) AS total FROM matrix", "matrix"))
def snk02(spark: S, d: str) -> DataFrame:
    """The matrix saved twice in one place, the second time whole, with NaN for what never ran; read again as it was."""
    path, schema = f"{files.work_dir(spark, 'matrix')}/saved", "src long, dst long, value double"
    m = b.transfer(spark, d).select("src", "dst", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    sinks.save(m.where("src = dst"), path)
    sinks.save(m, path)
    saved = sinks.load(spark, path, schema)
    return saved.crossJoin(saved.agg(F.count("value").alias("filled"), F.count("*").alias("total"))).select("src", "dst", F.round("value", 6).alias("value"), "filled", "total")


@register("snk03_corpus_side_car", """SELECT 'c' || conv_id % 6 AS cell, count(DISTINCT conv_id) AS n_episodes, count(*) FILTER (role = 'assistant') AS n_expected, count(*) FILTER (role = 'assistant' AND before = 'user') AS n_samples, count(*) FILTER (role = 'assistant' AND before = 'user') = 0 AS skipped,
    CASE WHEN count(*) FILTER (role = 'assistant' AND before = 'user') > 0 THEN 'cell=c' || conv_id % 6 END AS folder FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id % 6""")
def snk03(spark: S, d: str) -> DataFrame:
    """A chat corpus with a folder a cell, and its side-car: an answer is expected for every assistant's turn, and emitted where the user spoke before."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = b.table(spark, d, "conversations").withColumn("cell", F.concat(F.lit("c"), (F.col("conv_id") % 6).cast("string")))
    c = c.withColumn("before", F.lag(F.struct("role", "text")).over(w))
    expected = c.groupBy("cell").agg(F.count_distinct("conv_id").alias("n_episodes"), F.count_if(F.col("role") == "assistant").alias("n_expected"))
    say = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    samples = c.where("role = 'assistant' AND before.role = 'user'").select("cell", F.array(say("human", F.col("before.text")), say("gpt", F.col("text"))).alias("conversations"))
    return sinks.build_corpus(samples, expected, files.work_dir(spark, "corpus"))


@register("st01_incremental_fill", sql("SELECT src, dst, round(value, 6) AS value, CASE WHEN n >= 30 THEN 1 ELSE 2 END AS run FROM matrix", "matrix"))
def st01(spark: S, d: str) -> DataFrame:
    """A matrix filled in two runs: the first one did the pairs with thirty episodes or more, the second one what was left, saving after each of three parts."""
    path = f"{files.work_dir(spark, 'fill')}/matrix"
    m = b.transfer(spark, d).select("src", "dst", "value", "n")
    done = lambda run: lambda todo: todo.select("src", "dst", "value", F.lit(run).alias("run"))
    sinks.fill(m.where("n >= 30"), path, ["src", "dst"], done(1))
    return sinks.fill(m, path, ["src", "dst"], done(2), pieces=3).select("src", "dst", F.round("value", 6).alias("value"), "run")


@register("st02_content_memo", "SELECT source, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, sum(length(text))::BIGINT AS characters FROM (SELECT source, text, sha1(text) IN (SELECT sha1(text) FROM documents WHERE lang = 'en') AS hit FROM documents) GROUP BY 1")
def st02(spark: S, d: str) -> DataFrame:
    """Lengths of texts answered from a cache by content: English documents fill it first, then all documents use it."""
    path = f"{files.work_dir(spark, 'memo')}/cache"
    docs = b.table(spark, d, "documents").select("source", "lang", "text")
    length = lambda new: new.select("key", F.length("content").cast("long").alias("n"))
    sinks.memoised(docs.where("lang = 'en'"), path, F.col("text"), length)
    hits, cache = sinks.memoised(docs.select("source", "text"), path, F.col("text"), length)
    # What the second run computed is in the cache by now, so hits are those that the first run had.
    return hits.join(cache, "key").groupBy("source").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum("n").alias("characters"))
