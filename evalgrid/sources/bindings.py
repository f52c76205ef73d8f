"""The entities of an experiment, derived from the shared tables.

Episodes come from orders, steps from line items, arms from market segments, cells of the
transfer matrix from nations. Every derivation is deterministic and stays in DataFrame
operations, so filters and column choices reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SITES = ("wiki", "news", "shop")
GROUPS = (*SITES, "multi")
ERAS = 6
N_TASKS, N_TEST = 231, 103
#: Arms by market segment; each but the last is named by what it has never seen.
ARMS = {"AUTOMOBILE": "L_wiki", "BUILDING": "L_news", "FURNITURE": "L_shop", "HOUSEHOLD": "L_multi", "MACHINERY": "M_all"}
REFERENCE_ARM = "M_all"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_sites(task_id: Column) -> Column:
    """Sites of a task, in canonical order, from the bits of task_id mod 7 + 1."""
    mask = task_id % 7 + 1
    return F.filter(
        F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(s)) for i, s in enumerate(SITES)]), lambda s: s.isNotNull()
    )


def task_group(sites: Column) -> Column:
    return F.when(F.size(sites) == 1, sites[0]).otherwise("multi")


def with_task(df: DataFrame) -> DataFrame:
    """Adds ``sites``, ``sites_key``, ``grp`` and ``split`` of the task, without a join."""
    sites = task_sites(F.col("task_id"))
    return (
        df.withColumn("sites", sites)
        .withColumn("sites_key", F.array_join("sites", "+"))
        .withColumn("grp", task_group(F.col("sites")))
        .withColumn("split", F.when(F.col("task_id") <= N_TEST, "test").otherwise("train"))
    )


def tasks(spark: SparkSession) -> DataFrame:
    """The dimension of tasks: a row for each of the ``N_TASKS``."""
    return with_task(spark.range(1, N_TASKS + 1).withColumnRenamed("id", "task_id"))


def arms(spark: SparkSession) -> DataFrame:
    """The dimension of arms: name, what it holds out, and the sites that it saw."""
    rows = [(a, None if a == REFERENCE_ARM else a[2:], [s for s in SITES if s != a[2:]]) for a in ARMS.values()]
    return spark.createDataFrame(rows, "arm string, held_out string, seen array<string>")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes: ``episode_id, era, task_id, seed, reward, n_steps, terminated, err, cust`` and the task's columns."""
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_steps"))
    found = table(spark, sf_dir, "orders").join(steps, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return with_task(
        found.select(
            F.col("o_orderkey").alias("episode_id"),
            (F.year("o_orderdate") % ERAS + 1).cast("long").alias("era"),
            (F.col("o_orderkey") % N_TASKS + 1).alias("task_id"),
            (F.col("o_custkey") % 3).alias("seed"),
            (F.col("o_orderstatus") == "F").cast("double").alias("reward"),
            F.coalesce("n_steps", F.lit(0)).cast("long").alias("n_steps"),
            (F.col("o_orderpriority") < "3").alias("terminated"),
            (F.col("o_orderpriority") == "5-LOW").alias("err"),
            F.col("o_custkey").alias("cust"),
        )
    )


def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with the ``arm`` that ran them and the ``repeat`` among those of one (arm, era, seed, task)."""
    segment = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    name = F.coalesce(*[F.when(F.col("c_mktsegment") == s, a) for s, a in ARMS.items()])
    runs = episodes(spark, sf_dir).join(segment, F.col("cust") == F.col("c_custkey")).withColumn("arm", name).drop("c_custkey", "c_mktsegment", "cust")
    order = Window.partitionBy("arm", "era", "seed", "task_id").orderBy("episode_id")
    return runs.withColumn("repeat", (F.row_number().over(order) - 1).cast("long"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the transfer grid: ``cell, env, era, year``; the last era is neutral and has no year."""
    n = F.col("n_nationkey").cast("long")
    era = F.floor(n / 5)
    return table(spark, sf_dir, "nation").select(
        n.alias("cell"), F.col("n_regionkey").cast("long").alias("env"), era.alias("era"),
        F.when(era < 4, F.lit(1996.0) + era * 5 + F.col("n_regionkey") * 0.5).alias("year"),
    )


def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfer matrix in long form: every pair (src, dst), value null where nothing ran, and both cells' columns.

    The dimension side of each join is small, and the fact side is summed up to the pairs before the grid is joined.
    """
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("src"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dst"))
    ran = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("src", "dst")
        .agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("value"), F.count("*").alias("n"))
    )
    c = cells(spark, sf_dir)
    a = c.select(*[F.col(x).alias(f"src{'_' + x if x != 'cell' else ''}") for x in c.columns])
    b = c.select(*[F.col(x).alias(f"dst{'_' + x if x != 'cell' else ''}") for x in c.columns])
    return a.crossJoin(b).join(ran, ["src", "dst"], "left")
