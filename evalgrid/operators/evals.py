"""Evaluation records: deduplication, aggregates, drift and pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[Column], attempts: str | None = None) -> DataFrame:
    """The last row of each key in the given (total) order, with the number of distinct ``attempts`` of the key as ``n_attempts``."""
    w = Window.partitionBy(*key)
    ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(*[c.desc() for c in order])))
    if attempts:
        ranked = ranked.withColumn("n_attempts", F.size(F.collect_set(attempts).over(w)).cast("long"))
    return ranked.where("__rn = 1").drop("__rn")


def summaries(threshold: float = 1.0) -> list[Column]:
    """The aggregate columns of a set of records; a single record has a standard error of 0, and nothing answered a null."""
    solved, answered = F.col("reward") >= threshold, F.col("terminated")
    n = F.count("*")
    return [
        n.alias("n"),
        F.round(F.avg("reward"), 6).alias("avg_reward"),
        F.when(n > 0, F.round(F.coalesce(F.stddev_samp("reward") / F.sqrt(n), F.lit(0.0)), 6)).alias("std_err"),
        F.count_if(solved).alias("solved"),
        F.round(F.avg(solved.cast("double")), 6).alias("success_rate"),
        F.round(F.avg("n_steps"), 6).alias("avg_steps"),
        F.count_if("err").alias("n_err"),
        F.count_if(answered).alias("answered"),
        F.round(F.avg(answered.cast("double")), 6).alias("answer_rate"),
        F.round(F.avg(F.when(answered, solved.cast("double"))), 6).alias("conditional_success"),
    ]


def aggregate(records: DataFrame, by: list[str], threshold: float = 1.0) -> DataFrame:
    return records.groupBy(*by).agg(*summaries(threshold))


#: The SQL of ``summaries``.
SUMMARIES = """count(*) AS n, round(avg(reward), 6) AS avg_reward, round(coalesce(stddev_samp(reward) / sqrt(count(*)), 0), 6) AS std_err,
  count(*) FILTER (reward >= 1) AS solved, round(avg((reward >= 1)::DOUBLE), 6) AS success_rate, round(avg(n_steps), 6) AS avg_steps,
  count(*) FILTER (err) AS n_err, count(*) FILTER (terminated) AS answered, round(avg(terminated::DOUBLE), 6) AS answer_rate,
  round(avg((reward >= 1)::DOUBLE) FILTER (terminated), 6) AS conditional_success"""


def binomial(n: Column, solved: Column) -> Column:
    """The standard error of a success rate; null without records."""
    p = solved / F.nullif(n, F.lit(0))
    return F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)))
