"""Prefixes and draws of an order, without sorting a whole table in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_within(df: DataFrame, by: list[str], coarse: Column, fine: list[Column], amount: str, cap: int) -> DataFrame:
    """Rows in the order (coarse, fine) until the running sum of ``amount`` >= 0 would exceed ``cap``, with that sum as ``cum``.

    Sums by the coarse key tell where each key begins; keys that begin beyond the cap fall
    away before anything is sorted, and the running sum is taken within each key.
    """
    keyed = df.withColumn("__coarse", coarse)
    sums = keyed.groupBy(*by, "__coarse").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).where(F.col("__base") <= cap).drop("__sum")
    within = Window.partitionBy(*by, "__coarse").orderBy(*fine).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(begins, [*by, "__coarse"]).withColumn("cum", F.col("__base") + F.sum(amount).over(within))
    return out.where(F.col("cum") <= cap).drop("__coarse", "__base")


def rank_within(df: DataFrame, by: list[str], coarse: Column, fine: list[Column | str], name: str) -> DataFrame:
    """Row numbers from 1 within ``by`` in the order (coarse, fine).

    Counts by the coarse key tell where each key's numbers begin, so only rows with one coarse key are sorted
    together, and a key that holds a large share of all rows is spread over many tasks.
    """
    keyed = df.withColumn("__coarse", coarse)
    counts = keyed.groupBy(*by, "__coarse").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    keys = [*by, "__coarse"]
    joined = keyed.alias("k").join(begins.alias("s"), [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys]).select("k.*", "s.__base")
    within = Window.partitionBy(*keys).orderBy(*fine)
    return joined.withColumn(name, F.col("__base") + F.row_number().over(within)).drop("__coarse", "__base")


def next_within(df: DataFrame, by: list[str], coarse: Column, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the ``value`` of the next row within ``by`` in the order of ``order``, null for the last.

    Rows are sorted within ranges of the order (``coarse``); the first row of each range, one a range, closes the one before.
    """
    keyed = df.withColumn("__coarse", coarse)
    ends = keyed.groupBy(*by, "__coarse").agg(F.min_by(value, order).alias("__first"))
    ends = ends.withColumn("__next", F.lead("__first").over(Window.partitionBy(*by).orderBy("__coarse"))).drop("__first")
    keys = [*by, "__coarse"]
    joined = keyed.alias("k").join(ends.alias("s"), [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys]).select("k.*", "s.__next")
    return joined.withColumn(name, F.coalesce(F.lead(value).over(Window.partitionBy(*keys).orderBy(order)), "__next")).drop("__coarse", "__next")


def smallest(df: DataFrame, draw: Column, ties: list[str], k: int, bits: int = 12) -> DataFrame:
    """The k rows with the smallest 32-bit draws; equal draws in the order of ``ties``.

    A histogram of the draws' leading bits tells which bin holds the kth; only that bin is sorted.
    """
    keyed = df.withColumn("__u", draw).withColumn("__bin", F.shiftright("__u", 32 - bits))
    below = 0
    for row in keyed.groupBy("__bin").agg(F.count("*").alias("n")).orderBy("__bin").collect():  # at most 2**bits rows
        if below + row["n"] >= k:
            edge = keyed.where(F.col("__bin") == row["__bin"]).orderBy("__u", *ties).limit(k - below)
            return keyed.where(F.col("__bin") < row["__bin"]).unionByName(edge).drop("__u", "__bin")
        below += row["n"]
    return df
