"""A corpus with anchors: rows of another source, drawn in cycles, without those that say the same as an own row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.rng import draw
from evalgrid.operators.selection import smallest

#: Share of the drawn rows that may collide with own ones.
MOST_COLLISIONS = 0.05


def cycled(pool: DataFrame, size: int, target: int, seed: int | str) -> DataFrame:
    """``target`` rows of the pool (column id; ``size`` rows) with ``copy``: all of it as often as it fits, and of the last copy those with the smallest draws."""
    whole, rest = divmod(target, size)
    last = smallest(pool.withColumn("copy", F.lit(whole).cast("long")), draw(seed, F.lit(whole), "id"), ["id"], rest) if rest else None
    full = pool.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(whole - 1).cast("long")))) if whole else None
    return last if full is None else full if last is None else full.unionByName(last)


def anchored(own: DataFrame, pool: DataFrame, ratio: float = 1.0, seed: int | str = 0, most_collisions: float = MOST_COLLISIONS) -> tuple[DataFrame, dict]:
    """``id, role, copy, weight`` of a corpus (columns id, content of both tables), and its statistics.

    Own rows have role 0 and weight 0, anchors role 1 and weight 1. So many anchors are drawn as make the ratio; a pool that is too small is cycled. Drawn
    rows whose content (by sha1) an own row has are dropped and counted; if they are more than ``most_collisions`` of the drawn ones, if
    nothing is to be drawn or nothing is left, the build is refused (ValueError). Null contents collide with nothing.
    """
    n_own, n_pool = own.count(), pool.count()
    target = round(ratio * n_own)
    if target <= 0 or not n_pool:
        raise ValueError(f"no anchors: {target} rows to draw from {n_pool}")
    key = F.sha1(F.col("content").cast("binary"))
    drawn = cycled(pool.select("id", key.alias("key")), n_pool, target, seed)
    keys = own.select(key.alias("key")).where("key IS NOT NULL").distinct().withColumn("same", F.lit(True))
    judged = drawn.join(keys, "key", "left").withColumn("same", F.coalesce("same", F.lit(False)))
    unique, dropped = judged.agg(F.count_distinct("id"), F.count_if("same")).first()
    rate = dropped / target
    if rate > most_collisions:
        raise ValueError(f"{dropped} of {target} drawn rows say what an own row says, more than {most_collisions:.0%}")
    if dropped == target:
        raise ValueError("all drawn rows say what an own row says")
    mixed = own.select("id", F.lit(0).alias("role"), F.lit(0).cast("long").alias("copy"), F.lit(0.0).alias("weight")).unionByName(
        judged.where(~F.col("same")).select("id", F.lit(1).alias("role"), "copy", F.lit(1.0).alias("weight")))
    stats = {"n_own": n_own, "n_anchor": target - dropped, "n_candidates": target, "n_unique": unique, "pool_size": n_pool, "cycled": target > n_pool, "n_dropped": dropped, "collision_rate": rate, "n_samples": n_own + target - dropped}
    return mixed, stats
