"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import discard, written


def _to_smallest(links: DataFrame, at_least_self: bool) -> DataFrame:
    """Links from each node's neighbours to the smallest of them (and of itself).

    ``links`` are (u, v). The smallest neighbour is a plain aggregate, which
    sums up within each task first, and is written and joined back; so both sides of the join are
    plain tables, of which the adaptive planner splits a hub's links.
    """
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    low = written(low.withColumn("low", F.least("u", "low")) if at_least_self else low, "lows")
    out = links.join(low, "u")
    if at_least_self:
        return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return out.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns u, v): root is the smallest node that it reaches.

    Alternates two steps until nothing changes: each node's larger neighbours
    are linked to its smallest neighbour, then each node's smaller neighbours
    are. Every round is written to the shared folder, and two counts decide
    whether it was the last. Nulls and links to oneself are left out; a node
    without any other link doesn't appear.
    """
    clean = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = written(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, at_least_self=True)
        small = _to_smallest(large.where("u <> v"), at_least_self=False)
        before, now = now, written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        discard(before)
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    pairs = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.unionByName(roots)
