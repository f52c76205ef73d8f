"""Breadth-first traversal of a link graph with budgets of depth and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _followed(seen: DataFrame, front: DataFrame, edges: DataFrame, rounds: int, most_depth: int, most_pages: int, by: str, keep) -> DataFrame:
    """``seen`` with what is found from ``front`` in so many rounds, numbered on."""
    within = [by] if by in edges.columns else []
    links = edges.withColumnRenamed("src", "node")
    for _ in range(rounds):
        from_ = front.where(F.col("depth") < most_depth)
        found = from_.join(links, [*within, "node"]).groupBy(by, F.col("dst").alias("node")).agg(F.min(F.struct("place", "ord", F.col("dst"))).alias("first"), (F.min("depth") + 1).alias("depth"))
        new = found.join(seen.select(by, "node").distinct(), [by, "node"], "left_anti")
        sizes = seen.groupBy(by).agg(F.max("place").alias("before"))
        order = F.row_number().over(Window.partitionBy(by).orderBy("first"))
        front = keep(new.join(sizes, by).select(by, "node", "depth", (F.col("before") + order).alias("place")).where(F.col("place") <= most_pages))
        seen = seen.unionByName(front)
    return seen


def crawl(roots: DataFrame, edges: DataFrame, most_depth: int, most_pages: int, by: str = "host", keep=lambda df: df) -> DataFrame:
    """``by, node, depth, place``: what a first-in-first-out crawl visits, in its order (from 1); each node once.

    ``roots`` has ``by, node``; ``edges`` has ``src, dst, ord``, the place of a link on its page, and ``by`` if nodes are only unique within it. Links of the
    page visited first come first. Depth bounds the rounds, and so the plan; only what the page budget of a ``by`` lets in is followed further, so a
    frontier has at most the budget's pages times the links of one. ``keep`` may write what each round found and give it back, so rounds don't repeat those before.
    """
    seen = keep(roots.select(by, "node", F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("place")))
    return _followed(seen, seen, edges, most_depth, most_depth, most_pages, by, keep).where(F.col("place") <= most_pages)


def crawl_with_probe(roots: DataFrame, edges: DataFrame, searches: DataFrame, most_depth: int, most_pages: int, by: str = "host", keep=lambda df: df) -> DataFrame:
    """A crawl that tries one search and then goes on: ``by, node, depth, place, from_probe``.

    When nothing is left to follow, the first visited page with a search (``searches``: by, node, result) is asked once. Its result
    is visited whatever the budget, seen before or not, one level below the page that was asked; its links are then followed within what is left of both budgets.
    """
    seen = keep(crawl(roots, edges, most_depth, most_pages, by, keep))
    asked = seen.join(searches, [by, "node"]).groupBy(by).agg(F.min_by(F.struct("depth", "result"), "place").alias("asked"), F.min("place").alias("__asked"))
    sizes = seen.groupBy(by).agg(F.max("place").alias("before"))
    result = keep(asked.join(sizes, by).select(by, F.col("asked.result").alias("node"), (F.col("asked.depth") + 1).alias("depth"), (F.col("before") + 1).alias("place")))
    both = seen.unionByName(result)
    whole = _followed(both, result, edges, most_depth, most_depth, most_pages, by, keep)
    probe = result.select(by, "place", F.lit(True).alias("from_probe"))
    return whole.join(probe, [by, "place"], "left").withColumn("from_probe", F.coalesce("from_probe", F.lit(False)))


def first_visits(visits: DataFrame, order: list[str], most: int) -> DataFrame:
    """``path, from_task, place``: the first ``most`` distinct paths in the order of tasks and, within one, of its visits.

    ``visits`` has ``path, task`` and the ``order`` columns, the task's own first. Each path's first visit is an aggregate, and only ``most`` rows are sorted.
    """
    first = visits.groupBy("path").agg(F.min(F.struct(*order, "task")).alias("first"))
    top = first.orderBy("first", "path").limit(most)
    place = F.row_number().over(Window.orderBy("first", "path"))  # of the rows within the cap
    return top.select("path", F.col("first.task").alias("from_task"), place.cast("long").alias("place"))
