"""The same entities in DuckDB's SQL, as common table expressions."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "tasks": ((), """
      SELECT t AS task_id,
        CASE (t % 7 + 1) WHEN 1 THEN ['wiki'] WHEN 2 THEN ['news'] WHEN 3 THEN ['wiki', 'news'] WHEN 4 THEN ['shop']
          WHEN 5 THEN ['wiki', 'shop'] WHEN 6 THEN ['news', 'shop'] ELSE ['wiki', 'news', 'shop'] END AS sites,
        array_to_string(sites, '+') AS sites_key,
        CASE WHEN len(sites) = 1 THEN sites[1] ELSE 'multi' END AS grp,
        CASE WHEN t <= 103 THEN 'test' ELSE 'train' END AS split
      FROM range(1::BIGINT, 232::BIGINT) r(t)"""),
    "arms": ((), """
      SELECT * FROM (VALUES ('L_wiki', 'wiki', ['news', 'shop']), ('L_news', 'news', ['wiki', 'shop']), ('L_shop', 'shop', ['wiki', 'news']),
        ('L_multi', 'multi', ['wiki', 'news', 'shop']), ('M_all', NULL, ['wiki', 'news', 'shop'])) v(arm, held_out, seen)"""),
    "episodes": (("tasks",), """
      SELECT o_orderkey AS episode_id, (year(o_orderdate) % 6 + 1)::BIGINT AS era, o_orderkey % 231 + 1 AS task_id, o_custkey % 3 AS seed,
        (o_orderstatus = 'F')::DOUBLE AS reward, coalesce(n, 0)::BIGINT AS n_steps, o_orderpriority < '3' AS terminated,
        o_orderpriority = '5-LOW' AS err, o_custkey AS cust, t.sites, t.sites_key, t.grp, t.split
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
      JOIN tasks t ON t.task_id = o_orderkey % 231 + 1"""),
    "evals": (("episodes",), """
      SELECT e.* EXCLUDE (cust), CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'L_wiki' WHEN 'BUILDING' THEN 'L_news' WHEN 'FURNITURE' THEN 'L_shop'
          WHEN 'HOUSEHOLD' THEN 'L_multi' ELSE 'M_all' END AS arm,
        (row_number() OVER (PARTITION BY c_mktsegment, era, seed, task_id ORDER BY episode_id) - 1)::BIGINT AS repeat
      FROM episodes e JOIN customer ON c_custkey = cust"""),
    "cells": ((), """
      SELECT n_nationkey::BIGINT AS cell, n_regionkey::BIGINT AS env, (n_nationkey // 5)::BIGINT AS era,
        CASE WHEN n_nationkey // 5 < 4 THEN (1996.0 + (n_nationkey // 5) * 5 + n_regionkey * 0.5)::DOUBLE END AS year FROM nation"""),
    "matrix": (("cells",), """
      SELECT a.cell AS src, a.env AS src_env, a.era AS src_era, a.year AS src_year, b.cell AS dst, b.env AS dst_env, b.era AS dst_era, b.year AS dst_year, value, n
      FROM cells a CROSS JOIN cells b LEFT JOIN (
        SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, avg((l_returnflag = 'R')::DOUBLE) AS value, count(*) AS n
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
      ) m ON m.src = a.cell AND m.dst = b.cell"""),
}


def sql(body: str, *names: str, more: dict[str, str] | None = None) -> str:
    """``body`` after the named expressions, those they need, and ``more`` of the query's own."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        parts.setdefault(name, CTES[name][1])

    for name in names:
        need(name)
    parts |= more or {}
    return ("WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n" if parts else "") + body
