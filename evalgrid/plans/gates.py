"""Queries of gates, graphs, sinks and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.functions.rng import draw, draw_sql
from evalgrid.operators import graphs, sinks
from evalgrid.plans import register
from evalgrid.plans.ctes import sql
from evalgrid.sources import bindings as b

S = SparkSession

@register("gate03_determinism", "SELECT user_id, event_type, count(*) AS repeats, count(DISTINCT md5(props)) AS hashes, count(DISTINCT md5(props)) = 1 AND count(*) >= 2 AS ok FROM events GROUP BY 1, 2")
def gate03(spark: S, d: str) -> DataFrame:
    g = b.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("repeats"), F.size(F.collect_set(F.md5(F.col("props").cast("binary")))).cast("long").alias("hashes"))
    return g.withColumn("ok", (F.col("hashes") == 1) & (F.col("repeats") >= 2))


ASSERTIONS = {
    "text": "text IS NULL OR text = ''", "lang": "lang IS NULL", "source": "source IS NULL", "length": "n_chars <> length(text)", "owner": "NOT regexp_like(source, '^src[0-9]+$')", "language": "lang NOT IN ('en', 'de', 'es', 'fr')",
}


@register("gate05_required_fields", " UNION ALL ".join(f"SELECT '{k}' AS assertion, count(*) FILTER ({v.replace('regexp_like', 'regexp_matches')}) AS violations, min(doc_id) FILTER ({v.replace('regexp_like', 'regexp_matches')}) AS example FROM documents" for k, v in ASSERTIONS.items()) + " UNION ALL SELECT 'unique', count(*) - count(DISTINCT doc_id), NULL FROM documents")
def gate05(spark: S, d: str) -> DataFrame:
    """Every assertion on the corpus with its violations and the first document that breaks it; one pass for all of them."""
    docs = b.table(spark, d, "documents")
    counts = docs.agg(
        *[F.struct(F.count_if(F.expr(v)).alias("violations"), F.min(F.when(F.expr(v), F.col("doc_id"))).alias("example")).alias(k) for k, v in ASSERTIONS.items()],
        F.struct((F.count("*") - F.count_distinct("doc_id")).alias("violations"), F.lit(None).cast("long").alias("example")).alias("unique"))
    rows = F.array(*[F.struct(F.lit(k).alias("assertion"), F.col(f"{k}.violations").alias("violations"), F.col(f"{k}.example").alias("example")) for k in (*ASSERTIONS, "unique")])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def require_fields(assertions: DataFrame) -> None:
    """Raises ValueError with every assertion that doesn't hold."""
    broken = [f"{r['assertion']} ({r['violations']})" for r in assertions.where("violations > 0").orderBy("assertion").collect()]  # a row an assertion
    if broken:
        raise ValueError(f"assertions that don't hold: {', '.join(broken)}")


STATUS = """SELECT 'documents' AS artefact, count(*) AS n, CASE WHEN count(*) = 0 THEN 'missing' WHEN count(DISTINCT source) < 20 THEN 'partial' ELSE 'ok' END AS status FROM documents UNION ALL SELECT 'pages', count(*), CASE WHEN count(*) = 0 THEN 'missing' WHEN count(*) FILTER (html NOT LIKE '%</html>%') > 0 THEN 'partial' ELSE 'ok' END FROM pages UNION ALL SELECT 'embeddings', count(*), CASE WHEN count(*) = 0 THEN 'missing' WHEN count(*) FILTER (len(embedding) <> 64) > 0 THEN 'partial' ELSE 'ok' END FROM embeddings UNION ALL SELECT 'labels', count(*), CASE WHEN count(*) = 0 THEN 'missing' WHEN count(*) < (SELECT count(*) FROM documents) THEN 'partial' ELSE 'ok' END FROM labels"""


@register("gate06_artefact_status", f"SELECT *, (SELECT coalesce(string_agg(artefact, ',' ORDER BY artefact), '') FROM ({STATUS}) WHERE status <> 'ok' AND artefact <> 'labels') AS blocking FROM ({STATUS})")
def gate06(spark: S, d: str) -> DataFrame:
    """The status of each artefact by what it holds, and the list of those that block; labels may be partial."""

    def one(name: str, partial) -> DataFrame:
        status = F.when(F.count("*") == 0, "missing").when(partial, "partial").otherwise("ok")
        return b.table(spark, d, name).agg(F.count("*").alias("n"), status.alias("status")).withColumn("artefact", F.lit(name))

    docs = b.table(spark, d, "documents").agg(F.count("*").alias("docs"))
    labels = b.table(spark, d, "labels").agg(F.count("*").alias("n")).crossJoin(docs).select("n", F.when(F.col("n") == 0, "missing").when(F.col("n") < F.col("docs"), "partial").otherwise("ok").alias("status"), F.lit("labels").alias("artefact"))
    rows = one("documents", F.count_distinct("source") < 20).unionByName(one("pages", F.count_if(~F.contains("html", F.lit("</html>"))) > 0)).unionByName(one("embeddings", F.count_if(F.size("embedding") != 64) > 0)).unionByName(labels)
    bad = F.when((F.col("status") != "ok") & (F.col("artefact") != "labels"), F.col("artefact"))
    return rows.withColumn("blocking", F.array_join(F.array_sort(F.collect_list(bad).over(Window.partitionBy())), ","))


CHECKS = {"repeated_keys": "n - n_keys", "empty_episodes": "empty", "stale_declaration": "(declared <> emitted)::INTEGER", "empty_selection": "(n = 0)::INTEGER"}


@register("gate07_preflight", sql("WITH c AS (SELECT arm, count(task_id) AS n, count(DISTINCT era * 100000 + seed * 10000 + task_id) AS n_keys, count(*) FILTER (n_steps = 0) AS empty, coalesce(sum(n_steps), 0)::BIGINT AS declared, coalesce(sum(found), 0)::BIGINT AS emitted FROM arms LEFT JOIN (SELECT e.*, coalesce(k, 0) AS found FROM evals e LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem WHERE l_quantity > 0 GROUP BY 1) ON l_orderkey = episode_id) USING (arm) GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT arm, '{k}' AS problem, ({v})::BIGINT AS n FROM c WHERE ({v}) > 0" for k, v in CHECKS.items()), "evals", "arms").replace("\nWITH c AS (", ",\nc AS (", 1))
def gate07(spark: S, d: str) -> DataFrame:
    """The problems of each arm before a launch: keys that repeat, episodes without steps, a side-car whose declared steps aren't those that are there, an empty selection. An arm without a problem has no row."""
    key = F.col("era") * 100000 + F.col("seed") * 10000 + F.col("task_id")
    there = b.table(spark, d, "lineitem").where("l_quantity > 0").groupBy(F.col("l_orderkey").alias("episode_id")).agg(F.count("*").alias("found"))
    e = b.eval_records(spark, d).join(there, "episode_id", "left").groupBy("arm").agg(
        F.count("task_id").alias("n"), F.count_distinct(key).alias("n_keys"), F.count_if(F.col("n_steps") == 0).alias("empty"), F.sum("n_steps").alias("declared"), F.coalesce(F.sum("found"), F.lit(0)).alias("emitted"))
    c = b.arms(spark).select("arm").join(e, "arm", "left").fillna(0)
    problems = {"repeated_keys": F.col("n") - F.col("n_keys"), "empty_episodes": F.col("empty"), "stale_declaration": (F.col("declared") != F.col("emitted")).cast("long"), "empty_selection": (F.col("n") == 0).cast("long")}
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("problem"), v.cast("long").alias("n")) for k, v in problems.items()]), lambda x: x.n > 0)
    return c.select("arm", F.explode(rows).alias("r")).select("arm", "r.*")


@register("gr02_visited_in_order", "SELECT path, first_user, visits FROM (SELECT path, arg_min(user_id, (user_id, ts, event_id)) AS first_user, count(*) AS visits FROM (SELECT '/' || event_type || '/' || json_extract_string(props, '$.k') AS path, user_id, ts, event_id FROM events) GROUP BY path) ORDER BY path LIMIT 200")
def gr02(spark: S, d: str) -> DataFrame:
    path = F.concat_ws("/", F.lit(""), "event_type", F.get_json_object("props", "$.k"))
    g = b.table(spark, d, "events").select(path.alias("path"), "user_id", "ts", "event_id").groupBy("path")
    return g.agg(F.min(F.struct("user_id", "ts", "event_id")).getField("user_id").alias("first_user"), F.count("*").alias("visits")).orderBy("path").limit(200)


@register("ag17_module_shapes", "SELECT p_type AS module, count(*) AS sites, count(DISTINCT (p_size, p_partkey % 16)) AS shapes, sum(8 * (p_size + p_partkey % 16))::BIGINT AS budget, (5 * sum(8 * (p_size + p_partkey % 16)))::BIGINT AS bank FROM part GROUP BY ROLLUP (p_type)")
def ag17_shapes(spark: S, d: str) -> DataFrame:
    """Parts as sites of modules (their type): how many there are, their distinct shapes (in, out), the parameters of rank 8, and those of a bank of five; and all together."""
    p = b.table(spark, d, "part").select("p_type", F.col("p_size").cast("long").alias("d_in"), (F.col("p_partkey") % 16).alias("d_out"))
    size = F.sum(8 * (F.col("d_in") + F.col("d_out")))
    return p.rollup("p_type").agg(F.count("*").alias("sites"), F.count_distinct("d_in", "d_out").alias("shapes"), size.alias("budget"), (5 * size).alias("bank")).withColumnRenamed("p_type", "module")


@register("ag21_main_crawl_costs", r"""SELECT version, count(*) AS pages, count(DISTINCT host) AS calls, sum(length(html) // 4)::BIGINT AS tokens, count(DISTINCT version) AS versions, round(count(*) / count(DISTINCT version), 6) AS pages_per_version, round(count(*) / (103 * count(DISTINCT version)), 6) AS steps_per_episode,
    CASE WHEN count(*) FILTER (NOT titled) = 0 THEN 'PASS' WHEN count(*) FILTER (NOT titled) * 10 < count(*) THEN 'report' ELSE 'FAIL' END AS gate
  FROM (SELECT page_id % 6 + 1 AS version, regexp_extract(url, '://([^/?#]*)', 1) AS host, html, regexp_matches(html, '(?i)<title>\s*\S') AS titled FROM pages WHERE page_id % 7 <> 0) GROUP BY ROLLUP (version)""")
def ag21_main(spark: S, d: str) -> DataFrame:
    """What crawls cost by version and together: pages, calls (a site one), tokens (four characters one), and the gate on pages without a title. Every seventh page is no main crawl's and doesn't count."""
    p = b.table(spark, d, "pages").where("page_id % 7 <> 0").select((F.col("page_id") % 6 + 1).alias("version"), F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), F.floor(F.length("html") / 4).alias("tokens"), F.rlike("html", F.lit(r"(?i)<title>\s*\S")).alias("titled"))
    # The rollup's own column is null in the total, so versions are counted from a copy.
    g = p.withColumn("v", F.col("version")).rollup("version").agg(F.count("*").alias("pages"), F.count_distinct("host").alias("calls"), F.sum("tokens").alias("tokens"), F.count_distinct("v").alias("versions"), F.count_if(~F.col("titled")).alias("bad"))
    gate = F.when(F.col("bad") == 0, "PASS").when(F.col("bad") * 10 < F.col("pages"), "report").otherwise("FAIL")
    return g.select("version", "pages", "calls", "tokens", "versions", F.round(F.col("pages") / F.col("versions"), 6).alias("pages_per_version"), F.round(F.col("pages") / (103 * F.col("versions")), 6).alias("steps_per_episode"), gate.alias("gate"))


@register("gr02_first_visits", "SELECT path, f['u'] AS from_task, row_number() OVER (ORDER BY f) AS place FROM (SELECT path, min({'u': user_id, 't': ts, 'e': event_id}) AS f FROM (SELECT '/' || event_type || '/' || json_extract_string(props, '$.k') AS path, user_id, ts, event_id FROM events) GROUP BY path) ORDER BY place LIMIT 25")
def gr02_first(spark: S, d: str) -> DataFrame:
    """The paths that tasks (users, by number) visited first, in the order of their first visit, as many as a crawl has pages."""
    path = F.concat_ws("/", F.lit(""), "event_type", F.get_json_object("props", "$.k"))
    visits = b.table(spark, d, "events").select(path.alias("path"), F.col("user_id").alias("task"), "user_id", "ts", "event_id")
    return graphs.first_visits(visits, ["user_id", "ts", "event_id"], 25)


@register("snk04_registry_upsert", "SELECT coalesce(n.k, o.k) AS k, coalesce(n.rows, o.rows) AS rows FROM (SELECT source AS k, count(*) AS rows FROM documents WHERE lang = 'en' GROUP BY 1) o FULL JOIN (SELECT source || '-de' AS k, count(*) AS rows FROM documents WHERE lang = 'de' GROUP BY 1) n ON o.k = n.k")
def snk04(spark: S, d: str) -> DataFrame:
    counts = lambda lang, suffix: b.table(spark, d, "documents").where(F.col("lang") == lang).groupBy(F.concat("source", F.lit(suffix)).alias("k")).agg(F.count("*").alias("rows"))
    return sinks.upsert(counts("en", ""), counts("de", "-de"), "k")


@register("ag15_per_cell_batch_mean", sql("SELECT grp, round(avg(m), 6) AS loss, count(*) AS batches FROM (SELECT DISTINCT e.grp, b.batch, b.m FROM (SELECT episode_id, grp, episode_id // 16 AS batch FROM episodes) e JOIN (SELECT episode_id // 16 AS batch, avg(n_steps) AS m FROM episodes GROUP BY 1) b USING (batch)) GROUP BY grp", "episodes"))
def ag15(spark: S, d: str) -> DataFrame:
    batches = b.episodes(spark, d).groupBy(F.floor(F.col("episode_id") / 16).alias("batch")).agg(F.avg("n_steps").alias("m"), F.collect_set("grp").alias("groups"))
    return batches.select("m", F.explode("groups").alias("grp")).groupBy("grp").agg(F.round(F.avg("m"), 6).alias("loss"), F.count("*").alias("batches"))


@register("ag16_weighted_token_loss", """SELECT user_id, round(sum(w * nll) / sum(w), 6) AS nll, is_kl, round(avg(exp(dd) - dd - 1), 6) AS k3 FROM (SELECT user_id, value AS nll, 1.0 + event_id % 3 AS w, greatest(-20, least(8, (event_id % 7 - 3) / 2)) AS dd, sum(CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) > 0 AS is_kl FROM events) GROUP BY user_id, is_kl""")
def ag16(spark: S, d: str) -> DataFrame:
    gamma = ((F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0)).cast("int")
    w, dd = F.lit(1.0) + F.col("event_id") % 3, F.greatest(F.lit(-20.0), F.least(F.lit(8.0), (F.col("event_id") % 7 - 3) / 2))
    g = b.table(spark, d, "events").groupBy("user_id").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("nll"), (F.sum(gamma) > 0).alias("is_kl"), F.avg(F.exp(dd) - dd - 1).alias("k3"))
    return g.select("user_id", F.round("nll", 6).alias("nll"), "is_kl", F.round("k3", 6).alias("k3"))


@register("ag17_parameter_budget", "SELECT p_brand, sum(8 * (p_size + 64))::BIGINT AS budget, count(DISTINCT p_size) AS shapes, round(sum(8 * (p_size + 64)) * 5 / 1e6, 6) AS bank_millions FROM part GROUP BY 1")
def ag17(spark: S, d: str) -> DataFrame:
    size = F.sum(8 * (F.col("p_size") + 64))
    return b.table(spark, d, "part").groupBy("p_brand").agg(size.alias("budget"), F.count_distinct("p_size").alias("shapes"), F.round(size * 5 / 1e6, 6).alias("bank_millions"))


@register("ag19_source_by_priority", "SELECT src, count(*) AS n, count(DISTINCT digest) AS digests FROM (SELECT CASE WHEN l.quality = 1 THEN 'episode' WHEN l.doc_id IS NOT NULL THEN 'cell' ELSE 'text' END AS src, sha1(lang || source) AS digest FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1")
def ag19(spark: S, d: str) -> DataFrame:
    labels = b.table(spark, d, "labels").select("doc_id", "quality")
    j = b.table(spark, d, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    src = F.when(F.col("quality") == 1, "episode").when(F.col("quality").isNotNull(), "cell").otherwise("text")
    return j.groupBy(src.alias("src")).agg(F.count("*").alias("n"), F.count_distinct(F.sha1(F.concat("lang", "source").cast("binary"))).alias("digests"))


@register("ag20_conditioning_precedence", f"SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'sample' WHEN label < 4 THEN 'stored' ELSE 'hash' END AS kind, CASE WHEN vec_id % 5 = 0 THEN round(embedding[1]::DOUBLE, 6) WHEN label < 4 THEN m ELSE round({draw_sql('cond', 'label')} / 4294967296, 6) END AS x FROM embeddings LEFT JOIN (SELECT label AS l, round(avg(embedding[1]::DOUBLE), 6) AS m FROM embeddings GROUP BY 1) ON l = label")
def ag20(spark: S, d: str) -> DataFrame:
    e = b.table(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", 0).cast("double").alias("x"))
    stored = e.groupBy("label").agg(F.round(F.avg("x"), 6).alias("m"))
    own, known = F.col("vec_id") % 5 == 0, F.col("label") < 4
    j = e.join(F.broadcast(stored), "label", "left")
    value = F.when(own, F.round("x", 6)).when(known, F.col("m")).otherwise(F.round(draw("cond", "label") / 4294967296, 6))
    return j.select("vec_id", F.when(own, "sample").when(known, "stored").otherwise("hash").alias("kind"), value.alias("x"))


@register("ag21_scout_cost_rollup", sql("SELECT era, count(*) AS calls, sum(n_steps)::BIGINT AS pages, round(sum(n_steps) / (103 * 3), 6) AS pages_per_task, CASE WHEN count(*) FILTER (err) = 0 THEN 'PASS' WHEN count(*) FILTER (err) * 2 < count(*) THEN 'report' ELSE 'FAIL' END AS gate FROM episodes WHERE split = 'test' GROUP BY ROLLUP (era)", "episodes"))
def ag21(spark: S, d: str) -> DataFrame:
    g = b.episodes(spark, d).where("split = 'test'").rollup("era").agg(F.count("*").alias("calls"), F.sum("n_steps").alias("pages"), F.count_if("err").alias("e"))
    gate = F.when(F.col("e") == 0, "PASS").when(F.col("e") * 2 < F.col("calls"), "report").otherwise("FAIL")
    return g.select("era", "calls", "pages", F.round(F.col("pages") / 309, 6).alias("pages_per_task"), gate.alias("gate"))


@register("st04_streaming_hourly_counts", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def st04(spark: S, d: str) -> DataFrame:
    """The windowed count of ``streaming.retries`` in batch form; the tests hold the stream against it."""
    from evalgrid.streaming import retries

    return retries.hourly(b.table(spark, d, "events"))
