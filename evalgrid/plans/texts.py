"""Queries over texts, pages and conversations: readers, gates, features and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.functions import text as t
from evalgrid.functions.rng import draw, draw_sql
from evalgrid.operators.selection import smallest
from evalgrid.plans import register
from evalgrid.plans.ctes import sql
from evalgrid.sources import bindings as b

S = SparkSession
GRAMS, WORDS = t.ngrams_sql("text", 6)
GRAM_SQL = f"SELECT DISTINCT {{id}} AS id, unnest({GRAMS}) AS gram FROM (SELECT {{id}}, {WORDS} AS w FROM {{table}})"


def first_turn(spark: S, d: str, role: str):
    return F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))


@register("jn14_content_anti_join", "SELECT source, count(*) AS kept FROM documents WHERE source <> 'src0' AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE source = 'src0') GROUP BY 1")
def jn14(spark: S, d: str) -> DataFrame:
    docs = b.table(spark, d, "documents").select("source", F.sha1(F.col("text").cast("binary")).alias("key"))
    own = docs.where("source = 'src0'").select("key").distinct()
    return docs.where("source <> 'src0'").join(own, "key", "left_anti").groupBy("source").agg(F.count("*").alias("kept"))


@register("jn15_reconciliation", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.k IS NULL THEN 'missing' WHEN p.k IS NULL THEN 'unpredicted' WHEN o.q <> p.q THEN 'mismatch' ELSE 'ok' END AS status
  FROM (SELECT p_partkey AS k, p_size % 3 AS q FROM part WHERE p_size <= 40) p FULL JOIN (SELECT l_partkey AS k, (count(*) % 3)::INTEGER AS q FROM lineitem WHERE l_quantity >= 20 GROUP BY 1) o ON o.k = p.k) GROUP BY 1""")
def jn15(spark: S, d: str) -> DataFrame:
    p = b.table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 3).alias("want"))
    o = b.table(spark, d, "lineitem").where("l_quantity >= 20").groupBy(F.col("l_partkey").alias("k")).agg((F.count("*") % 3).alias("got"))
    both = p.join(o, "k", "full_outer")
    return both.groupBy(F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unpredicted").when(F.col("got") != F.col("want"), "mismatch").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))


@register("jn16_common_sites", "SELECT l_partkey AS site, count(DISTINCT n_regionkey) AS k, count(DISTINCT l_linestatus) = 1 AS one_rank FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT n_regionkey) = 5")
def jn16(spark: S, d: str) -> DataFrame:
    s = b.table(spark, d, "supplier").join(F.broadcast(b.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    li = b.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    g = li.groupBy(F.col("l_partkey").alias("site")).agg(F.size(F.collect_set("n_regionkey")).cast("long").alias("k"), (F.size(F.collect_set("l_linestatus")) == 1).alias("one_rank"))
    return g.where("k = 5")


BANKS = "SELECT l_partkey AS site, n_regionkey AS bank, max(l_linenumber) AS rank, max(round(l_discount * 100) % 2) AS scaling, max(l_tax >= 0.06) AS base FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"


@register("jn16_bank_consistency", f"""SELECT site, count(*) AS k, CASE WHEN count(*) < (SELECT count(*) FROM region) THEN 'missing' WHEN count(DISTINCT rank) > 1 THEN 'rank' WHEN count(DISTINCT scaling) > 1 THEN 'scaling' WHEN count(DISTINCT base) > 1 THEN 'base' ELSE 'ok' END AS status, min(rank)::BIGINT AS rank FROM ({BANKS}) GROUP BY 1""")
def jn16_banks(spark: S, d: str) -> DataFrame:
    """Each site over the banks that must all have it (a bank a region): the first of what disagrees between them, its rank, its scaling or its base."""
    s = b.table(spark, d, "supplier").join(F.broadcast(b.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("bank"))
    li = b.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    banks = li.groupBy(F.col("l_partkey").alias("site"), "bank").agg(F.max("l_linenumber").alias("rank"), F.max(F.round(F.col("l_discount") * 100) % 2).alias("scaling"), F.max(F.col("l_tax") >= 0.06).alias("base"))
    return consistent(banks, b.table(spark, d, "region").count())


def consistent(banks: DataFrame, k: int) -> DataFrame:
    """``site, k, status, rank`` of adapters' sites (``site, bank, rank, scaling, base``): ``ok`` only if all ``k`` banks have the site and agree."""
    differ = lambda c: F.min(c) != F.max(c)
    status = F.when(F.count("*") < k, "missing").when(differ("rank"), "rank").when(differ("scaling"), "scaling").when(differ("base"), "base").otherwise("ok")
    return banks.groupBy("site").agg(F.count("*").alias("k"), status.alias("status"), F.min("rank").cast("long").alias("rank"))


def require_consistent(sites: DataFrame) -> None:
    """Raises ValueError if any site of ``consistent`` isn't ok, with how many there are of each kind."""
    bad = {r["status"]: r["n"] for r in sites.where("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n")).collect()}  # four kinds
    if bad:
        raise ValueError(f"banks disagree: {dict(sorted(bad.items()))}")


@register("fn03_numbered_sections", r"""SELECT doc_id, count(*) AS n_sections, string_agg(k::VARCHAR, ',' ORDER BY k) AS numbers, sha1(string_agg(body, '|' ORDER BY k)) AS bodies FROM (
  SELECT doc_id, (i % 7 + 1)::INTEGER AS k, arg_max(trim(line, ' '), i) AS body FROM (SELECT doc_id, unnest(string_split(replace(text, '## ', ''), chr(10))) AS line, unnest(range(len(string_split(replace(text, '## ', ''), chr(10))))) AS i FROM documents) GROUP BY 1, 2) GROUP BY 1""")
def fn03(spark: S, d: str) -> DataFrame:
    lines = F.split(F.replace(F.col("text"), F.lit("## "), F.lit("")), "\n")
    manual = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("## "), (i % 7 + 1).cast("string"), F.lit("."), x)), "\n")
    parsed = b.table(spark, d, "documents").select("doc_id", t.sections(manual).alias("s"))
    entries = F.transform(F.array_sort(F.map_entries("s")), lambda e: F.struct(e.key.alias("k"), e.value.alias("body")))
    e = parsed.select("doc_id", entries.alias("e"))
    return e.select("doc_id", F.size("e").cast("long").alias("n_sections"), F.array_join(F.transform("e", lambda x: x.k.cast("string")), ",").alias("numbers"), F.sha1(F.array_join(F.transform("e", lambda x: x.body), "|").cast("binary")).alias("bodies"))


@register("fn04_word_ngrams", f"SELECT doc_id, count(DISTINCT gram) AS n_grams FROM (SELECT doc_id, unnest({GRAMS}) AS gram FROM (SELECT doc_id, {WORDS} AS w FROM documents)) GROUP BY 1")
def fn04(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", F.size(t.ngrams(F.col("text"), 6)).cast("long").alias("n_grams")).where("n_grams > 0")


@register("fn05_context_snippet", "SELECT doc_id, translate(substr(text, greatest(1, strpos(text, ' the ') - 40), 85), chr(10), ' ') AS snippet FROM documents WHERE strpos(text, ' the ') > 0")
def fn05(spark: S, d: str) -> DataFrame:
    at = F.instr("text", " the ")
    return b.table(spark, d, "documents").where(at > 0).select("doc_id", F.translate(F.substr("text", F.greatest(F.lit(1), at - 40), F.lit(85)), "\n", " ").alias("snippet"))


@register("fn07_answer_containers", """SELECT event_id, string_agg(a, '|' ORDER BY a) AS answers FROM (SELECT DISTINCT event_id, unnest(['key-' || json_extract_string(props, '$.k'), lower(event_type), event_type, left(event_type, 3)]) AS a FROM events) WHERE length(a) >= 4 GROUP BY 1""")
def fn07(spark: S, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    groups = F.array(F.array(F.concat(F.lit("key-"), k)), F.array(F.lower("event_type"), F.col("event_type")), F.array(F.left("event_type", F.lit(3))))
    kept = F.filter(F.array_distinct(F.flatten(groups)), lambda a: F.length(a) >= 4)
    return b.table(spark, d, "events").select("event_id", F.array_join(F.array_sort(kept), "|").alias("answers"))


HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


#: Where a block goes in a prompt, and how it begins.
HEADING, BOUNDARY, BLOCK = "## Extra instructions:", "\n\n# Observation", "# Site manual"


def injected(prompt, block):
    """A prompt with a block right before the observation that follows its extra instructions. A prompt without that place, or with a block already, is an error."""
    i = F.instr(prompt, HEADING)
    j = F.when(i > 0, F.call_function("locate", F.lit(BOUNDARY), prompt, F.greatest(i, F.lit(1)))).otherwise(0)
    told = lambda why: F.raise_error(F.lit(why))
    out = F.concat(F.substr(prompt, F.lit(1), j - 1), F.lit("\n"), block, F.lit("\n"), F.substr(prompt, j + 2))
    return F.when(F.contains(prompt, F.lit(BLOCK)), told("the prompt has a manual already")).when(i == 0, told("no extra instructions in the prompt")).when(j == 0, told("no observation after the extra instructions")).otherwise(out)


@register("fn09_inject_block", "SELECT conv_id, '## Extra instructions:' || chr(10) || chr(10) || first || chr(10) || '# Site manual' || chr(10) || 'Use the menu.' || chr(10) || '# Observation' || chr(10) || 'page' AS prompt FROM (SELECT conv_id, arg_min(text, turn) AS first FROM conversations WHERE role = 'user' GROUP BY 1)")
def fn09(spark: S, d: str) -> DataFrame:
    """The manual in the first prompt of each conversation, at the same place as in an evaluation."""
    first = b.table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    prompt = F.concat(F.lit(f"{HEADING}\n\n"), F.col("first"), F.lit(f"{BOUNDARY}\npage"))
    return first.withColumn("whole", prompt).select("conv_id", injected(F.col("whole"), F.lit(f"{BLOCK}\nUse the menu.")).alias("prompt"))


ROLE_SQL = ", ".join(f"len(list_filter(t, lambda x: x = '{k}'))::DOUBLE" for k in t.ROLES)
TAGS_SQL = "[lower(x) FOR x IN regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)]"
OTHER_SQL = "len(list_filter(t, lambda x: x NOT IN (" + ", ".join(f"'{k}'" for k in t.ROLES) + ")))::DOUBLE"


@register("fn11_role_vector", f"SELECT page_id, array_to_string([x::BIGINT FOR x IN v], ',') AS roles, round(list_sum(v), 6) AS total FROM (SELECT page_id, [{ROLE_SQL}, {OTHER_SQL}] AS v FROM (SELECT page_id, {TAGS_SQL} AS t FROM pages))")
def fn11(spark: S, d: str) -> DataFrame:
    v = b.table(spark, d, "pages").select("page_id", t.role_counts(F.col("html")).alias("v"))
    return v.select("page_id", F.array_join(F.transform("v", lambda x: x.cast("long").cast("string")), ",").alias("roles"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))


@register("fn10_role_log_vector", f"SELECT page_id, round(u[1] / n, 6) AS link, round(u[2] / n, 6) AS heading, round(u[9] / n, 6) AS other FROM (SELECT page_id, u, sqrt(list_sum([x * x FOR x IN u])) AS n FROM (SELECT page_id, [ln(1 + x) FOR x IN [{ROLE_SQL}, {OTHER_SQL}]] AS u FROM (SELECT page_id, {TAGS_SQL} AS t FROM pages)))")
def fn10(spark: S, d: str) -> DataFrame:
    v = t.l2_normalised(F.transform(t.role_counts(F.col("html")), lambda x: F.log1p(x)))
    p = b.table(spark, d, "pages").select("page_id", v.alias("v"))
    return p.select("page_id", *[F.round(F.col("v")[i], 6).alias(n) for i, n in ((0, "link"), (1, "heading"), (8, "other"))])


@register("fn10_whole_role_vector", f"SELECT page_id, {', '.join(f'round(u[{k + 1}] / n, 6) AS {name}' for k, name in enumerate([*t.ROLES.values(), 'other']))} FROM (SELECT page_id, u, sqrt(list_sum([x * x FOR x IN u])) AS n FROM (SELECT page_id, [ln(1 + x) FOR x IN [{ROLE_SQL}, {OTHER_SQL}]] AS u FROM (SELECT page_id, {TAGS_SQL} AS t FROM pages)))")
def fn10_whole(spark: S, d: str) -> DataFrame:
    """All components of a page's role vector, by role."""
    v = t.l2_normalised(F.transform(t.role_counts(F.col("html")), lambda x: F.log1p(x)))
    p = b.table(spark, d, "pages").select("page_id", v.alias("v"))
    return p.select("page_id", *[F.round(F.get("v", k), 6).alias(name) for k, name in enumerate([*t.ROLES.values(), "other"])])


@register("sort05_first_matching_label", """SELECT page_id, coalesce(list_filter(regexp_extract_all(html, '<a href="[^"]*">([^<]*)', 1), lambda x: regexp_matches(x, '^[a-z]{4,}$'))[1], 'list') AS label FROM pages""")
def sort05(spark: S, d: str) -> DataFrame:
    labels = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)'), 1)
    return b.table(spark, d, "pages").select("page_id", F.coalesce(F.try_element_at(F.filter(labels, lambda x: F.rlike(x, F.lit("^[a-z]{4,}$"))), F.lit(1)), F.lit("list")).alias("label"))


@register("fn15_signature_blocks", f"SELECT host, round(links / (links + 20.0)::DOUBLE, 6) AS link_sat, round(bold / greatest(1, paragraphs), 6) AS bold_frac, round(links / sqrt(links * links + bold * bold + paragraphs * paragraphs), 6) AS link_unit FROM (SELECT {HOST} AS host, sum(len(regexp_extract_all(html, '<a ')))::DOUBLE AS links, sum(len(regexp_extract_all(html, '<b>')))::DOUBLE AS bold, sum(len(regexp_extract_all(html, '<p>')))::DOUBLE AS paragraphs FROM pages GROUP BY 1)")
def fn15(spark: S, d: str) -> DataFrame:
    n = lambda p: F.sum(F.size(F.regexp_extract_all("html", F.lit(p), 0))).cast("double")
    g = b.table(spark, d, "pages").groupBy(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host")).agg(n("<a ").alias("links"), n("<b>").alias("bold"), n("<p>").alias("paragraphs"))
    norm = F.sqrt(F.expr("links * links + bold * bold + paragraphs * paragraphs"))
    return g.select("host", F.round(F.col("links") / (F.col("links") + 20), 6).alias("link_sat"), F.round(F.col("bold") / F.greatest(F.lit(1.0), "paragraphs"), 6).alias("bold_frac"), F.round(F.col("links") / norm, 6).alias("link_unit"))


@register("fn17_content_fingerprints", """SELECT doc_id, sha1(text) AS sha1, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS fingerprint FROM documents""")
def fn17(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.sha2(F.to_json(F.struct("doc_id", "lang", "source")), 256).alias("fingerprint"))


@register("fn18_hash_vector", "SELECT source, n, round(x / sqrt(x * x + y * y + z * z), 6) AS x, round(y / sqrt(x * x + y * y + z * z), 6) AS y, round(z / sqrt(x * x + y * y + z * z), 6) AS z FROM (SELECT source, count(*) AS n, " + ", ".join(f"{draw_sql('cond', 'source', str(i))} / 4294967296 * 2 - 1 AS {c}" for i, c in enumerate("xyz")) + " FROM documents GROUP BY source)")
def fn18(spark: S, d: str) -> DataFrame:
    g = b.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    v = g.select("source", "n", t.l2_normalised(F.array(*[draw("cond", "source", F.lit(i)) / 4294967296 * 2 - 1 for i in range(3)])).alias("v"))
    return v.select("source", "n", *[F.round(F.col("v")[i], 6).alias(c) for i, c in enumerate("xyz")])


#: Characters of a sample, in the place of tokens.
MOST = 512


@register("fn20_chat_template", f"""SELECT conv_id, length(prompt) AS n_prompt, right(prompt, greatest(0, {MOST} - length(answer))) AS kept, answer, least(length(prompt), greatest(0, {MOST} - length(answer))) AS masked, length(answer) AS target, greatest(0, {MOST} - length(answer) - length(prompt)) AS padding,
    md5(repeat('0', least(length(prompt), greatest(0, {MOST} - length(answer)))) || repeat('1', length(answer)) || repeat('-', greatest(0, {MOST} - length(answer) - length(prompt)))) AS mask
  FROM (SELECT conv_id, string_agg('<|' || role || '|>' || text, chr(10) ORDER BY turn) FILTER (role <> 'assistant') AS prompt, arg_max(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY 1) WHERE prompt IS NOT NULL AND answer IS NOT NULL""")
def fn20(spark: S, d: str) -> DataFrame:
    """Samples of a chat template: the whole response, as much of the prompt's end as fits before it, and masks of what is learned and what is padding."""
    line = F.when(F.col("role") != "assistant", F.struct("turn", F.concat(F.lit("<|"), "role", F.lit("|>"), "text").alias("line")))
    g = b.table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line), "\n").alias("prompt"), F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))
    g = g.where("prompt <> '' AND answer IS NOT NULL").withColumn("target", F.length("answer")).withColumn("n_prompt", F.length("prompt"))
    g = g.withColumn("room", F.greatest(F.lit(0), MOST - F.col("target"))).withColumn("masked", F.least("n_prompt", "room")).withColumn("padding", F.greatest(F.lit(0), MOST - F.col("target") - F.col("n_prompt")))
    mask = F.concat(F.expr("repeat('0', masked)"), F.expr("repeat('1', target)"), F.expr("repeat('-', padding)"))
    return g.select("conv_id", F.col("n_prompt").cast("long").alias("n_prompt"), F.right("prompt", F.col("room")).alias("kept"), "answer", *[F.col(c).cast("long").alias(c) for c in ("masked", "target", "padding")], F.md5(mask.cast("binary")).alias("mask"))


@register("fn22_port_bands", "SELECT s_suppkey, port FROM supplier JOIN (SELECT p AS port, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM range(6000::BIGINT, 60000::BIGINT, 20) r(p) WHERE NOT (p <= 6669 AND p + 19 >= 6665) AND NOT (p <= 10080 AND p + 19 >= 10080)) ON i = s_suppkey % n")
def fn22(spark: S, d: str) -> DataFrame:
    unsafe = spark.createDataFrame([(6665, 6669), (10080, 10080)], "low long, high long")
    bands = spark.range(6000, 60000, 20).withColumnRenamed("id", "port").join(F.broadcast(unsafe), (F.col("port") <= F.col("high")) & (F.col("port") + 19 >= F.col("low")), "left_anti")
    # The series has a few thousand values, whatever the tables' size.
    numbered = bands.select("port", (F.row_number().over(Window.orderBy("port")) - 1).cast("long").alias("i"))
    units = b.table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % numbered.count()).alias("i"))
    return units.join(F.broadcast(numbered), "i").select("s_suppkey", "port")


@register("fn19_injection_sites", "SELECT p_brand, module, sum(n)::BIGINT AS sites, sum(n * r * (d_in + d_out))::BIGINT AS budget FROM (SELECT p_brand, p_size, unnest(range(p_size)) AS layer, 1 AS n, 8 AS r FROM part) JOIN (VALUES ('q', 64, 64, false), ('gate', 64, 256, true)) m(module, d_in, d_out, every) ON every OR layer % 4 = 3 GROUP BY 1, 2")
def fn19(spark: S, d: str) -> DataFrame:
    modules = spark.createDataFrame([("q", 64, 64, False), ("gate", 64, 256, True)], "module string, d_in long, d_out long, every boolean")
    layers = b.table(spark, d, "part").where("p_size > 0").select("p_brand", F.explode(F.sequence(F.lit(0), F.col("p_size") - 1)).alias("layer"))
    found = layers.join(F.broadcast(modules), F.col("every") | (F.col("layer") % 4 == 3))
    return found.groupBy("p_brand", "module").agg(F.count("*").alias("sites"), F.sum(8 * (F.col("d_in") + F.col("d_out"))).alias("budget"))


VARIANTS = {"full": ("system", "user", "assistant"), "affordance": ("system", "user"), "style": ("assistant",)}


@register("fn23_ordered_concatenation", "SELECT variant, conv_id, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn)) AS manual, count(DISTINCT role) = len(any_value(roles)) AS complete FROM conversations, (VALUES ('full', ['system', 'user', 'assistant']), ('affordance', ['system', 'user']), ('style', ['assistant'])) v(variant, roles) WHERE list_contains(roles, role) GROUP BY 1, 2")
def fn23(spark: S, d: str) -> DataFrame:
    """Parts of a manual in fixed order, in three variants; ``complete`` tells whether every part of the variant is there (``require_complete`` makes that an error)."""
    place = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    of = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("variant"), F.array(*map(F.lit, v)).alias("roles")) for k, v in VARIANTS.items()]), lambda x: F.array_contains(x.roles, F.col("role"))))
    parts = b.table(spark, d, "conversations").select("conv_id", "role", "turn", "text", of.alias("v")).groupBy(F.col("v.variant").alias("variant"), "conv_id")
    g = parts.agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), "turn", "text"))).alias("p"), F.size(F.collect_set("role")).alias("k"), F.max(F.size("v.roles")).alias("all"))
    return g.select("variant", "conv_id", F.md5(F.array_join(F.transform("p", lambda x: x.text), "\n---\n").cast("binary")).alias("manual"), (F.col("k") == F.col("all")).alias("complete"))


def require_complete(manuals: DataFrame) -> DataFrame:
    """The manuals, or ValueError if one lacks a part."""
    if not manuals.where("NOT complete").isEmpty():
        raise ValueError("a manual lacks a part")
    return manuals


@register("set02_union_with_roles", "SELECT key, max(role)::BIGINT AS role, count(*) AS n FROM (SELECT sha1(text) AS key, 0 AS role FROM documents WHERE source IN ('src0', 'src1') UNION ALL SELECT sha1(text), 1 FROM documents WHERE source NOT IN ('src0', 'src1')) GROUP BY 1")
def set02(spark: S, d: str) -> DataFrame:
    docs = b.table(spark, d, "documents").select("source", F.sha1(F.col("text").cast("binary")).alias("key"))
    own = docs.where(F.col("source").isin("src0", "src1")).select("key", F.lit(0).cast("long").alias("role"))
    anchors = docs.where(~F.col("source").isin("src0", "src1")).select("key", F.lit(1).cast("long").alias("role"))
    return own.unionByName(anchors).groupBy("key").agg(F.max("role").alias("role"), F.count("*").alias("n"))


@register("set03_anchored_corpus", f"""SELECT count(*) FILTER (role = 0) AS own, count(*) FILTER (role = 1) AS anchors, max(pool) AS pool FROM (SELECT 0 AS role, NULL AS pool FROM documents WHERE source = 'src0' UNION ALL
  SELECT 1, pool FROM (SELECT *, row_number() OVER (ORDER BY u, doc_id) AS rn FROM (SELECT doc_id, {draw_sql('anchor', 'doc_id')} AS u, count(*) OVER () AS pool FROM documents WHERE source <> 'src0' AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE source = 'src0'))) WHERE rn <= (SELECT count(*) FROM documents WHERE source = 'src0'))""")
def set03(spark: S, d: str) -> DataFrame:
    docs = b.table(spark, d, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("key"))
    own = docs.where("source = 'src0'")
    target, pool = own.count(), docs.where("source <> 'src0'").join(own.select("key").distinct(), "key", "left_anti")
    size = pool.count()
    drawn = smallest(pool, draw("anchor", "doc_id"), ["doc_id"], target).select(F.lit(1).alias("role"))
    return own.select(F.lit(0).alias("role")).unionByName(drawn).agg(F.count_if(F.col("role") == 0).alias("own"), F.count_if(F.col("role") == 1).alias("anchors")).withColumn("pool", F.lit(size).cast("long"))


@register("set05_pooled_minus_held_out", "SELECT source, count(*) AS n, count(*) FILTER (sha1(text) IN (SELECT sha1(text) FROM documents WHERE source = 'src3')) AS leaks FROM documents WHERE source <> 'src3' GROUP BY 1")
def set05(spark: S, d: str) -> DataFrame:
    docs = b.table(spark, d, "documents").select("source", F.sha1(F.col("text").cast("binary")).alias("key"))
    held = docs.where("source = 'src3'").select("key", F.lit(True).alias("leak")).distinct()
    return docs.where("source <> 'src3'").join(held, "key", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.coalesce("leak", F.lit(False))).alias("leaks"))


#: Patterns of log lines by name, and what makes a line that has one benign: how it begins, what else it says, or a leaf that isn't targeted.
SUSPECT = {"license": "License", "secret": "token ="}
PREFIX, CONTEXT, TARGETS = "Licensed under", "All rights reserved", ("apiKey", "session")
CLASS_SQL = " ".join(f"WHEN contains(line, '{v}') THEN '{k}'" for k, v in SUSPECT.items())


@register("pf10_log_line_classes", f"""SELECT *, NOT bool_or(verdict = 'hit') OVER (PARTITION BY source) AS ok FROM (SELECT source, pattern, verdict, count(*) AS n FROM (SELECT source, pattern, CASE WHEN starts_with(line, '{PREFIX}') THEN 'benign-prefix' WHEN contains(line, '{CONTEXT}') THEN 'benign-context' WHEN leaf <> '' AND leaf NOT IN ('apiKey', 'session') THEN 'benign-leaf' ELSE 'hit' END AS verdict
  FROM (SELECT source, line, CASE {CLASS_SQL} END AS pattern, regexp_extract(line, '([A-Za-z]+)_token = ', 1) AS leaf FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE pattern IS NOT NULL) GROUP BY ALL)""")
def pf10(spark: S, d: str) -> DataFrame:
    """Lines of each log by the first pattern that they have, and whether that is benign; a log is fine if nothing hits."""
    lines = b.table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    has = lambda s: F.contains("line", F.lit(s))
    pattern = F.coalesce(*[F.when(has(v), k) for k, v in SUSPECT.items()])
    leaf = F.regexp_extract("line", r"([A-Za-z]+)_token = ", 1)
    verdict = F.when(F.startswith("line", F.lit(PREFIX)), "benign-prefix").when(has(CONTEXT), "benign-context").when((leaf != "") & ~leaf.isin(*TARGETS), "benign-leaf").otherwise("hit")
    g = lines.select("source", pattern.alias("pattern"), verdict.alias("verdict")).where("pattern IS NOT NULL").groupBy("source", "pattern", "verdict").agg(F.count("*").alias("n"))
    return g.withColumn("ok", ~F.bool_or(F.col("verdict") == "hit").over(Window.partitionBy("source")))


@register("win05_segment_stream", "SELECT conv_id, episode, count(*) AS n, arg_min(text, turn) AS first FROM (SELECT *, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM conversations) GROUP BY 1, 2")
def win05(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = b.table(spark, d, "conversations").withColumn("episode", F.sum((F.col("role") == "user").cast("long")).over(w))
    return c.groupBy("conv_id", "episode").agg(F.count("*").alias("n"), F.min_by("text", "turn").alias("first"))


#: Characters of a conversation's example, and caps of a turn that are tried in turn.
FIT, CAPS = 6000, (2000, 1000, 500, 250, 125, 60, 30, 10, 1)


@register("win07_worked_examples", f"SELECT conv_id, cap, array_to_string([left(x, cap) FOR x IN ts], ' > ') AS path FROM (SELECT conv_id, ts, coalesce(list_filter({list(CAPS)}, lambda c: list_sum([least(length(x), c) FOR x IN ts]) + 3 * (len(ts) - 1) <= {FIT})[1], 1) AS cap FROM (SELECT conv_id, list(text ORDER BY turn) AS ts FROM conversations GROUP BY 1))")
def win07(spark: S, d: str) -> DataFrame:
    """Each conversation's turns as one path, every turn cut to the largest cap that lets the whole fit. A conversation is a row's array; its turns are few by nature."""
    g = b.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("ts"))
    size = lambda c: F.aggregate("ts", F.lit(0), lambda n, x: n + F.least(F.length(x), c)) + 3 * (F.size("ts") - 1)
    cap = F.coalesce(F.get(F.filter(F.array(*map(F.lit, CAPS)), lambda c: size(c) <= FIT), 0), F.lit(1))
    return g.withColumn("cap", cap).select("conv_id", "cap", F.array_join(F.transform("ts", lambda x: F.left(x, F.col("cap"))), " > ").alias("path"))


@register("fn06_strip_answer", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[.!?] [^.!?]*[.!?]?$') THEN regexp_replace(text, ' [^.!?]*[.!?]?$', '') ELSE text END AS recipe FROM conversations WHERE role = 'assistant'")
def fn06(spark: S, d: str) -> DataFrame:
    cut = F.when(F.rlike("text", F.lit(r"[.!?] [^.!?]*[.!?]?$")), F.regexp_replace("text", r"(?<=[.!?]) [^.!?]*[.!?]?$", "")).otherwise(F.col("text"))
    return b.table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", cut.alias("recipe"))


@register("fn16_perceptual_signature")
def fn16(spark: S, d: str) -> DataFrame:
    """The signature of a page's bytes read as pixels of three; there are no images among the tables."""
    from evalgrid.functions.images import perceptual_signature

    return b.table(spark, d, "pages").select("page_id", perceptual_signature()(F.col("html").cast("binary")).alias("signature")).select("page_id", "signature.gray", "signature.histogram")
