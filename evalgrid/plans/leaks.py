"""Queries of the leak gates: every rule on every manual, the gate's summary, overlaps and tripwires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions import text as t
from evalgrid.operators import leaks
from evalgrid.plans import register
from evalgrid.plans.ctes import sql
from evalgrid.sources import bindings as b
from evalgrid.sources import files

S = SparkSession
GRAMS, WORDS = t.ngrams_sql("text", 6)
GRAM_SQL = f"SELECT DISTINCT {{id}} AS id, unnest({GRAMS}) AS gram FROM (SELECT {{id}}, {WORDS} AS w FROM {{table}})"
#: Labels that the sites show, names of themes, answers, and answers that only give a warning.
LABELS = ("licensed under the apache license, version 2.0", "released under the mit license")
THEMES = ("creative commons", "gnu general public")
ANSWERS, WARNED = ("apache license", "mit license"), ("all rights reserved",)
#: Benchmark items whose number is divisible by this are the scouted intents; the others are the test's.
SCOUTED = 5


def manuals(spark: S, d: str) -> DataFrame:
    """Documents as manuals: line i is section i mod 7 + 1 (the last of each counts), and the source tells the version."""
    lines = F.split(F.replace(F.col("text"), F.lit("## "), F.lit("")), "\n")
    manual = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("## "), (i % 7 + 1).cast("string"), F.lit("."), x)), "\n")
    version = F.concat(F.lit("v"), (F.regexp_extract("source", r"([0-9]+)$", 1).cast("long") % leaks.N_VERSIONS + 1).cast("string"))
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), manual.alias("text"), version.alias("version"), F.array(*map(F.lit, LABELS)).alias("labels"), "source", "n_chars")


def intents(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    items = b.table(spark, d, "benchmark").select(F.col("text").alias("intent"), (F.col("item_id") % SCOUTED == 0).alias("scouted"))
    return items.where("NOT scouted").select("intent"), items.where("scouted").select("intent")


def _leaks_sql() -> str:
    out = r"[^\p{L}\p{N}_]"
    double = lambda x: f"regexp_replace({x}, '({out})', '\\1\\1', 'g')"
    times = lambda text, p: f"len(regexp_extract_all({text}, '{p}'))"
    bare = "low"
    for label in LABELS:
        bare = f"replace({bare}, '{label}', ' ')"
    parts = []
    for rule, words in (("1-comparative", leaks.FORBIDDEN), ("4-performance", leaks.PERFORMANCE), ("5-neutral-era", leaks.NEUTRAL)):
        for w in words:
            p, on = leaks.pattern(w), f"WHERE version = '{leaks.NEUTRAL_VERSION}'" if rule[0] == "5" else ""
            parts.append(f"SELECT id, '{rule}' AS rule, 'hit' AS kind, '{w}' AS match, {times('bare', p)} AS n FROM doubled {on}")
            parts.append(f"SELECT id, '{rule}', 'waived', '{w}', {times('whole', p)} - {times('bare', p)} FROM doubled {on}")
    parts.append(f"SELECT id, '1-version-key', 'hit', 'v', {times('whole', leaks.pattern(leaks.VERSION_KEY, False))} FROM doubled")
    parts += [f"SELECT id, '1-theme-name', 'hit', '{x}', contains(low, '{x}')::BIGINT FROM lowered" for x in THEMES]
    parts.append(f"SELECT id, '2-year-in-affordance', 'hit', 'year', sum({times(double('body'), leaks.pattern(leaks.YEAR, False))})::BIGINT FROM bodies WHERE k <= 6 GROUP BY id")
    for rule, kind, strings in (("6-answer-leak", "hit", ANSWERS), ("6w-test-answer-coincidence", "warning", WARNED)):
        parts += [f"SELECT id, '{rule}', '{kind}', '{a}', (length(tidy) - length(replace(tidy, '{a}', ''))) // {len(a)} FROM lowered" for a in strings]
    return f"""WITH lowered AS (SELECT doc_id AS id, lower(text) AS low, 'v' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % {leaks.N_VERSIONS} + 1) AS version, regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS tidy FROM documents),
doubled AS (SELECT id, version, {double('low')} AS whole, {double(bare)} AS bare FROM lowered),
bodies AS (SELECT id, (i % 7 + 1)::INTEGER AS k, arg_max(line, i) AS body FROM (SELECT doc_id AS id, unnest(string_split(replace(text, '## ', ''), chr(10))) AS line, unnest(range(len(string_split(replace(text, '## ', ''), chr(10))))) AS i FROM documents) GROUP BY 1, 2),
theirs AS (SELECT DISTINCT text AS intent, unnest({GRAMS}) AS gram FROM (SELECT text, {WORDS} AS w FROM benchmark WHERE item_id % {SCOUTED} <> 0)),
mine AS (SELECT DISTINCT text AS intent, unnest({GRAMS}) AS gram FROM (SELECT text, {WORDS} AS w FROM benchmark WHERE item_id % {SCOUTED} = 0)),
grams AS ({GRAM_SQL.format(id='doc_id', table='documents')}),
outside AS (SELECT DISTINCT id, unnest({GRAMS}) AS gram FROM (SELECT id, {WORDS} AS w FROM (SELECT id, body AS text FROM bodies)))
SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0
UNION ALL SELECT id, '3-task-overlap', CASE WHEN explained THEN 'waived' ELSE 'hit' END, 'n-gram', count(*) FROM (SELECT id, intent, bool_and(gram IN (SELECT gram FROM mine)) AS explained FROM grams JOIN theirs USING (gram) GROUP BY 1, 2) GROUP BY ALL
UNION ALL SELECT id, '3b-scouted-outside-section8', 'hit', 'n-gram', count(DISTINCT intent) FROM outside JOIN mine USING (gram) GROUP BY 1"""


def checked(spark: S, d: str) -> DataFrame:
    return leaks.leak_check(manuals(spark, d), *intents(spark, d), THEMES, ANSWERS, WARNED)


@register("gate01_leak_check", _leaks_sql())
def gate01(spark: S, d: str) -> DataFrame:
    return checked(spark, d)


#: Variants of a manual: how long it may be, from where on it is warned about, and whether its sections of affordances count.
HARD, WARN = 6000, 8000


@register("gate02_gate_summary", f"""WITH found AS ({_leaks_sql()}), bad AS (SELECT DISTINCT id FROM found WHERE kind = 'hit')
  SELECT source, count(*) AS n, count(bad.id) AS leaking, count(*) FILTER (n_chars > {HARD}) AS too_long, count(*) FILTER (n_chars > {WARN}) AS warned, bool_and(bad.id IS NULL AND n_chars <= {HARD}) AS pass, (SELECT count(DISTINCT rule) FROM found WHERE kind = 'hit') AS rules_fired
  FROM documents LEFT JOIN bad ON bad.id = doc_id GROUP BY 1""")
def gate02(spark: S, d: str) -> DataFrame:
    """The gate by source: manuals that leak, are too long or pass; planted manuals that must fail are in the tests."""
    found = files.kept(checked(spark, d).where("kind = 'hit'"), "hits")
    bad = found.select("id").distinct().withColumn("leak", F.lit(True))
    m = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars").join(bad, "id", "left").withColumn("leak", F.coalesce("leak", F.lit(False)))
    out = m.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("leak").alias("leaking"), F.count_if(F.col("n_chars") > HARD).alias("too_long"), F.count_if(F.col("n_chars") > WARN).alias("warned"),
        F.bool_and(~F.col("leak") & (F.col("n_chars") <= HARD)).alias("pass"))
    return out.crossJoin(found.agg(F.count_distinct("rule").alias("rules_fired")))


@register("jn12_intent_overlap", f"SELECT id AS doc_id, count(DISTINCT gram) AS shared FROM ({GRAM_SQL.format(id='doc_id', table='documents')}) WHERE gram IN (SELECT gram FROM ({GRAM_SQL.format(id='item_id', table='benchmark')})) GROUP BY 1")
def jn12(spark: S, d: str) -> DataFrame:
    theirs = leaks.grams_table(b.table(spark, d, "benchmark"), "item_id", "text")
    return leaks.shared_grams(b.table(spark, d, "documents"), "doc_id", F.col("text"), theirs).groupBy("doc_id").agg(F.count_distinct("gram").alias("shared"))


@register("jn13_leak_tripwires", sql(f"""SELECT arm, count(*) FILTER (split = 'test') AS test, count(*) FILTER (list_contains(sites, held_out) OR (held_out = 'multi' AND grp = 'multi')) AS held_out, count(*) FILTER (held_out IS NOT NULL AND NOT list_has_all(seen, sites)) AS wrong_group,
    count(*) FILTER (task_id > {b.N_TASKS}) AS unknown, count(DISTINCT unit) FILTER (split = 'train' AND unit IN (SELECT unit FROM (SELECT DISTINCT unit, arm AS other FROM units WHERE split = 'test') t WHERE other = arm)) AS shared_units
  FROM (SELECT *, era * 10 + seed AS unit FROM evals) e JOIN arms USING (arm) WHERE reward >= 1 GROUP BY arm""", "evals", "arms", more={"units": "SELECT arm, split, era * 10 + seed AS unit FROM evals WHERE reward >= 1"}))
def jn13(spark: S, d: str) -> DataFrame:
    """Records of an arm's corpus that mustn't be there, and units (era, seed) on both the training and the evaluation side."""
    dim = F.broadcast(b.arms(spark).select("arm", F.col("held_out").alias("held"), "seen"))
    e = b.eval_records(spark, d).where("reward >= 1").withColumn("unit", F.col("era") * 10 + F.col("seed")).join(dim, "arm")
    both = e.groupBy("arm", "unit").agg(F.max((F.col("split") == "train").cast("int")).alias("a"), F.max((F.col("split") == "test").cast("int")).alias("z")).groupBy("arm").agg(F.count_if((F.col("a") == 1) & (F.col("z") == 1)).alias("shared_units"))
    held = F.array_contains("sites", F.col("held")) | ((F.col("held") == "multi") & (F.col("grp") == "multi"))
    wrong = F.col("held").isNotNull() & (F.size(F.array_except("sites", "seen")) > 0)
    counts = e.groupBy("arm").agg(F.count_if(F.col("split") == "test").alias("test"), F.count_if(held).alias("held_out"), F.count_if(wrong).alias("wrong_group"), F.count_if(F.col("task_id") > b.N_TASKS).alias("unknown"))
    return counts.join(both, "arm")


def require_clean(tripwires: DataFrame) -> None:
    """Raises ValueError if any tripwire of ``jn13`` has caught something."""
    caught = tripwires.where("test + held_out + wrong_group + unknown + shared_units > 0").select("arm").collect()  # a row an arm
    if caught:
        raise ValueError(f"leaks in {sorted(r['arm'] for r in caught)}")


@register("gate04_leaky_own_answers", r"""SELECT conv_id, count(*) FILTER (contains(recipe, answer)) AS leaky, count(*) AS n FROM (
    SELECT a.conv_id, lower(CASE WHEN regexp_matches(a.text, '[.!?] [^.!?]*[.!?]?$') THEN regexp_replace(a.text, ' [^.!?]*[.!?]?$', '') ELSE a.text END) AS recipe, u.answer FROM conversations a JOIN (
      SELECT conv_id, lower(regexp_extract(arg_max(text, turn), '([A-Za-z]{4,})[.!?]?$', 1)) AS answer FROM conversations WHERE role = 'user' GROUP BY 1) u USING (conv_id) WHERE a.role = 'assistant') WHERE answer <> '' GROUP BY 1""")
def gate04(spark: S, d: str) -> DataFrame:
    """Recipes (an assistant's turns without their answering sentence) that still hold their conversation's own answer: the last word that its user says."""
    c = b.table(spark, d, "conversations")
    answer = F.lower(F.regexp_extract(F.max_by("text", "turn"), r"([A-Za-z]{4,})[.!?]?$", 1)).alias("answer")
    answers = c.where("role = 'user'").groupBy("conv_id").agg(answer).where("answer <> ''")
    cut = F.when(F.rlike("text", F.lit(r"[.!?] [^.!?]*[.!?]?$")), F.regexp_replace("text", r"(?<=[.!?]) [^.!?]*[.!?]?$", "")).otherwise(F.col("text"))
    recipes = c.where("role = 'assistant'").select("conv_id", F.lower(cut).alias("recipe")).join(answers, "conv_id")
    return recipes.groupBy("conv_id").agg(F.count_if(F.contains("recipe", F.col("answer"))).alias("leaky"), F.count("*").alias("n"))

