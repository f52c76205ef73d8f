"""Queries over recipes and their answers, and manuals rebuilt from their sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions import text as t
from evalgrid.operators import leaks, recipes
from evalgrid.plans import register
from evalgrid.plans.leaks import ANSWERS, THEMES, WARNED, intents, manuals
from evalgrid.sources import bindings as b
from evalgrid.sources import files

S = SparkSession
#: The question that the second shape's fuzzy answer only says again.
ASKED = "Tell me what is the event type of this user now"


def evaluations(spark: S, d: str) -> DataFrame:
    """``event_id, intent, eval``: each event as a task whose evaluation comes in one of six shapes, one of them a string of JSON and one no JSON."""
    k = F.get_json_object("props", "$.k")
    ref = lambda **kw: F.to_json(F.struct(F.struct(*[v.alias(n) for n, v in kw.items()]).alias("reference_answers")))
    say = lambda s: F.concat(F.lit(s), k)
    mixed = F.concat(F.lit('{"reference_answers": {"list_match": {"items": [["'), F.col("event_type"), F.lit('", "'), say("alt "), F.lit('"], "'), say("single "), F.lit('", null]}}}'))
    twice = F.concat(F.lit('"'), F.replace(ref(fuzzy_match=F.lit("what is the event type of this user"), exact_match=F.array(say("first "), F.lit("yes"))), F.lit('"'), F.lit('\\"')), F.lit('"'))
    shapes = [
        ref(must_include=F.array(say("key-"), F.lit("no")), must_exclude=F.array(F.lit("never said"))), mixed, twice, ref(exact_match=say("only ")),
        ref(number_match=F.struct(F.lit(12345).alias("value"), F.array(k.cast("long") + 1000, F.lit(7)).alias("values"))), F.lit("not { json"),
    ]
    shape = F.element_at(F.array(*shapes), (F.col("event_id") % 6 + 1).cast("int"))
    return b.table(spark, d, "events").select("event_id", F.lit(ASKED).alias("intent"), shape.alias("eval"))


@register("fn07_decoded_answers", """SELECT event_id, array_to_string(list_filter(CASE event_id % 6 WHEN 0 THEN ['key-' || k] WHEN 1 THEN [event_type, 'alt ' || k, 'single ' || k] WHEN 2 THEN ['first ' || k] WHEN 3 THEN ['only ' || k] WHEN 4 THEN ['12345', (k::BIGINT + 1000)::VARCHAR] ELSE [] END, lambda x: length(x) >= 4), '|') AS answers
  FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)""")
def fn07_decoded(spark: S, d: str) -> DataFrame:
    """The answers of every task, whatever its evaluation holds them in."""
    return evaluations(spark, d).select("event_id", F.array_join(recipes.answers(F.col("eval"), F.col("intent")), "|").alias("answers"))


def scouted(spark: S, d: str) -> DataFrame:
    """``doc_id, source, recipe, eval``: each document's lines as numbered steps, closed by a step that hands over the answer, a word of the document.

    By doc_id the last step also says the answer in plain words, only hands it over, or does neither.
    """
    docs = b.table(spark, d, "documents").select("doc_id", "source", "text")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), 0)
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    p = docs.withColumn("answer", F.get(words, F.least(F.lit(7), F.size(words)) - 1)).withColumn("lines", lines)
    hand = F.concat(F.lit('Send a message to the user: "'), F.coalesce("answer", F.lit("")), F.lit('".'))
    last = F.element_at(F.array(F.lit("Stop here"), F.concat(F.lit("Conclude that "), F.coalesce("answer", F.lit("it")), F.lit(" is right. "), hand), hand), (F.col("doc_id") % 3 + 1).cast("int"))
    steps = F.concat(F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), F.array(F.concat((F.size("lines") + 1).cast("string"), F.lit(". "), last)))
    answers = F.to_json(F.struct(F.struct(F.filter(F.array("answer"), lambda a: a.isNotNull()).alias("must_include")).alias("reference_answers")))
    return p.select("doc_id", "source", F.array_join(steps, "\n").alias("recipe"), answers.alias("eval"))


TIDY = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'), ' ')"
#: Of each document: its answer, its lines, and up to which of them its stripped recipe goes.
STRIPPED = rf"""SELECT doc_id, source, answer, regexp_replace(CASE WHEN doc_id % 3 = 1 AND answer IS NULL THEN array_to_string(steps, chr(10)) || chr(10) || (len(steps) + 1) || '. Conclude that it is right.' WHEN doc_id % 3 = 2 OR answer IS NULL THEN array_to_string(steps, chr(10))
      ELSE array_to_string(steps[1:coalesce(list_max([i FOR i IN range(1, len(steps) + 1) IF NOT contains({TIDY.format('steps[i]')}, lower(answer))]), 0)], chr(10)) END, '\s+$', '') AS recipe FROM (
    SELECT doc_id, source, answer, [i || '. ' || lines[i] FOR i IN range(1, len(lines) + 1)] AS steps FROM (
      SELECT doc_id, source, w[least(7, len(w))] AS answer, lines FROM (SELECT doc_id, source, regexp_extract_all(text, '[A-Za-z]{{5,}}') AS w, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM documents)))"""


@register("fn06_strip_answer_steps", f"SELECT doc_id, length(recipe) AS n_chars, sha1(recipe) AS recipe FROM ({STRIPPED})")
def fn06_steps(spark: S, d: str) -> DataFrame:
    """Recipes without what gives their answer away: a closing sentence, the last step, or that and the steps before it that say the answer as well."""
    cut = recipes.stripped(F.col("recipe"), recipes.answers(F.col("eval"), F.lit(None).cast("string")))
    return scouted(spark, d).select("doc_id", cut.alias("r")).select("doc_id", F.length("r").cast("long").alias("n_chars"), F.sha1(F.col("r").cast("binary")).alias("recipe"))


@register("gate04_unstrippable_answers", f"SELECT source, count(*) AS n, count(*) FILTER (answer IS NOT NULL AND contains({TIDY.format('recipe')}, lower(answer))) AS leaky FROM ({STRIPPED}) GROUP BY 1")
def gate04_recipes(spark: S, d: str) -> DataFrame:
    """Tasks whose recipe holds an own answer even when it is stripped, as the answer is also a word that an earlier step needs; by source."""
    own = scouted(spark, d).select("source", "recipe", recipes.answers(F.col("eval"), F.lit(None).cast("string")).alias("a"))
    leaky = recipes.leaks(recipes.stripped(F.col("recipe"), F.col("a")), F.col("a"))
    return own.groupBy("source").agg(F.count("*").alias("n"), F.count_if(leaky).alias("leaky"))


def _manual_sql(keep: tuple[int, ...]) -> str:
    parts = [f"chr(10) || '## {k}. {recipes.HEADINGS[k - 1]}' || chr(10) || coalesce(nullif(bodies[{k}], ''), '{recipes.FILLER}')" for k in keep]
    return "sha1('# Site manual: ' || source || " + " || ".join(parts) + " || chr(10))"


@register("fn03_rebuilt_manuals", f"""SELECT doc_id, {', '.join(f'{_manual_sql(keep)} AS {name}' for name, keep in recipes.VARIANTS.items())} FROM (SELECT doc_id, source, [list_last([trim(lines[i], ' ') FOR i IN range(1, len(lines) + 1) IF (i - 1) % 9 = k - 1]) FOR k IN range(1, 8)] AS bodies
  FROM (SELECT doc_id, source, string_split(replace(text, '## ', ''), chr(10)) AS lines FROM documents))""")
def fn03_rebuilt(spark: S, d: str) -> DataFrame:
    """Manuals in the exact schema, whole and in their variants: of sections that come twice the last counts, unknown ones fall out, missing ones are filled."""
    lines = F.split(F.replace(F.col("text"), F.lit("## "), F.lit("")), "\n")
    raw = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("## "), (i % 9 + 1).cast("string"), F.lit("."), x)), "\n")
    m = b.table(spark, d, "documents").select("doc_id", "source", t.sections(raw).alias("s"))
    return m.select("doc_id", *[F.sha1(recipes.manual(F.col("s"), F.col("source"), keep).cast("binary")).alias(name) for name, keep in recipes.VARIANTS.items()])


#: Characters that a manual may have, and from which on a full one is warned about.
HARD, WARN = 6000, 8000


def gated(manuals: DataFrame, intents: DataFrame, scouted_: DataFrame, **rules) -> DataFrame:
    """``id, variant, n_chars, hits, waived, too_long, warned, pass``: every manual in each of its variants, through the leak check and the limits of size.

    ``manuals`` has ``id, site, sections (a map by number), version, labels``. Years count only where a variant has sections of affordances.
    """
    out = None
    for name, keep in recipes.VARIANTS.items():
        m = files.kept(manuals.withColumn("text", recipes.manual(F.col("sections"), F.col("site"), keep)), f"manuals-{name}")
        found = leaks.leak_check(m, intents, scouted_, affordances=1 in keep, **rules).groupBy("id").agg(F.sum(F.when(F.col("kind") == "hit", F.col("n")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("kind") == "waived", F.col("n")).otherwise(0)).alias("waived"))
        size = F.length("text").cast("long")
        own = m.select("id", F.lit(name).alias("variant"), size.alias("n_chars")).join(found, "id", "left").fillna(0, ["hits", "waived"])
        own = own.withColumn("too_long", F.col("n_chars") > HARD).withColumn("warned", (F.col("n_chars") > WARN) & F.lit(name == "full"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("pass", (F.col("hits") == 0) & ~F.col("too_long"))


#: Controls that the gate must catch, by the site that they are for: what is planted in their first section (None: an intent), and in which variants it is caught.
PLANTED = {"no-plant": ("", ()), "key-plant": ("This is v3. ", ("full", "affordance")), "year-plant": ("Built in 2005. ", ("full", "affordance")), "task-plant": (None, ("full", "affordance"))}


def planted(spark: S, intent: str) -> DataFrame:
    """The controls as manuals, with a section on what can be done and one on looks."""
    rows = [(-k, name, {1: (intent + ". " if text is None else text) + "A column of links leads to the main page.", 7: "Plain and blue."}, "v1", []) for k, (name, (text, _)) in enumerate(PLANTED.items(), 1)]
    return spark.createDataFrame(rows, "id long, site string, sections map<int,string>, version string, labels array<string>")


@register("gate02_variant_gate")
def gate02_variants(spark: S, d: str) -> DataFrame:
    """Manuals of all documents and the planted controls through the gate in three variants: by source and variant, how many leak, are too long and pass."""
    mine, theirs = intents(spark, d)
    m = manuals(spark, d).select("id", F.col("source").alias("site"), t.sections(F.col("text")).alias("sections"), "version", "labels")
    first = mine.where(F.size(F.split("intent", " ")) > 8).orderBy("intent").first()
    whole = m.unionByName(planted(spark, first["intent"] if first else "")) if first else m
    g = gated(whole, mine, theirs, themes=THEMES, answers=ANSWERS, warned=WARNED).join(whole.select("id", "site"), "id")
    count = lambda c: F.count_if(F.col(c)).alias(c)
    return g.groupBy(F.col("site").alias("source"), "variant").agg(F.count("*").alias("n"), F.count_if(F.col("hits") > 0).alias("leaking"), F.sum("waived").alias("waived"), count("too_long"), count("warned"), F.bool_and("pass").alias("pass"))
