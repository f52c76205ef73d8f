"""Recipes, answers and manuals on planted cases."""

import json

import pytest
from pyspark.sql import functions as F

from evalgrid.functions import text as t
from evalgrid.operators import recipes

HAND = 'Send a message to the user: "Physics".'
CASES = [
    # recipe, answers, what is left
    ("", ["Physics"], ""),
    ("No steps here. ", ["Physics"], "No steps here."),
    (f"1. Open it.\n2. Read. {HAND}", [], "1. Open it.\n2. Read."),
    (f"1. Open it.\n2. {HAND}", [], "1. Open it."),
    ("1. Open it.\n2. Answer as it fits.", [], "1. Open it."),
    (f"1. Open it.\n2. Read. {HAND}", ["Physics"], "1. Open it.\n2. Read."),
    (f"1. Open it.\n2. Conclude that only PHYSICS fits. {HAND}", ["Physics"], "1. Open it."),
    (f"Intro\n1. Open it.\n2. See physics  there.\n3. It is Physics.\n4. Say Physics. {HAND}", ["Physics"], "Intro\n1. Open it."),
    (f"1. Type Physics.\n2. Open it.\n3. Say Physics. {HAND}", ["Physics"], "1. Type Physics.\n2. Open it."),
    (f"1. See Physics.\n2. {HAND} Or reply Physics.", ["Physics"], ""),
    (f"1. Open it.\n2. Say yes. {HAND}", ["yes"], "1. Open it.\n2. Say yes."),
    (f"1. A.\n\n2. Read. {HAND}", ["Physics"], "1. A.\n\n2. Read."),
    (f"{'1. ' + HAND}", ["Physics"], ""),
]


def test_stripped_recipes(spark):
    rows = spark.createDataFrame([(i, r, a) for i, (r, a, _) in enumerate(CASES)] + [(99, None, ["x"])], "i int, r string, a array<string>")
    got = {x["i"]: x["s"] for x in rows.select("i", recipes.stripped(F.col("r"), F.col("a")).alias("s")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)} | {99: None}


@pytest.mark.parametrize(
    "answer, want",
    [
        ({"must_include": ["long one", "no", 12345], "must_exclude": ["wrong answer"]}, ["long one", "12345"]),
        ({"must_include": "not a list"}, []),
        ({"list_match": {"items": [["first", "other"], "third", None, 7, 70000]}}, ["first", "other", "third", "70000"]),
        ({"list_match": {"items": None}, "fuzzy_match": "quite so"}, ["quite so"]),
        ({"exact_match": ["four", "yes"], "fuzzy_match": None}, ["four"]),
        ({"exact_match": "single"}, ["single"]),
        ({"number_match": {"value": 1234, "values": [5, 56789]}}, ["1234", "56789"]),
        ({"fuzzy_match": "where is the nearest open shop"}, []),
        ({"fuzzy_match": "nearest open shop"}, ["nearest open shop"]),
        ({}, []),
    ],
)
def test_answers_of_every_container(spark, answer, want):
    whole = json.dumps({"reference_answers": answer})
    rows = spark.createDataFrame([(0, whole), (1, json.dumps(whole)), (2, "no { json"), (3, None), (4, json.dumps({"reference_answers": "text"})), (5, "[1]")], "i int, e string")
    got = {r["i"]: r["a"] for r in rows.select("i", recipes.answers(F.col("e"), F.lit("Tell me  WHERE is the nearest open shop?")).alias("a")).collect()}
    assert got == {0: want, 1: want, 2: [], 3: [], 4: [], 5: []}


def test_rebuilt_manuals(spark):
    text = "# Old title\n## 9. Unknown\nx\n## 3. Page anatomy\nfirst\n## 1. Purpose\n way in \n## 3. Again\nsecond\n## 7. Look\nblue"
    s = spark.createDataFrame([(text,), ("",)], "text string").select(t.sections(F.col("text")).alias("s"))
    full, style = s.select(recipes.manual(F.col("s"), F.lit("wiki")).alias("f"), recipes.manual(F.col("s"), F.lit("wiki"), recipes.VARIANTS["style"]).alias("v")).first()
    assert full.startswith("# Site manual: wiki\n## 1. Purpose and top-level navigation\n") and full.count("## ") == 7 and full.count(recipes.FILLER) == 4 and "first" not in full and "9" not in full
    assert style.startswith("# Site manual: wiki\n## 7. Visual style\n") and style.count("## ") == 1


def test_planted_controls_of_the_gate(spark):
    from evalgrid.plans import recipes as plans

    intent = "List all articles from the Related Pages sections of the Biophysics and Biochemistry pages"
    intents = spark.createDataFrame([(intent,)], "intent string")
    controls = plans.planted(spark, intent)
    long = spark.createDataFrame([(5, "long", {1: "word " * 1500, 7: "blue"}, "v1", [])], controls.schema)
    got = {(r["site"], r["variant"]): r for r in plans.gated(controls.unionByName(long), intents, intents.limit(0)).join(controls.unionByName(long).select("id", "site"), "id").collect()}
    assert len(got) == 15
    for name, (_, caught) in plans.PLANTED.items():
        assert {v for v in recipes.VARIANTS if got[name, v]["hits"] > 0} == set(caught)
    assert not got["long", "full"]["pass"] and got["long", "full"]["too_long"] and not got["long", "full"]["warned"] and got["long", "style"]["pass"]


def test_banks_that_disagree(spark):
    from evalgrid.plans import texts

    rows = [(s, b, 4 + (s == 2 and b == 1), 2.0 + (s == 3 and b == 0), "base" + "x" * (s == 4 and b == 2)) for s in range(1, 6) for b in range(3) if (s, b) != (5, 1)]
    found = texts.consistent(spark.createDataFrame(rows, "site int, bank int, rank int, scaling double, base string"), 3)
    assert {r["site"]: r["status"] for r in found.collect()} == {1: "ok", 2: "rank", 3: "scaling", 4: "base", 5: "missing"}
    texts.require_consistent(found.where("site = 1"))
    with pytest.raises(ValueError, match="missing"):
        texts.require_consistent(found)


def test_signals_of_collapse():
    from evalgrid.plans.vectors import collapse

    assert [collapse(*x) for x in ((0.5, 0.9), (0.05, 0.9), (0.5, 0.1), (0.05, 0.1))] == ["none", "variance", "rank", "both"]


def test_conditioning_by_precedence(spark):
    from evalgrid.plans import vectors

    rows = spark.createDataFrame([(1, 0, [2.0] * 64), (2, 0, None), (3, 1, None), (4, 2, None)], "id int, label int, own array<double>")
    stored = spark.createDataFrame([(0, [3.0] * 64)], "label int, m array<double>")
    got = {r["id"]: (r["kind"], r["x"]) for r in vectors.conditioned(rows, stored, F.col("label") < 1, F.col("label") < 2).collect()}
    assert {k: x[0] for k, x in got.items()} == {1: "sample", 2: "stored", 3: "constant", 4: "hash"}
    assert got[1][1][0] == 2.0 and got[2][1][0] == 3.0 and abs(sum(x * x for x in got[3][1]) - 1) < 1e-9 and len(set(got[4][1])) > 60
    with pytest.raises(Exception, match="no stored vector"):
        vectors.conditioned(rows, stored, F.col("label") < 2, F.col("label") < 2).collect()
