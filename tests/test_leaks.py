"""The leak gate's rules on planted manuals."""

import pytest

from evalgrid.operators import leaks

INTENT = "List all articles from the Related Pages sections of the Biophysics page"
SCOUTED = "Find the opening hours of the town library near the old harbour"
BASE = "# Site manual: wiki\n## 1. Navigation\nA left-hand column of links leads to recent changes.\n## 7. Style\nPlain pages.\n"


def rules(spark, text, version="v2", labels=(), **more):
    m = spark.createDataFrame([("m", text, version, list(labels))], "id string, text string, version string, labels array<string>")
    one = lambda x: spark.createDataFrame([(x,)], "intent string")
    return {(r["rule"], r["kind"], r["match"]): r["n"] for r in leaks.leak_check(m, one(INTENT), one(SCOUTED), **more).collect()}


@pytest.mark.parametrize(
    ("text", "version", "labels", "want"),
    [
        (BASE, "v2", (), {}),
        (BASE.replace("A left-hand", "This is V3. A left-hand"), "v2", (), {("1-version-key", "hit", "v"): 1}),
        (BASE.replace("A left-hand", "Built in 2005, 2005. A left-hand"), "v2", (), {("2-year-in-affordance", "hit", "year"): 2}),
        (BASE.replace("Plain", "In 2005 plain"), "v2", (), {}),
        (BASE + INTENT, "v2", (), {("3-task-overlap", "hit", "n-gram"): 1}),
        (BASE.replace("A left-hand", SCOUTED + ". A left-hand"), "v2", (), {("3b-scouted-outside-section8", "hit", "n-gram"): 1}),
        (BASE + "## 8. Worked examples\n" + SCOUTED, "v2", (), {}),
        (BASE.replace("A left-hand", "A modern, modern left-hand"), "v2", (), {("1-comparative", "hit", "modern"): 2}),
        (BASE.replace("A left-hand", "The agent's left-hand"), "v2", (), {("4-performance", "hit", "agent"): 1}),
        (BASE.replace("A left-hand", "The newest left-hand"), "v6", (), {("1-comparative", "hit", "newest"): 1, ("5-neutral-era", "hit", "newest"): 1}),
        (BASE.replace("A left-hand", "Printable version. A left-hand"), "v2", (), {("1-comparative", "hit", "version"): 1}),
        (BASE.replace("A left-hand", "Printable version. A left-hand"), "v2", ("printable version",), {("1-comparative", "waived", "version"): 1}),
        (BASE.replace("A left-hand", "Generational aversion éera left-hand"), "v2", (), {}),
    ],
)
def test_planted_manuals(spark, text, version, labels, want):
    assert rules(spark, text, version, labels) == want


def test_themes_answers_and_warnings(spark):
    text = BASE.replace("A left-hand", "Nimbus  Dark shows Marie Curie and the rad. A left-hand")
    got = rules(spark, text, labels=["marie curie"], themes=("nimbus  dark",), answers=("Marie  Curie", "rad"), warned=("recent changes",))
    assert got == {("1-theme-name", "hit", "nimbus  dark"): 1, ("6-answer-leak", "hit", "marie curie"): 1, ("6w-test-answer-coincidence", "warning", "recent changes"): 1}


def test_overlap_that_a_scouted_intent_explains_is_waived(spark):
    m = spark.createDataFrame([(1, INTENT, "v1", []), (2, None, "v1", [])], "id long, text string, version string, labels array<string>")
    one = lambda x: spark.createDataFrame([(x,)], "intent string")
    got = {(r["id"], r["rule"], r["kind"]) for r in leaks.leak_check(m, one(INTENT), one(INTENT.replace("Biophysics", "Botany"))).collect()}
    assert got == {(1, "3-task-overlap", "hit")}
    whole = {(r["id"], r["rule"], r["kind"]) for r in leaks.leak_check(m, one(INTENT), one(INTENT)).collect()}
    assert whole == {(1, "3-task-overlap", "waived")}


def test_known_ngrams_go_out_in_parts(spark, monkeypatch):
    d = spark.createDataFrame([(1, INTENT), (2, SCOUTED), (3, None), (4, "")], "id long, text string")
    known = leaks.grams_table(d.where("id < 3"), "id", "text")
    want = {(r["id"], r["gram"]) for r in known.collect()}
    monkeypatch.setattr(leaks, "MOST_GRAMS", 3)
    assert {(r["id"], r["gram"]) for r in leaks.shared_grams(d, "id", d["text"], known).collect()} == want
