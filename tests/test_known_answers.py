"""Known answers, planted faults and errors that must be raised."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.functions import text as t
from evalgrid.functions.rng import draw
from evalgrid.operators import evals, graphs, sinks, vectors
from evalgrid.operators.resampling import sign_flips
from evalgrid.streaming import retries
from tests.parity import DATA


def test_single_record_has_no_standard_error(spark):
    df = spark.createDataFrame([("a", 1.0, 5, False, False), ("b", 0.0, 3, True, False), ("b", 1.0, 9, True, True)], "g string, reward double, n_steps int, terminated boolean, err boolean")
    got = {r["g"]: r for r in evals.aggregate(df, ["g"]).collect()}
    assert got["a"]["std_err"] == 0.0 and got["a"]["conditional_success"] is None
    assert got["b"]["std_err"] == 0.5 and got["b"]["success_rate"] == 0.5 and got["b"]["n_err"] == 1


def test_latest_wins_and_counts_attempts(spark):
    df = spark.createDataFrame([("k", 1, "x", 0.0), ("k", 2, "y", 1.0), ("m", 1, "z", 0.0)], "key string, trial int, dir string, reward double")
    got = {r["key"]: (r["reward"], r["n_attempts"]) for r in evals.latest(df, ["key"], [F.col("trial")], "dir").collect()}
    assert got == {"k": (1.0, 2), "m": (0.0, 1)}


def test_sign_flip_of_eighteen_equal_units_is_significant(spark):
    units = spark.range(18).select(F.col("id").alias("u"), F.lit(0.4).alias("d"))
    row = sign_flips(units, "u", "d", 500, "s").first()
    assert row["n_units"] == 18 and row["p_two"] < 0.01


def test_sign_flip_of_one_unit_is_skipped(spark):
    assert sign_flips(spark.range(1).select(F.col("id").alias("u"), F.lit(0.4).alias("d")), "u", "d", 20, "s").first()["p_two"] is None


def test_draw_depends_on_all_parts(spark):
    a, b = spark.range(1).select(draw("s", "id", F.lit(1)), draw("s", "id", F.lit(2))).first()
    assert 0 <= a < 2**32 and a != b


def test_last_duplicate_section_wins(spark):
    got = spark.createDataFrame([("x\n## 1. a\n## 2. b\n## 1. c",)], "m string").select(t.sections(F.col("m"))).first()[0]
    assert got == {1: "c", 2: "b"}


def test_ngrams_are_a_set_and_short_texts_have_none(spark):
    got = spark.createDataFrame([("a b a b a b",), ("a",), ("",)], "x string").select(t.ngrams(F.col("x"), 2)).collect()
    assert [sorted(r[0]) for r in got] == [["a b", "b a"], [], []]


def test_crawl_keeps_budgets_and_visits_once(spark):
    edges = spark.createDataFrame([(1, 3, 0), (1, 2, 1), (2, 3, 0), (3, 4, 0), (3, 6, 1), (2, 5, 0), (4, 5, 0), (5, 1, 0)], "src long, dst long, ord int")
    roots = spark.createDataFrame([("h", 1)], "host string, node long")
    walk = lambda depth, pages: [(r["node"], r["depth"]) for r in graphs.crawl(roots, edges, depth, pages).orderBy("place").collect()]
    assert walk(2, 9) == [(1, 0), (3, 1), (2, 1), (4, 2), (6, 2), (5, 2)]  # in the order of links, and of the pages that hold them
    assert walk(3, 2) == [(1, 0), (3, 1)]
    assert walk(3, 4) == [(1, 0), (3, 1), (2, 1), (4, 2)]


def test_references_resolve_as_the_library_does(spark):
    from urllib.parse import urljoin, urlsplit

    from evalgrid.functions import urls

    bases = ["http://h.org/a/b?x=1#f", "https://h.org", "http://h.org:81/abc/", "http://h.org/?q"]
    refs = ["/x", "x/y", "../z", "./w?k=2", "?n=3", "#top", "", "//h.org/p", "http://h.org/q#z", "//other.org/p", "https://other.org/", "mailto:a@b", "javascript:void(0)", "../../../up", "a/./b/../c", ".."]
    rows = [(u, x) for x in bases for u in refs]
    got = spark.createDataFrame(rows, "u string, b string").select("u", "b", urls.site_path(F.col("u"), F.col("b")).alias("p")).collect()
    for r in got:
        u, base = urlsplit(urljoin(r["b"], r["u"])), urlsplit(r["b"])
        off = u.scheme not in ("http", "https") or u.netloc != base.netloc
        assert r["p"] == (None if off else (u.path or "/") + (f"?{u.query}" if u.query else "")), tuple(r)


def test_upsert_refuses_to_clobber(spark):
    old, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    with pytest.raises(ValueError):
        sinks.upsert(old, new, "k")
    assert sorted(map(tuple, sinks.upsert(old, new, "k", force=True).collect())) == [("a", 2), ("b", 3)]


def test_append_reports_dropped_columns(spark, tmp_path):
    path = str(tmp_path / "findings")
    df = spark.createDataFrame([("a", 1, 2)], "k string, v int, extra int")
    assert sinks.append_rows(df, path, ["k", "v"]) == ["extra"]
    assert spark.read.parquet(path).columns == ["k", "v"]


def test_linkage_joins_tight_groups_first():
    x = np.array([[0, 0], [0, 1], [1, 0], [9, 9], [9, 10], [10, 9.0]])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    merges = vectors.merge_order(list("abcdef"), d)
    assert len(merges) == 5 and merges[-1][3] == 6 and {m[3] for m in merges[:4]} == {2, 3}


def test_hull_distance_of_vertices_edges_and_outside():
    bank = np.array([[0, 0], [2, 0], [0, 2.0]])
    assert vectors.hull_distance(bank, np.array([0, 2.0])) == pytest.approx(0, abs=1e-9)
    assert vectors.hull_distance(bank, np.array([0.5, 0.5])) == pytest.approx(0, abs=1e-9)
    assert vectors.hull_distance(bank, np.array([2, 2.0])) == pytest.approx(np.sqrt(2))


def test_streamed_counts_equal_batch_counts(spark):
    q = retries.hourly(retries.events(spark, DATA)).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    try:
        q.processAllAvailable()
        streamed = sorted(map(tuple, spark.sql("SELECT hour, event_type, n FROM hourly").collect()))
    finally:
        q.stop()
    assert streamed == sorted(map(tuple, retries.hourly(spark.read.parquet(f"{DATA}/events.parquet")).select("hour", "event_type", "n").collect()))


def test_streamed_dedup_keeps_each_key_once_a_day(spark):
    q = retries.first_of_each_key(retries.events(spark, DATA)).writeStream.outputMode("append").format("memory").queryName("firsts").start()
    try:
        q.processAllAvailable()
        keys = [(r["user_id"], r["event_type"]) for r in spark.sql("SELECT user_id, event_type FROM firsts").collect()]
    finally:
        q.stop()
    assert keys and len(keys) == len(set(keys))


def test_style_sheets_are_counted_by_declaration(spark):
    from evalgrid.functions import styles
    from evalgrid.plans import sites

    css = """/* p{float:left} */ :root{--main: #FFF; } @media (max-width: 9px) { a{ color:#0a0; background: rgb(1,2,3) } }
    h1 { font-family: 'Open Sans', serif; font-size: 1.5em; display:flex; width: 50%; max-width: 900px; border-radius:3px }
    .x{position:sticky;transition:all 1s;-webkit-box-shadow:0 0 3px #336699;color:hsl(1,2%,3%)!important;grid-area:a}"""
    df = spark.createDataFrame([(1, f"<html><STYLE type='a'>{css}</style>"), (2, "<p>none")], "k int, html string")
    ds = df.select("k", styles.sheet(F.col("html")).alias("css")).withColumn("ds", styles.declarations(F.col("css")))
    rows = {r["k"]: (r["c"], r["f"]) for r in ds.select("k", styles.counters("ds").alias("c"), styles.families("ds").alias("f")).collect()}
    assert rows[1] == ("border_radius=1 fixed_px_width=1 flex=1 fluid_unit=1 grid=1 hex=1 hsl=1 important=1 pos_fixed=1 rgb=1 shadow=1 transition=1 unit_em=1 vendor=1".replace("fluid_unit=1", "fluid_unit=2"), "open sans")
    assert rows[2] == ("", "")
    got = {(r["hex"], r["hue"], r["saturation"], r["lightness"]) for r in sites.colours(ds, "k", "css").collect()}
    assert got == {("ffffff", 0.0, 0.0, 1.0), ("00aa00", 120.0, 1.0, 0.333333), ("336699", 210.0, 0.5, 0.4)}


def test_blocks_go_before_the_observation_or_fail(spark):
    from evalgrid.plans import texts

    put = lambda prompt: spark.createDataFrame([(prompt,)], "p string").select(texts.injected(F.col("p"), F.lit("# Site manual\nx"))).first()[0]
    assert put("a\n## Extra instructions:\n\nb\n\n# Observation\nc") == "a\n## Extra instructions:\n\nb\n# Site manual\nx\n# Observation\nc"
    for bad in ("no heading\n\n# Observation", "## Extra instructions: none", "## Extra instructions:\n# Site manual\n\n# Observation"):
        with pytest.raises(Exception, match="prompt|observation|instructions"):
            put(bad)


def test_unknown_and_empty_sites_are_refused(spark):
    from evalgrid.plans import records

    key = lambda sites: spark.createDataFrame([(sites,)], "s array<string>").select(records.site_key("s")).first()[0]
    assert key([" SHOP", "wiki "]) == "wiki+shop"
    for bad in (["wiki", "blog"], [], None):
        with pytest.raises(Exception, match="no such sites"):
            key(bad)


def test_sinks_save_in_place_resume_and_refuse(spark, tmp_path):
    path = str(tmp_path / "m")
    one = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k long, v double")
    for df in (one.limit(1), one):
        sinks.save(df, path)
    assert sorted(map(tuple, sinks.load(spark, path, "k long, v double").collect())) == [(1, None), (2, 0.5)]
    assert sinks.load(spark, str(tmp_path / "none"), "k long").count() == 0 and len(list(tmp_path.iterdir())) == 1
    seen = []
    run = lambda todo: seen.append(sorted(r["k"] for r in todo.collect())) or todo
    fills = str(tmp_path / "fill")
    sinks.fill(one.where("k = 1"), fills, ["k"], run)
    assert sinks.fill(one, fills, ["k"], run, pieces=2).count() == 2 and sorted(sum(seen, [])) == [1, 2]
    with pytest.raises(ValueError, match="nothing"):
        sinks.build_corpus(one.limit(0).withColumn("cell", F.lit("a")), one, str(tmp_path / "c"))
    sites = spark.createDataFrame([("s", [1.0] * 6, [1.0] * 4)], "site string, a array<double>, b array<double>")
    assert sinks.check_shapes(sites, 2, 3, 2).count() == 1
    for rank, rows in ((3, sites), (2, sites.limit(0))):
        with pytest.raises(ValueError, match="shapes"):
            sinks.check_shapes(rows, rank, 3, 2)
    with pytest.raises(ValueError, match="scale"):
        sinks.require_preserved(spark.createDataFrame([(1.1,)], "r double"), "r")
