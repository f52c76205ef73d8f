"""Pruned listing, endless epochs, anchored corpora and crawls with a probe, on planted cases."""

import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid import plans
from evalgrid.operators import anchors, graphs
from evalgrid.plans import trees
from evalgrid.sources import epochs, files, listing
from tests import parity


def write(path, text=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def listed(seen, root):
    return {r["dir"].removeprefix(str(root)) for r in seen.select("dir").distinct().collect()}


def test_tables_where_they_are_expected(spark, tmp_path):
    for place in ("", "one/", "results/model/1_all/", "a/b/c/"):
        write(tmp_path / f"{place}result_df_trial_1_of_2.csv")
    write(tmp_path / "two/down/result_df_trial_1_of_1.csv")
    write(tmp_path / "a/b/c/d/result_df_trial_2_of_2.csv")
    for k in range(5):
        write(tmp_path / f"results/model/1_all/ep_{k}/training_data/x.json")
    write(tmp_path / "results/model/1_all/summary_df.csv")
    found, seen = listing.trial_tables(spark, str(tmp_path))
    assert sorted(r["path"].removeprefix(str(tmp_path)) for r in found.collect()) == ["/a/b/c/result_df_trial_1_of_2.csv", "/one/result_df_trial_1_of_2.csv", "/result_df_trial_1_of_2.csv", "/results/model/1_all/result_df_trial_1_of_2.csv"]
    assert listed(seen, tmp_path) == {"", "/one", "/two", "/two/down", "/results", "/results/model", "/results/model/1_all", "/a", "/a/b", "/a/b/c"}


def test_the_whole_tree_only_where_nothing_is_found(spark, tmp_path):
    write(tmp_path / "a/b/result_df_trial_1_of_2.csv")
    write(tmp_path / "a/b/c/d/e/result_df_trial_2_of_2.csv")
    found, seen = listing.trial_tables(spark, str(tmp_path))
    assert sorted((r["trial"], r["of"], r["study_dir"].removeprefix(str(tmp_path)), r["at"] is not None) for r in found.collect()) == [(1, 2, "/a/b", True), (2, 2, "/a/b/c/d/e", True)]
    assert listed(seen, tmp_path) == {"", "/a", "/a/b", "/a/b/c", "/a/b/c/d", "/a/b/c/d/e"}
    for gone in (tmp_path / "nothing", tmp_path / "empty"):
        (tmp_path / "empty").mkdir(exist_ok=True)
        assert listing.trial_tables(spark, str(gone))[0].count() == 0


def test_episode_folders_and_nested_episodes(spark, tmp_path):
    era = tmp_path / "version_3"
    for name, summary, dumps in (("t_on_run.4_7", '{"cum_reward": 0.5, "n_steps": 3}', 2), ("t_on_run.5_8_1", None, 0), ("t_on_run.6_9", "{broken", 1)):
        (era / name).mkdir(parents=True)
        if summary:
            write(era / name / "summary_info.json", summary)
        for k in range(dumps):
            write(era / name / "training_data" / f"agent_output_step_{k}.json", json.dumps({"n": k}))
        write(era / name / "training_data" / "agent_output_step_9.txt")
    write(era / "other" / "training_data" / "agent_output_step_0.json", '{"n": 5}')
    write(era / "deep" / "er" / "one" / "training_data" / "agent_output_step_10.json", '{"n": 10}')
    write(era / "deep" / "er" / "one" / "training_data" / "agent_output_step_9.json", '{"n": 9}')
    write(era / "deep" / "er" / "one" / "inner" / "training_data" / "agent_output_step_0.json", '{"n": 0}')
    got = listing.episode_folders(spark, [str(era), str(tmp_path / "gone")]).orderBy("name").collect()
    assert [tuple(r)[1:] for r in got] == [("t_on_run.4_7", 4, 7, 0.5, 3, 2), ("t_on_run.5_8_1", 5, 8, 0.0, 0, 0), ("t_on_run.6_9", 6, 9, 0.0, 0, 1)]
    found, seen = listing.nested_episodes(spark, str(tmp_path), "n int")
    steps = {r["dir"].removeprefix(str(era)): (r["era"], [s["n"] for s in r["steps"]]) for r in found.collect()}
    assert steps == {"/t_on_run.4_7": (3, [0, 1]), "/t_on_run.6_9": (3, [0]), "/other": (3, [5]), "/deep/er/one": (3, [9, 10])}
    assert "/version_3/deep/er/one" in listed(seen, tmp_path) and not any("inner" in x for x in listed(seen, tmp_path))


def test_scanned_episodes_stand_a_round_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "work_dir", lambda _, name, within=None: f"{within or tmp_path}/{name}-{uuid.uuid4().hex}")
    monkeypatch.setattr(trees, "ROUND", 300, raising=False)
    standing, scan = [], listing.episode_folders

    def scanned(*args):
        standing.append(len(list(tmp_path.glob("**/version_*/*_on_run.*"))))
        return scan(*args)

    monkeypatch.setattr(listing, "episode_folders", scanned)
    parity.check(spark, parity.connect(), trees.src01_listed, plans.ORACLES["src01_listed_episodes"])
    assert len(standing) == 5 and sum(standing) == 1500 and max(standing) < 400


@pytest.mark.parametrize(("n", "parts"), [(0, 1), (1, 1), (100, 1), (101, 2), (1000, 10)])
def test_rounds_hold_every_row_once(spark, tmp_path, n, parts):
    got = [([r["id"] for r in part.collect()], last) for part, last in files.rounds(spark.range(n), "id", 100, str(tmp_path))]
    assert sorted(x for part, _ in got for x in part) == list(range(n)) and max(len(part) for part, _ in got) <= 150
    assert [last for _, last in got] == [False] * (parts - 1) + [True]


def test_only_the_given_folders_are_removed(spark, tmp_path):
    for name in ("a", "a/b", "ab", "c"):
        write(tmp_path / name / "x.json", "{}")
    given = spark.createDataFrame([(f"{tmp_path}/{name}",) for name in ("a", "c", "gone")], "path string")
    assert listing.remove_folders(given) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["ab"] and (tmp_path / "ab/x.json").exists()


@pytest.mark.parametrize("size", [0, 1, 2, 3, 100, 4097])
def test_epochs_are_permutations(size):
    orders = [epochs.permuted(np.arange(size), size, 5, e) for e in range(3)]
    assert all(sorted(o.tolist()) == list(range(size)) for o in orders)
    if size > 50:
        assert not (orders[0] == orders[1]).all() and abs(np.corrcoef(orders[0], np.arange(size))[0, 1]) < 0.3
        assert (epochs.permuted(np.array([7, 50]), size, 5, 2) == orders[2][[7, 50]]).all()


def test_an_epoch_alone_and_in_a_stream(spark, tmp_path, monkeypatch):
    all_ = {(r["epoch"], r["place"], r["item"]) for r in epochs.reader(spark, 300, seed=3, epochs=4).collect()}
    alone = {tuple(r) for r in epochs.reader(spark, 300, seed=3, first=3).collect()}
    assert len(all_) == 1200 and alone == {x for x in all_ if x[0] == 3}
    stream = epochs.reader(spark, 300, seed=3, stream=True)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        while (query.lastProgress or {"batchId": 0})["batchId"] < 4 and query.isActive:
            query.awaitTermination(1)
    finally:
        query.stop()
    got = {(r["epoch"], r["place"], r["item"]) for r in spark.read.parquet(str(tmp_path / "out")).where("epoch < 4").collect()}
    assert got == all_


def test_anchors(spark):
    table = lambda rows: spark.createDataFrame(rows, "id long, content string")
    own = table([(k, f"own {k}") for k in range(25)] + [(99, None)])
    pool = table([(100 + k, f"other {k}") for k in range(9)] + [(200, "own 3"), (201, None)])
    mixed, stats = anchors.anchored(own, pool, seed=4, most_collisions=0.2)
    rows = mixed.collect()
    assert stats["n_candidates"] == 26 and stats["cycled"] and stats["pool_size"] == 11 and stats["n_unique"] == 11
    assert stats["n_dropped"] in (2, 3) and stats["n_anchor"] == 26 - stats["n_dropped"] and len(rows) == stats["n_samples"]
    copies = [r["id"] for r in rows if r["role"] == 1]
    assert 200 not in copies and all(copies.count(x) in (2, 3) for x in {r["id"] for r in pool.where("id <> 200").collect()})
    assert all(r["weight"] == r["role"] for r in rows)
    few, s = anchors.anchored(own, pool, ratio=0.2, seed=4, most_collisions=0.5)
    assert s["n_candidates"] == 5 and not s["cycled"] and [tuple(r) for r in few.orderBy("id", "copy").collect()] == [tuple(r) for r in anchors.anchored(own, pool, ratio=0.2, seed=4, most_collisions=0.5)[0].orderBy("id", "copy").collect()]
    for bad in (dict(ratio=0.001), dict(most_collisions=0.05, ratio=4)):
        with pytest.raises(ValueError):
            anchors.anchored(own, pool, seed=4, **bad)
    with pytest.raises(ValueError):
        anchors.anchored(own, pool.where("id = 200"), most_collisions=1.0)


#: A wiki of five pages and a search; and a shop whose goods stand behind its search.
LINKS = {"wiki": {"/": ["/wiki/Biology", "/wiki/Physics"], "/wiki/Biology": ["/", "/wiki/Biophysics"], "/wiki/Physics": ["/wiki/Biophysics"], "/search?q=Biology": ["/wiki/Biology", "/wiki/Botany"]}, "shop": {"/abc": [], "/abc/found": ["/abc/item1", "/abc/item2"], "/abc/item1": ["/abc/item3"], "/abc/item3": ["/abc/item4"]}}
SEARCH = {"wiki": {"/wiki/Physics": "/search?q=Physics", "/": "/search?q=Biology"}, "shop": {"/abc": "/abc/found"}}


def probed(spark, pages, depth):
    edges = spark.createDataFrame([(h, s, d, k) for h, own in LINKS.items() for s, to in own.items() for k, d in enumerate(to)], "host string, src string, dst string, ord int")
    roots = spark.createDataFrame([("wiki", "/"), ("shop", "/abc")], "host string, node string")
    searches = spark.createDataFrame([(h, n, r) for h, own in SEARCH.items() for n, r in own.items()], "host string, node string, result string")
    got = graphs.crawl_with_probe(roots, edges, searches, depth, pages, keep=lambda df: files.kept(df, 'crawl')).orderBy("place").collect()
    return {h: [(r["node"], r["depth"], r["from_probe"]) for r in got if r["host"] == h] for h in LINKS}


def test_one_probe_then_on(spark):
    got = probed(spark, 10, 3)
    assert got["wiki"] == [("/", 0, False), ("/wiki/Biology", 1, False), ("/wiki/Physics", 1, False), ("/wiki/Biophysics", 2, False), ("/search?q=Biology", 1, True), ("/wiki/Botany", 2, False)]
    assert got["shop"] == [("/abc", 0, False), ("/abc/found", 1, True), ("/abc/item1", 2, False), ("/abc/item2", 2, False), ("/abc/item3", 3, False)]


def test_budgets_of_a_probed_crawl(spark):
    got = probed(spark, 2, 3)
    assert [x[0] for x in got["wiki"]] == ["/", "/wiki/Biology", "/search?q=Biology"] and [x[0] for x in got["shop"]] == ["/abc", "/abc/found"]
    flat = probed(spark, 10, 1)
    assert "/wiki/Biophysics" not in [x[0] for x in flat["wiki"]] and [x[0] for x in flat["shop"]] == ["/abc", "/abc/found"]


def test_first_visits(spark):
    rows = [(2, 0, "/b"), (1, 1, "/a"), (1, 0, "/c"), (2, 1, "/a"), (3, 0, "/d"), (1, 2, "/c")]
    visits = spark.createDataFrame(rows, "task int, pos int, path string").withColumn("order", F.col("task"))
    assert [(r["path"], r["from_task"]) for r in graphs.first_visits(visits, ["order", "pos"], 3).orderBy("place").collect()] == [("/c", 1), ("/a", 1), ("/b", 2)]
