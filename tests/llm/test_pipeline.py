"""The stages of the pipeline against brute force, one after the other."""

import corpus_pipeline as p
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.llm import decontaminate, mixing, substring_dedup
from evalgrid.llm.common import written
from tests.llm.test_corpus_operators import brute_components, brute_repeats
from tests.parity import DATA


def test_stages_equal_brute_force(spark):
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    junk = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "12345 !!!", "en", "s", 9), (90_003, whole.first()["text"], "en", "s", 5), (90_003, whole.first()["text"], "en", "s", 5)], whole.schema)
    kept = [whole.unionByName(junk)]
    for name, stage in p.STAGES:
        kept.append(written(stage(spark, kept[-1], DATA), name.replace(" ", "-")))
    assert all(d.columns == whole.columns for d in kept[:-1])
    rows = [[tuple(r) for r in d.select("doc_id", "text").collect()] for d in kept]
    texts = [dict(r) for r in rows]
    assert {i for i, _ in rows[0]} - {i for i, _ in rows[1]} == {90_001, 90_002}
    assert {i for i, _ in rows[2]} == {i for i, x in brute_components(rows[1], p.SHINGLE, p.PERCENT).items() if x[2]} and len(rows[2]) == len(texts[2])
    spans = {}
    for i, start, stop in brute_repeats(rows[2]):
        spans.setdefault(i, []).append((start, stop))
    cut = {i: substring_dedup.without(t, *zip(*spans[i], strict=True)) if i in spans else t for i, t in rows[2]}
    assert texts[3] == {i: t for i, t in cut.items() if t.strip() or i not in spans}
    bench = [(r["item_id"], decontaminate.word_hashes(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    holds = lambda t: any(decontaminate.align(w, decontaminate.word_hashes(t))[0] >= decontaminate.THRESHOLD * decontaminate.MATCH * len(w) for _, w in bench)
    assert texts[4] == {i: t for i, t in texts[3].items() if not holds(t)}
    last = kept[-1].toPandas()
    assert (last["n_copies"] > 0).all() and set(last["doc_id"]) <= set(texts[4])
    every = mixing.mixed(kept[4], spark.read.parquet(f"{DATA}/labels.parquet"), p.SHARES, p.BUDGET).select("n_tokens", "posteriors", "rate", "gap", (F.col("n_copies") > 0).alias("in")).toPandas()
    a = np.stack(every["posteriors"].to_numpy()) * every["n_tokens"].to_numpy()[:, None]
    goal = np.array([p.SHARES[x] * p.BUDGET for x in mixing.DOMAINS])
    far = np.abs(a.T @ every["rate"].to_numpy() / every["n_tokens"].sum() - goal).max()
    assert far == pytest.approx(every["gap"][0] * goal.max(), abs=1e-6)
    assert every["in"].sum() == len(last)


def test_stages_handle_odd_rows_and_clashing_columns(spark, tmp_path):
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    text = whole.orderBy("doc_id").first()["text"]
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_004, text + " more words here", "en", "a", 2), (90_004, "another text of the same id in plain words", "en", "b", 3)]
    extra = spark.createDataFrame(rows, whole.schema)
    names = {n: F.lit(n) for n in ("score", "removed", "rate", "gap", "lang_pred", "n_tokens", "__row", "u", "hash")} | {"m": F.create_map(F.lit("k"), F.lit(1))}
    docs = whole.unionByName(extra).unionByName(extra).withColumns(names)
    for d in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            before, d = d, written(stage(spark, d, DATA), name.replace(" ", "-"))
            if name != p.STAGES[-1][0]:
                assert d.columns == before.columns
                assert d.where("score <> 'score' OR removed <> 'removed' OR lang_pred <> 'lang_pred' OR m['k'] <> 1").count() == 0
            assert d.count() <= before.count()
    none = tmp_path / "tables"
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(none / f"{name}.parquet"))
    assert p.without_benchmark(spark, whole, str(none)).count() == whole.count()
    assert {r["gap"] > mixing.CLOSE for r in p.mixed(spark, whole, str(none)).select("gap").collect()} == {True}


def test_rows_that_repeat_an_id_with_unlike_texts_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, p.one_of_each_group(spark, docs, DATA).collect())) == [(1, "a b c d e f g"), (1, "h i j k l m n"), (3, None)]
