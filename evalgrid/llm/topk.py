"""Exact top-k inner products by distributed histogram selection.

Everything is scored. Queries go out in blocks of about ``QUERIES``, each to every task that holds vectors, so vectors are
never shuffled or copied and what is sent is bounded by the block. Each round counts, for every query of a block, all
scores of an interval known to hold its kth score in ``BINS`` bins; tasks sum up
their counts, and the sum over tasks is the query's global histogram. The bin where the counts from above reach k becomes the next interval. When an interval is one
score wide, it is the kth score itself. A last pass keeps what reaches it, and ties go to the smaller id.

Scores aren't kept between rounds. They are computed anew from packed blocks, which costs less than
writing them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.llm.common import written

#: Vectors of a packed block, queries sent out at a time, bins of a histogram, and quantisation steps of 1.
ROWS, QUERIES, BINS, STEPS = 2048, 2048, 256, 256


def _pack(ids: np.ndarray, vectors: list[np.ndarray]) -> dict:
    dim = max((len(v) for v in vectors), default=0)
    data = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        data[i, : len(v)] = v
    return {"n": len(ids), "most": float(np.abs(data).max(initial=0)), "dim": dim, "ids": ids.astype(np.int64).tobytes(), "data": data.tobytes()}


_BLOCK = "n int, most double, dim int, ids binary, data binary"


def _quantised(batch: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and floor(256 * x) of the vectors that are whole and finite."""
    ids, vectors = [], []
    for i, v in zip(batch["vec_id"], batch["embedding"], strict=True):
        if v is None or pd.isna(i):
            continue
        x = np.floor(np.asarray(v, np.float64) * STEPS)
        if np.isfinite(x).all():
            ids.append(int(i))
            vectors.append(x)
    return np.array(ids, np.int64), vectors


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Packed blocks of at most ``size`` vectors."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), size):
                ids, found = _quantised(batch.iloc[low : low + size])
                if len(ids):
                    yield pd.DataFrame([_pack(ids, found)])

    return vectors.mapInPandas(pack, _BLOCK)


def _scores(q: np.ndarray, q_most: float, v: np.ndarray, v_most: float) -> np.ndarray:
    """Integer inner products; shorter vectors count as padded by zeros. One that 64 bits can't hold raises."""
    dim = min(q.shape[1], v.shape[1])
    q, v = q[:, :dim], v[:, :dim]
    bound = q_most * v_most * max(dim, 1)
    if bound < 2**53:  # every partial sum is exact in a double
        return (q @ v.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in v], object).T
    if exact.size and max(abs(exact.min()), abs(exact.max())) >= 2**62:
        raise ArithmeticError("a score is beyond 62 bits")
    return exact.astype(np.int64)


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"]).reshape(row["n"], row["dim"])


class _State:
    """What is known of a block's queries: their vectors, and the interval that holds each one's kth score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: int, k: int) -> None:
        self.ids, self.vectors, self.most = ids, vectors, float(np.abs(vectors).max(initial=0))
        self.low, self.size, self.wanted = np.full(len(ids), -reach, np.int64), 2 * reach + 1, np.full(len(ids), k, np.int64)

    @property
    def width(self) -> int:
        return max(1, -(-self.size // BINS))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the highest integer inner product with each query, its own left out.

    ``vectors`` has ``vec_id`` and ``embedding``; others are ignored. Components become floor(256 * x).
    Vectors that are null, hold a null or a component that isn't finite, and rows without an id take no part. Shorter
    vectors count as padded by zeros. Ties go to the smaller vec_id. All rows that share
    a query's id are its own; a repeated query counts once, with the least of its vectors. Scores beyond 62 bits raise ArithmeticError.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # A null or a number that isn't finite spoils the vector; numpy can't tell a null apart from NaN, and needn't.
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    asked = written(rows.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    held = written(_blocks(rows.select("vec_id", "embedding"), ROWS), "vector-blocks")
    n_queries = asked.count()
    passes = max(1, math.ceil(n_queries / QUERIES))
    far = held.agg(F.max(F.col("most") * F.sqrt(F.col("dim").cast("double")))).first()[0] or 0.0
    out = None
    for number in range(passes):
        # A hash deals the queries to passes: about ``QUERIES`` each, so what the driver holds and sends is bounded.
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number).toPandas()
        ids, found = _quantised(block)
        if not len(ids):
            continue
        packed = _pack(ids, found)
        q_ids, q = _unpacked(packed)
        # By Cauchy and Schwarz no score is farther from 0.
        reach = min(int(math.sqrt(float((q * q).sum(axis=1).max())) * float(far)) + 1, 2**62)
        kept = written(_kept(held, _narrowed(held, _State(q_ids, q, reach, k)), k), "kept")
        out = kept if out is None else out.unionByName(kept)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _narrowed(held: DataFrame, state: _State) -> _State:
    """Refines the intervals of a block's queries, by global histograms of all scores, until each is one score wide."""
    spark = held.sparkSession
    while state.size > 1:
        shared = spark.sparkContext.broadcast(state)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            state = shared.value
            width, bins = state.width, -(-state.size // state.width)
            sums = np.zeros((len(state.ids), bins), np.int64)
            first = np.arange(len(state.ids))[:, None] * bins
            for batch in batches:
                for _, row in batch.iterrows():
                    v_ids, v = _unpacked(row)
                    at = _scores(state.vectors, state.most, v, row["most"]) - state.low[:, None]
                    fits = (at >= 0) & (at < state.size) & (state.ids[:, None] != v_ids[None, :])
                    sums += np.bincount((first + at // width)[fits], minlength=sums.size).reshape(sums.shape)
            i, b = np.nonzero(sums)
            yield pd.DataFrame({"i": i.astype(np.int32), "bin": b.astype(np.int32), "n": sums[i, b]})

        bins = held.mapInPandas(count, "i int, bin int, n long").groupBy("i", "bin").agg(F.sum("n").alias("n"))
        # The first bin where the counts from above reach what is wanted; with fewer scores than that, the lowest.
        above = F.sum("n").over(Window.partitionBy("i").orderBy(F.desc("bin")))
        wanted = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(state.ids), dtype=np.int32), "wanted": state.wanted}), "i int, wanted long")
        ranked = bins.withColumn("sum", above).join(F.broadcast(wanted), "i")
        here = F.struct(F.col("bin").alias("bin"), (F.col("sum") - F.col("n")).alias("over"))
        chosen = ranked.groupBy("i").agg(F.coalesce(F.max(F.when(F.col("sum") >= F.col("wanted"), here)), F.min(here)).alias("at"))
        width, low, left = state.width, state.low.copy(), state.wanted.copy()
        for i, bin_, over in chosen.select("i", "at.bin", "at.over").collect():
            low[i] += bin_ * width
            left[i] -= over
        state.low, state.wanted, state.size = low, left, width
        shared.unpersist()
    return state


def _kept(held: DataFrame, state: _State, k: int) -> DataFrame:
    """Pairs of a block's queries with what reaches their kth scores; of a task's many equal scores only the k first can be among the k first of all."""
    shared = held.sparkSession.sparkContext.broadcast(state)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = shared.value
        for batch in batches:
            for _, row in batch.iterrows():
                v_ids, v = _unpacked(row)
                scores = _scores(state.vectors, state.most, v, row["most"])
                i, j = np.nonzero((scores >= state.low[:, None]) & (state.ids[:, None] != v_ids[None, :]))
                found = pd.DataFrame({"query_id": state.ids[i], "vec_id": v_ids[j], "score": scores[i, j]})
                yield found.sort_values(["score", "vec_id"], ascending=[False, True]).groupby("query_id").head(k)

    return held.mapInPandas(keep, "query_id long, vec_id long, score long")
