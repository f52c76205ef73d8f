"""Endless shuffled epochs as a Spark data source: any epoch's order is computed alone, and a stream never runs dry.

``spark.read.format("epochs").option("size", n).option("seed", s).option("first", e).option("epochs", k)`` gives
``epoch, place, item``: for each epoch every number from 0 to n - 1 once. The order is a keyed permutation of the numbers, so a
partition computes its own places and nothing is shuffled or kept. ``readStream`` gives one epoch after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "epoch long, place long, item long"
#: Rounds of the permutation, and places that a partition computes.
ROUNDS, PLACES = 6, 1 << 20


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def permuted(places: np.ndarray, size: int, seed: int, epoch: int) -> np.ndarray:
    """The items at some places of an epoch: a balanced Feistel network over the next power of 4, walked on until within the size."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [int(k) for k in np.random.default_rng([seed & 0xFFFFFFFF, epoch & 0xFFFFFFFF]).integers(0, 1 << 63, ROUNDS)]
    out = places.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


class Part(InputPartition):
    def __init__(self, epoch: int, start: int, stop: int) -> None:
        self.epoch, self.start, self.stop = epoch, start, stop


class _Base:
    def __init__(self, options: dict[str, str]) -> None:
        self.size, self.seed = int(options["size"]), int(options.get("seed", 0))
        self.first, self.epochs = int(options.get("first", 0)), int(options.get("epochs", 1))
        if self.size < 0 or self.epochs < 1:
            raise ValueError("epochs need a size from 0 and one epoch at least")

    def parts(self, first: int, last: int) -> list[Part]:
        return [Part(e, low, min(self.size, low + PLACES)) for e in range(first, last) for low in range(0, self.size, PLACES)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for low in range(part.start, part.stop, 1 << 16):
            places = np.arange(low, min(part.stop, low + (1 << 16)))
            items = permuted(places, self.size, self.seed, part.epoch)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), part.epoch)), pa.array(places), pa.array(items)], ["epoch", "place", "item"])


class BatchReader(_Base, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.parts(self.first, self.first + self.epochs)


class StreamReader(_Base, DataSourceStreamReader):
    """Each time it is asked, ``epochs`` more are there."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.now = self.first

    def initialOffset(self) -> dict:
        return {"epoch": self.first}

    def latestOffset(self) -> dict:
        self.now += self.epochs
        return {"epoch": self.now}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.now = max(self.now, end["epoch"])
        return self.parts(start["epoch"], end["epoch"])

    def commit(self, end: dict) -> None:
        pass


class Epochs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def reader(spark: SparkSession, size: int, seed: int = 0, first: int = 0, epochs: int = 1, stream: bool = False):
    """A table of so many epochs, or a stream of all that follow."""
    spark.dataSource.register(Epochs)
    source = (spark.readStream if stream else spark.read).format("epochs")
    return source.option("size", size).option("seed", seed).option("first", first).option("epochs", epochs).load()
