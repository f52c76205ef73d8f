"""Token ids of a corpus in files of equal-length sequences, read at random without copying.

Documents are range-partitioned and sorted by their id. Each task encodes its whole texts, appends the end id to each, and packs
the ids one after the other into sequences of ``SEQUENCE`` ids. A file is an Arrow stream of record batches with two fixed-size
lists a row: ``ids``, and ``mask`` (false where the last sequence is filled up). All batches of a file have ``BATCH`` rows, so all their
messages are equally long: sequence i begins at a place that is computed, and comes as a slice of the mapped file. Beside each file a
second stream says where its documents begin. A task that is run again writes the same files again, under a name of its
own until they are complete.

Encoding takes each distinct stretch between ASCII white space once (``stretches``); a worker keeps up to ``KEPT`` of them with their ids.
Texts go whole to the library for a vocabulary that doesn't drop white space.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.llm.common import modest_batches, shared_dir, written
from evalgrid.llm.stretches import Stretches, drops_blanks, split

#: Ids of a sequence, sequences of a record batch, and ids from which a task begins its next file.
SEQUENCE, BATCH, FILE = 2048, 64, 1 << 26
#: Stretches of text that a worker keeps with their ids.
KEPT = 2_000_000

FILES = "part int, number int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Encoder:
    """Ids of texts by the ``tokenizers`` library, as little-endian bytes of ``dtype``; made in each worker."""

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        self.model.no_truncation()
        self.model.no_padding()
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.by_stretch = drops_blanks(vocabulary)
        self.stretches = Stretches(self._library, KEPT)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        if not self.by_stretch:
            return self._library([(t or b"").decode("utf-8", "replace") for t in texts])
        return [b"".join(ids) for ids in self.stretches([split(t or b"") for t in texts])]


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def schema(dtype: np.dtype, sequence: int = SEQUENCE, batch: int = BATCH) -> pa.Schema:
    lists = [pa.field("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence), False), pa.field("mask", pa.list_(pa.bool_(), sequence), False)]
    return pa.schema(lists, {"sequence": str(sequence), "batch": str(batch)})


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """One file of sequences and the index beside it; complete, under its name, once it is closed."""

    def __init__(self, path: str, dtype: np.dtype, sequence: int = SEQUENCE, batch: int = BATCH) -> None:
        self.store, self.path = fs.FileSystem.from_uri(path)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.schema, self.sequence, self.size = schema(dtype, sequence, batch), sequence, sequence * batch
        self.dtype, self.held, self.waiting = dtype, [], 0
        self.n_tokens, self.docs, self.n_docs = 0, [], 0
        self.files = [self.store.open_output_stream(self.own + end) for end in ("", ".docs")]
        self.streams = [ipc.new_stream(self.files[0], self.schema), ipc.new_stream(self.files[1], _INDEX)]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.n_tokens, n))
        self.held.append(ids)
        self.waiting += n
        self.n_tokens += n
        self.n_docs += 1
        if self.waiting >= self.size:
            self._put(False)
        if len(self.docs) >= 1 << 16:
            self._index()

    def _put(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        whole = -(-len(ids) // self.size) if last else len(ids) // self.size
        for k in range(whole):
            part = ids[k * self.size : (k + 1) * self.size]
            mask = np.arange(self.size) < len(part)
            part = np.concatenate([part, np.zeros(self.size - len(part), self.dtype)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (part, mask)]
            self.streams[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        rest = ids[whole * self.size :]
        self.held, self.waiting = [rest.tobytes()], len(rest)

    def _index(self) -> None:
        columns = [pa.array(x, pa.int64()) for x in zip(*self.docs, strict=True)]
        self.streams[1].write_batch(pa.RecordBatch.from_arrays(columns, schema=_INDEX))
        self.docs = []

    def close(self) -> None:
        if self.waiting:
            self._put(True)
        if self.docs:
            self._index()
        for stream, file in zip(self.streams, self.files, strict=True):
            stream.close()
            file.close()
        for end in (".docs", ""):
            self.store.move(self.own + end, self.path + end)


class Sequences:
    """Random access to the sequences of a file: ``file[i]`` is ``(ids, mask)``, slices of the file where it can be mapped."""

    def __init__(self, path: str) -> None:
        store, place = fs.FileSystem.from_uri(path)
        self.file = pa.memory_map(place) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(place)
        self.schema = ipc.read_schema(ipc.read_message(self.file))
        self.sequence, self.batch = (int(self.schema.metadata[k]) for k in (b"sequence", b"batch"))
        self.first = self.file.tell()
        self.count = 0
        if self.file.size() > self.first + 8:  # the stream ends with 8 bytes
            ipc.read_message(self.file)
            self.stride = self.file.tell() - self.first
            self.count = (self.file.size() - self.first - 8) // self.stride
        self.at, self.held = -1, None

    def __len__(self) -> int:
        return self.count * self.batch

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.file.seek(self.first + k * self.stride)
            self.at, self.held = k, ipc.read_record_batch(ipc.read_message(self.file), self.schema)
        return self.held

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, row = self._batch(i // self.batch), i % self.batch
        return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values

    def ids(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` to ``stop`` of the file, a slice of each batch at a time."""
        size = self.sequence * self.batch
        while start < stop:
            k, low = divmod(start, size)
            high = min(size, low + stop - start)
            yield self._batch(k).column(0).values.to_numpy(zero_copy_only=True)[low:high]
            start += high - low


def index(path: str) -> Iterator[pa.RecordBatch]:
    """Where the documents of a file begin: batches of doc_id, start, n_tokens, in the file's order."""
    store, place = fs.FileSystem.from_uri(path + ".docs")
    with store.open_input_stream(place) as f:
        yield from ipc.open_stream(f)


def write_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, sequence: int = SEQUENCE, batch: int = BATCH, file: int = FILE) -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order and returns the files' table: ``part, number, path, n_docs, n_tokens, start``.

    ``start`` counts the ids of all files before. The folder (by default a new one in the shared folder) must be one that driver and
    executors share. A null or empty text is the end id alone. Rows without an id come first; rows that share an id stand in the order of their
    texts' hashes, and all are kept. Further columns are ignored; an empty table makes no file.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    folder = (folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Copies that share an id, however many, are told apart by their row's number, so no range has to hold them all.
    keyed = rows.withColumn("sign", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange("doc_id", "sign", "row").sortWithinPartitions("doc_id", "sign", "row").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(vocabulary), TaskContext.get().partitionId()
        store, place = fs.FileSystem.from_uri(folder)
        end, made, writer = np.array([end_id], encoder.dtype).tobytes(), [], None

        def done() -> None:
            writer.close()
            made.append((part, len(made), f"{folder}/part-{part:06d}-{len(made):04d}.arrows", writer.n_docs, writer.n_tokens))

        for rows in batches:
            for doc_id, ids in zip(rows.column(0).to_pylist(), encoder(rows.column(1).cast(pa.binary()).to_pylist()), strict=True):
                if writer is None:
                    store.create_dir(place)
                    writer = Writer(f"{folder}/part-{part:06d}-{len(made):04d}.arrows", encoder.dtype, sequence, batch)
                writer.add(doc_id, ids + end)
                if writer.n_tokens >= file:
                    done()
                    writer = None
        if writer is not None:
            done()
        if made:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), kinds, strict=True)], ["part", "number", "path", "n_docs", "n_tokens"])

    files = written(placed.mapInArrow(write, FILES), "token-files")
    # A row for each file: a small table, however large the corpus.
    before = F.sum("n_tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    return written(files.withColumn("start", F.coalesce(before, F.lit(0))), "token-files")


def read_documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it, ``n_tokens`` its own with the end id, and the checksum is that of the ids as
    little-endian unsigned 32-bit integers. Each file is read in a task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, first in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                sequences = Sequences(path)
                for docs in index(path):
                    starts, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    sums = np.zeros(len(n), np.int64)
                    for k, (start, stop) in enumerate(zip(starts.tolist(), (starts + n).tolist(), strict=True)):
                        crc = 0
                        for ids in sequences.ids(start, stop):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums[k] = crc
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + first), pa.array(n), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "start").repartition(max(1, files.count())).mapInArrow(read, DOCUMENTS)
