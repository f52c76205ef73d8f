"""Files of token ids against the library, read back at random; and odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from evalgrid.llm import queries, tokenfile
from tests.parity import DATA

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start string, ids_crc32 string, sign string, row string"


def library(texts, vocabulary=VOCABULARY):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(vocabulary).encode_batch(texts, add_special_tokens=False)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS)


def expected(rows):
    """By id: what the query is to return."""
    out, at = {}, 0
    for (i, t), ids in zip(rows, library([t or "" for _, t in rows]), strict=True):
        ids = np.array([*ids, 1], "<u4")
        out[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def got(frame):
    return {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in frame.collect()}


def test_query_equals_library(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    assert got(queries.QUERIES["op12_token_files"](spark, DATA)) == expected(rows)


def test_strange_texts_equal_library():
    rnd = random.Random(3)
    alphabet = ["a", "B", "é", "é", "́", "Σ", "İ", "日本", "。", "🙂", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", " ", "'s", "'", "'LL", ".", ",", "!?", "…", "“", "-", "1", "½", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "_", "\x00", "﷽", "ﬁ", "K"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(40))) for _ in range(3000)]
    encoder = tokenfile.Encoder(VOCABULARY)
    assert encoder.by_stretch and encoder.dtype == np.dtype("<u2")
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder([t.encode() for t in texts])] == library(texts)


def test_marks_that_one_case_alone_composes_with():
    texts = [f"{a}{letter}{marks}{b}" for letter in "THWYJItz" for marks in ("\u0308", "\u030a", "\u030c", "\u0331", "\u0307", "\u0344", "\u0323\u030c") for a, b in (("", ""), ("A b", "c D"))]
    encoder = tokenfile.Encoder(VOCABULARY)
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder([t.encode() for t in texts])] == library(texts)


def test_another_vocabulary_goes_whole():
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokenfile.Encoder(vocabulary)
    texts = ["two  blanks\n\n and words", "", " x"]
    assert not encoder.by_stretch
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder([t.encode() for t in texts])] == library(texts, vocabulary)


def test_what_is_forgotten_changes_nothing(monkeypatch):
    texts = [" ".join(f"word{(i * j) % 97}," for j in range(50)) for i in range(60)]
    want = tokenfile.Encoder(VOCABULARY)([t.encode() for t in texts])
    monkeypatch.setattr(tokenfile, "KEPT", 20)
    few = tokenfile.Encoder(VOCABULARY)
    assert [few([t.encode()])[0] for t in texts] == want and few([t.encode() for t in texts]) == want


def test_odd_rows_and_several_files_a_task(spark):
    long = " ".join(f"word{i % 977} and more" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (6, "!!! <|endoftext|> x"), (7, "short"), (8, "a\x00b é 日本 🙂"), (9, "of" * 3000), *[(i, f"text {i}") for i in range(20, 60)]]
    files = tokenfile.write_files(docs(spark, rows[::-1]), VOCABULARY, 1, sequence=16, batch=4, file=300)
    assert files.count() >= 3 and files.selectExpr("max(number)").first()[0] >= 1
    found = tokenfile.read_documents(spark, files)
    assert got(found) == expected(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "one two"), (None, "three"), (5, "same"), (5, "same"), (5, "same"), (5, "other"), (None, None)]
    found = tokenfile.read_documents(spark, tokenfile.write_files(docs(spark, rows), VOCABULARY, 1)).collect()
    assert len(found) == len(rows)
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None] * 3 + [5] * 4
    assert [r["start"] for r in ordered] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in ordered])[:-1]]).tolist()
    assert tokenfile.read_documents(spark, tokenfile.write_files(docs(spark, []), VOCABULARY, 1)).count() == 0


def test_random_access_copies_nothing(tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "some.arrows")
    writer = tokenfile.Writer(path, np.dtype("<u2"), sequence=8, batch=16)
    ids = np.arange(1, 1000, dtype="<u2")
    for k, part in enumerate(np.split(ids, [5, 5, 300, 900])):
        writer.add(k, part.tobytes())
    writer.close()
    sequences = tokenfile.Sequences(path)
    assert len(sequences) % 16 == 0 and len(sequences) >= 125
    before = pa.total_allocated_bytes()
    parts = [sequences[i] for i in range(len(sequences))]
    assert pa.total_allocated_bytes() == before and all(x.base is not None for x, _ in parts)
    flat = np.concatenate([x for x, _ in parts])
    mask = np.concatenate([m.to_numpy(zero_copy_only=False) for _, m in parts])
    assert (flat[mask] == ids).all() and mask.sum() == len(ids) and mask[: len(ids)].all()
    assert (sequences[77][0] == ids[77 * 8 : 78 * 8]).all()
    assert [r for b in tokenfile.index(path) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == [(0, 0, 5), (1, 5, 0), (2, 5, 295), (3, 300, 600), (4, 900, 99)]
    with pytest.raises(IndexError):
        sequences[len(sequences)]
