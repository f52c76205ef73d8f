"""Exact token counts of whole texts, huge documents included.

A text of more than ``CHUNK`` characters is encoded in chunks that overlap, with their tokens' offsets. Two
neighbouring chunks are spliced at a boundary that both encodings have in their overlap and that is
proven stable: an ASCII character that isn't a blank stands before it, a blank behind it. Where an overlap
has no such boundary (a long run without blanks), the overlap and with it the left chunk are
widened, doubling each time, until there is one or the text ends.

The proof is the vocabulary's: ``proven`` reads from the file that words are cut at such places before merging begins, that no
normal form looks across them and that no special string spans one, or, for sentencepiece, that no piece holds a blank behind
another character. Then what stands on one side can't change the tokens on the other. A vocabulary of which
this can't be read is refused.

Where the vocabulary drops blanks altogether, a chunk's tokens come from those of its stretches between ASCII white space, each of which
the library encodes once (``stretches``); a stretch that the chunk's edge cuts stands outside the splice, as any token there.

Everything happens in the task that reads the text. Nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import modest_batches
from evalgrid.llm.stretches import WORDS, Stretches, drops_blanks, split

#: Characters of a chunk, and of the first overlap.
CHUNK, OVERLAP = 1024, 64
_BOUNDARY = re.compile(r"[!-~](?=[ \n\t\r])")
#: Stretches of text that a worker keeps with their counts.
KEPT = 1_000_000


class Encoded:
    """The tokens of a chunk by the ``tokenizers`` library."""

    def __init__(self, encoding) -> None:
        self.encoding, self.n = encoding, len(encoding)

    def before(self, at: int) -> int | None:
        """Tokens that end by character ``at``, or None if no token ends right there."""
        i = self.encoding.char_to_token(at - 1)
        return i + 1 if i is not None and self.encoding.token_to_chars(i)[1] == at else None


class Pieces:
    """The tokens of a chunk by ``sentencepiece``; a piece's offset is the sum of the bytes before it."""

    def __init__(self, model, text: str) -> None:
        ids = model.encode(text)
        self.text, self.n, self.ends, at = text, len(ids), [], 0
        for i in ids:
            at += 1 if model.is_byte(i) else len(model.id_to_piece(i).encode())
            self.ends.append(at)

    def before(self, at: int) -> int | None:
        end = 3 + len(self.text[:at].replace(" ", "▁").encode("utf-8", "surrogatepass"))
        i = bisect_left(self.ends, end)
        return i + 1 if i < self.n and self.ends[i] == end else None


class Blanked:
    """The tokens of a chunk whose blanks are dropped, as the counts of its stretches."""

    def __init__(self, text: str, counts: list[int]) -> None:
        self.text, self.counts, self.n = text, counts, sum(counts)

    def before(self, at: int) -> int:
        """Tokens before ``at``, the end of a stretch, where a token always ends; the shorter side is looked at."""
        if 2 * at <= len(self.text):
            return sum(self.counts[: len(self.text[:at].encode().split())])
        return self.n - sum(self.counts[len(self.counts) - len(self.text[at:].encode().split()) :])


#: A chunk's tokens, and from a text to them.
Tokens = Encoded | Pieces | Blanked
Encode = Callable[[str], Tokens]


def proven(vocabulary: str) -> None:
    """Raises ValueError unless the vocabulary file shows that the boundary is stable."""
    if vocabulary.endswith(".model"):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model, spec = sentencepiece.SentencePieceProcessor(model_file=vocabulary), sentencepiece_model_pb2.ModelProto()
        with open(vocabulary, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        if inner or spec.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or rules.name != "identity":
            raise ValueError(f"no stable boundary is proven for {vocabulary}")
        return
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda x, inner: () if x is None else x[inner] if x["type"] == "Sequence" else [x]
    forms, cuts = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    plain = lambda x, own: x["type"] == "ByteLevel" and not x["add_prefix_space"] and x.get("use_regex", True) is own
    words = len(cuts) == 1 and plain(cuts[0], True)
    if len(cuts) == 2:
        split = cuts[0]
        words = split["type"] == "Split" and split["pattern"].get("Regex") in WORDS and split["behavior"] == "Removed" and split["invert"] and plain(cuts[1], False)
    alike = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in forms)
    added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"])) for x in spec["added_tokens"])
    if not (words and alike and added and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")):
        raise ValueError(f"no stable boundary is proven for {vocabulary}")


def common_boundary(text: str, left: Tokens, start: int, stop: int, right: Tokens, begin: int) -> tuple[int, int, int] | None:
    """A stable boundary in the overlap from ``begin`` to ``stop`` that both encodings have, and the tokens of each before it."""
    for m in _BOUNDARY.finditer(text, begin, stop):
        a, b = left.before(m.end() - start), right.before(m.end() - begin)
        if a is not None and b is not None:
            return m.end(), a, b
    return None


def spliced_count(encode: Encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """Tokens of ``text``, chunks encoded, and times that an overlap was widened; one chunk after the other."""
    total, chunks, widened = 0, 1, 0
    start, stop, skip = 0, min(len(text), chunk + overlap), 0
    left = encode(text[start:stop])
    while stop < len(text):
        over = overlap
        while True:
            begin = max(start, stop - over)
            end = min(len(text), stop + max(chunk, over))
            right = encode(text[begin:end])
            chunks += 1
            cut = common_boundary(text, left, start, stop, right, begin)
            if cut is not None or stop == len(text):
                break
            widened += 1
            over *= 2
            stop = min(len(text), stop + over)
            left = encode(text[start:stop])
            chunks += 1
        if cut is None:
            break
        total += cut[1] - skip
        start, stop, left, skip = begin, end, right, cut[2]
    return total + left.n - skip, chunks, widened


class Counter:
    """Counts tokens with the library for a vocabulary file; made in each worker."""

    def __init__(self, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.chunk, self.overlap = chunk, overlap
        if vocabulary.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            self.encode = lambda texts: [Pieces(model, t) for t in texts]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(vocabulary)
            model.no_truncation()
            model.no_padding()
            if drops_blanks(vocabulary):
                known = Stretches(lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)], KEPT)
                self.encode = lambda texts: list(map(Blanked, texts, known([split(t.encode()) for t in texts])))
            else:
                self.encode = lambda texts: [Encoded(x) for x in model.encode_batch(texts, add_special_tokens=False)]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The chunks of a text, each with its overlap into the next."""
        starts = range(0, max(1, len(text) - self.overlap), self.chunk)
        return [(low, min(len(text), low + self.chunk + self.overlap)) for low in starts]

    def count(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """Tokens, chunks and widened overlaps of each text; a null text is empty."""
        texts = [t or "" for t in texts]
        spans = [self.spans(t) for t in texts]
        encoded = iter(self.encode([t[low:high] for t, own in zip(texts, spans, strict=True) for low, high in own]))
        return [self._spliced(t, own, [next(encoded) for _ in own]) for t, own in zip(texts, spans, strict=True)]

    def _spliced(self, text: str, spans: list[tuple[int, int]], chunks: list) -> tuple[int, int, int]:
        total, skip = 0, 0
        for (start, stop), left, (begin, _), right in zip(spans, chunks, spans[1:], chunks[1:], strict=False):
            cut = common_boundary(text, left, start, stop, right, begin)
            if cut is None:  # an overlap must be widened
                n, more, widened = spliced_count(lambda t: self.encode([t])[0], text, self.chunk, self.overlap)
                return n, len(spans) + more, widened
            total += cut[1] - skip
            skip = cut[2]
        return total + chunks[-1].n - skip, len(spans), 0


_counters: dict[tuple[str, int, int], Counter] = {}


def _counter(*key: str | int) -> Counter:
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened`` of every row of ``docs`` (columns doc_id, text).

    A null or empty text has no bytes and no tokens. Repeated rows and null ids
    come out as they are; an empty table gives an empty one; further columns of
    ``docs`` are ignored. ``vocabulary`` is a file that every executor has; one without a proven boundary raises ValueError.
    """
    proven(vocabulary)
    modest_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, n_chunks int, n_widened int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(vocabulary, chunk, overlap)
        for batch in batches:
            texts = batch.tolist()
            rows = [row for low in range(0, len(texts), 128) for row in counter.count(texts[low : low + 128])]
            yield pd.DataFrame(rows, columns=["n_tokens", "n_chunks", "n_widened"])

    text = F.col("text").cast("string")
    counted = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), count(text).alias("c"))
    return counted.select("doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.n_chunks", "c.n_widened")
