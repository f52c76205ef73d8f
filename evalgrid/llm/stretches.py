"""What a tokenizer gives for the stretches of text between ASCII white space, each distinct one encoded once.

Where a vocabulary drops white space before it merges (read from its file), no token depends on what stands on the other side of it.
A worker keeps what it was given for some stretches, which changes no result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

#: Word patterns that never let a blank follow another character within a word.
WORDS = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"])
#: Bytes of a stretch from which it is forgotten after use: it hardly comes again, and might be a whole text.
LONG = 64
#: A stretch that ends in punctuation; an apostrophe may begin a token of its own and isn't split off.
_TAIL = re.compile(rb"(.*[a-z0-9])([!-&(-/:-@\[-`{-~]+)", re.S)
#: What forbids to lower ASCII letters beforehand: the beginning of a special string, which counts only as it is written, or of a
#: combining mark (U+0300 to U+037F), as some letters have a composed form in one case alone.
_AS_WRITTEN = re.compile(rb"<\||[\xcc\xcd]")


def drops_blanks(vocabulary: str) -> bool:
    """Whether the vocabulary file shows that white space is dropped before merging begins, and that no special string holds any."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    cuts, forms = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    first, *more = cuts.get("pretokenizers", [cuts])
    words = first.get("type") == "Split" and first["pattern"].get("Regex") in WORDS and first["behavior"] == "Removed" and first["invert"]
    bare = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x.get("use_regex", True) for x in more)
    steps = forms["normalizers"] if forms["type"] == "Sequence" else [forms]
    alike = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in steps)
    lower = any(x["type"] == "Lowercase" for x in steps)
    added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"])) and x["content"].startswith("<|") for x in spec["added_tokens"])
    return words and bare and alike and lower and added and not spec["model"].get("dropout")


def split(text: bytes) -> list[bytes]:
    """The stretches of a text, with ASCII letters lowered where the library does the same whatever stands around."""
    return (text if _AS_WRITTEN.search(text) else text.lower()).split()


class Stretches[V: (bytes, int)]:
    """What ``library`` gives for stretches; the sum of two neighbours' values must be that of both. Keeps ``kept`` at most, and what one text needs."""

    def __init__(self, library: Callable[[list[str]], list[V]], kept: int) -> None:
        self.library, self.kept = library, kept
        self.known: dict[bytes, V] = {}
        self.older: dict[bytes, V] = {}
        self.long: list[bytes] = []

    def _learn(self, stretches: set[bytes]) -> None:
        """Has the library encode the stretches that aren't known; what ends in punctuation comes from its two parts."""
        parts = {w: m.groups() for w in stretches if b"<|" not in w and (m := _TAIL.fullmatch(w))}
        new = [w for w in (stretches - parts.keys()) | {x for two in parts.values() for x in two} if w not in self.known]
        self.known.update(zip(new, self.library([w.decode("utf-8", "replace") for w in new]), strict=True))
        self.known.update((w, self.known[a] + self.known[b]) for w, (a, b) in parts.items())
        self.long = [w for some in (new, parts) for w in some if len(w) > LONG]

    def __call__(self, texts: list[list[bytes]]) -> Iterator[list[V]]:
        """The values of each text's stretches; to be read to the end before the next call."""
        done = 0
        while done < len(texts):
            held, stop = set(), done
            while stop < len(texts) and (stop == done or len(held) <= self.kept // 4):
                held.update(texts[stop])
                stop += 1
            for w in self.long:
                self.known.pop(w, None)
            # What is known makes room in two steps: what is used again in the meantime stays. All that these texts need is known together.
            unknown = {w for w in held if w not in self.known}
            if len(self.known) + len(unknown) > self.kept // 2:
                self.known, self.older, unknown = {}, self.known, held
            again = {w: self.older[w] for w in unknown if w in self.older}
            self.known.update(again)
            self._learn(unknown - again.keys())
            for words in texts[done:stop]:
                yield list(map(self.known.__getitem__, words))
            done = stop
