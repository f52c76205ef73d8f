"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Wordings that name a license only by its tag or in under five words are too short for shingles and aren't looked for.

A template of L distinct shingles is looked for in windows of two blocks of h shingles, h
being the power of two from L up; each window shares a block with the next, so any
occurrence up to h + 1 shingles long lies whole within one window. A window that holds
``contain`` of a template's shingles has a Jaccard similarity of at least contain * L / (2h + L) to it, which
is over contain / 5. One coordinate a band and ``BANDS`` bands retrieve it with a probability
of at least 1 - (1 - contain / 5) ** BANDS: 99.9998 % at the defaults.

A window that shares no shingle with any template has no coordinate in common with it either,
so windows without one are passed over before coordinates are computed.

Retrieved windows are verified exactly: a stretch of text as long as the template must hold
``contain`` of the template's shingles; of stretches that overlap the best one counts. Everything happens in the task that reads the text, window by
window of that text; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import mix32, modest_batches, shingle_hashes

#: Words of a shingle, share of a template's shingles that must be there, and bands of one coordinate.
SHINGLE, CONTAIN, BANDS = 5, 0.8, 80
_WORD = re.compile(r"\w+")

#: Wordings of common license notices, in full and as they are often shortened.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU Affero General Public License",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Released under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD license",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under the Creative Commons Attribution 4.0 International License",
    ],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "made available under the terms of the Eclipse Public License",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "LGPL": ["under the terms of the GNU Lesser General Public License"],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "This project is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "subject to the terms of the Mozilla Public License",
    ],
    "Proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ],
}


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the runs of ``SHINGLE`` words in lower case, without punctuation; a shorter text is one run."""
    words = _WORD.findall(text.lower()) if text else ()
    digest = xxhash.xxh3_64_intdigest
    w = np.fromiter((digest(x.encode("utf-8", "surrogatepass")) for x in words), np.uint64, len(words))
    return shingle_hashes(w, min(len(w), SHINGLE) or SHINGLE)


def _bitmap_place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _coordinates(hashes: np.ndarray, band: int) -> np.ndarray:
    """One coordinate's permutation of the shingles."""
    return mix32((hashes >> np.uint64(32)).astype(np.uint32) + np.uint32(0x9E3779B1 * (band + 1) & 0xFFFFFFFF))


class Templates:
    def __init__(self, templates: dict[str, list[str]], contain: float = CONTAIN, bands: int = BANDS) -> None:
        self.contain, self.bands = contain, bands
        self.names, self.sets, self.lengths = [], [], []
        for name in sorted(templates):
            for text in templates[name]:
                own = shingles(text)
                if len(own):
                    self.names.append(name)
                    self.sets.append(np.unique(own))
                    self.lengths.append(len(own))
        every = self.every = np.unique(np.concatenate([np.empty(0, np.uint64), *self.sets]))
        self.known = np.zeros(1 << 20, bool)
        self.known[_bitmap_place(every)] = True
        self.by_block: dict[int, list[int]] = {}
        for i, n in enumerate(self.lengths):
            self.by_block.setdefault(1 << (n - 1).bit_length(), []).append(i)
        self.least = [[int(_coordinates(s, b).min()) for b in range(bands)] for s in self.sets]

    def retrieve(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(template, first, last + 1)``: windows that share a band with a template."""
        flagged = np.flatnonzero(self.known[_bitmap_place(hashes)])
        flagged = flagged[np.isin(hashes[flagged], self.every)]
        if not len(flagged):
            return
        for block, own in self.by_block.items():
            blocks = np.unique(flagged // block)
            lows = np.unique(np.concatenate([blocks, np.maximum(blocks - 1, 0)])) * block  # windows of two blocks that hold a flagged shingle
            for low in lows.tolist():
                window = hashes[low : low + 2 * block]
                open_ = set(own)
                for band in range(self.bands):
                    least = int(_coordinates(window, band).min())
                    for i in [i for i in open_ if self.least[i][band] == least]:
                        open_.discard(i)
                        yield i, low, low + len(window)
                    if not open_:
                        break

    def verify(self, template: int, hashes: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """``(share, first, last + 1)``: stretches of the template's length that hold enough of its shingles, up to the last one held.

        Two ends move over the shingles that are the template's and keep count of the distinct ones, so the time is linear.
        """
        own, n = self.sets[template], self.lengths[template]
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        places = np.flatnonzero(own[at] == hashes)
        which, places = at[places].tolist(), places.tolist()
        held, count, end = [0] * len(own), 0, 0
        for first, start in enumerate(places):
            while end < len(places) and places[end] < start + n:
                count += held[which[end]] == 0
                held[which[end]] += 1
                end += 1
            if count >= self.contain * len(own):
                yield count / len(own), start, places[end - 1] + 1
            held[which[first]] -= 1
            count -= held[which[first]] == 0

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """``(license, containment, first word, last word + 1)`` of every notice; of those that overlap the one with the most shingles, then the largest share."""
        hashes = shingles(text)
        found = set()
        for i, low, high in self.retrieve(hashes) if len(hashes) else ():
            for share, start, stop in self.verify(i, hashes[low:high]):
                found.add((round(self.lengths[i] * share, 6), share, low + start, low + stop + SHINGLE - 1, self.names[i], self.lengths[i]))
        kept: list[tuple[str, float, int, int, int]] = []
        for _, share, begin, held, name, n in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4])):
            if all(held <= b or begin >= e for _, _, b, e, _ in kept):
                kept.append((name, share, begin, held, begin + n + SHINGLE - 1))
        kept.sort(key=lambda x: x[2])
        # A shortened notice takes up less than its template's length; it ends where the next one begins.
        nexts = [x[2] for x in kept[1:]] + [np.inf]
        return [(name, share, begin, min(end, after)) for (name, share, begin, _, end), after in zip(kept, nexts, strict=False)]


def license_notices(docs: DataFrame, templates: dict[str, list[str]] | None = None, contain: float = CONTAIN, bands: int = BANDS) -> DataFrame:
    """``doc_id, license, containment, start_word, end_word``: a row for each notice in each whole text.

    Where notices overlap, the one with the most shingles stays. Words are runs of letters,
    digits and underscores. Null and empty texts have no notices; documents that
    repeat or lack an id come out as they are; other columns are ignored; an empty
    table gives an empty one.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, contain, bands))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(d, *x) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for x in shared.value.scan(t)]
            out = pd.DataFrame(found, columns=["doc_id", "license", "containment", "start_word", "end_word"])
            yield out.astype({"doc_id": "Int64"})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(scan, "doc_id long, license string, containment double, start_word int, end_word int")
