"""License scan: known phrases, and license texts with optional and replaceable regions.

A template is written as words with ``[[optional words]]`` and ``<<most>>``, a replaceable region of at most that many
words. It compiles to an automaton over words: each mandatory or optional word is a state, a replaceable region is a
counter, and an empty move leads past an optional or replaceable region. A text is accepted where its words lead from
the first to the last state, so all mandatory wording matches exactly and in order. The automaton runs only from places
where the template's first mandatory words stand, and places with no live state are left at once.

Rows are scanned once, without a shuffle; templates are constants. Defined cases. Null or empty text: no words, no
places, empty label strings, score 0. Very long texts are scanned whole, one at a time. Ties: of several ways to match from a
place the longest counts. Repeated rows each get their row. Empty table: no rows. Other columns stay as they are; one called
like a result's column raises ValueError, and ``prefix`` renames those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import plus
from .words import ALNUM_WORD, Words, covered, pieces, sums

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: markup. Wording of the public license texts and notices, without punctuation.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<40>> this software is provided by <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<10>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-short": "licensed under the apache license version 2 [[0]]",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] general public license as published by the free software foundation either version <<2>> of the license or at your option any later version",
    "agpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version <<2>> of the license or at your option any later version",
    "gpl-short": "licensed under the gnu [[lesser]] [[affero]] general public license [[version]] <<1>>",
    "mit-short": "[[released]] [[licensed]] under the mit license",
    "cc-by-nc-short": "licensed under [[a]] [[creative commons]] cc by nc [[sa]] [[nd]] <<2>>",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<6>>",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means <<120>> the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will <<8>> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    "boost-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "0bsd-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and <<8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "wtfpl-text": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "cc0-notice": "to the extent possible under law <<10>> has waived all copyright and related or neighboring rights to <<12>>",
}
ANCHOR_WORDS = 4


class Automaton:
    """States are places in the template; ``anchor`` is its first run of mandatory words."""

    def __init__(self, markup: str):
        #: (word, True) consumes that word; (None, most) up to most words of any kind; skips: other places reached for free.
        self.moves: list[tuple[bytes | None, int]] = []
        self.skips: dict[int, int] = {}
        mandatory: list[tuple[int, bytes]] = []
        for part in re.findall(r"\[\[.*?\]\]|<<\d+>>|[^\s\[<]+", markup):
            begin = len(self.moves)
            if part.startswith("<<"):
                self.moves.append((None, int(part[2:-2])))
                self.skips[begin] = begin + 1
            elif part.startswith("[["):
                self.moves += [(x.encode(), 1) for x in part[2:-2].split()]
                self.skips[begin] = len(self.moves)
            else:
                mandatory.append((begin, part.encode()))
                self.moves.append((part.encode(), 1))
        at, run = mandatory[0][0], []
        for place, word in mandatory[:ANCHOR_WORDS]:
            if place != at + len(run):
                break
            run.append(word)
        self.before, self.anchor = at, b" ".join(run)

    def _free(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo = list(states)
        while todo:
            place, used = todo.pop()
            on = self.skips.get(place) if not used or self.moves[place][0] is None else None
            if on is not None and (on, 0) not in states:
                states.add((on, 0))
                todo.append((on, 0))
        return states

    def match(self, words: list[bytes]) -> int:
        """Words of the longest accepted run from the start of the list, or 0."""
        states, longest = self._free({(0, 0)}), 0
        for n, word in enumerate(words):
            after = set()
            for place, used in states:
                if place == len(self.moves):
                    continue
                want, most = self.moves[place]
                if want is None:
                    if used < most:
                        after.add((place, used + 1))
                elif want == word:
                    after.add((place + 1, 0))
            states = self._free(after)
            if not states:
                break
            if (len(self.moves), 0) in states:
                longest = n + 1
        return longest

    @property
    def most(self) -> int:
        return sum(m for _, m in self.moves)


def places(data: bytes, phrase: bytes) -> Iterator[int]:
    """Where the phrase's words stand consecutively; data has a space before and after each word."""
    at = data.find(b" " + phrase + b" ")
    while at >= 0:
        yield at
        at = data.find(b" " + phrase + b" ", at + 1)


def scan_licenses(docs: DataFrame, *, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, prefix: str = "") -> DataFrame:
    """The documents and, by row: ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``spans`` (label, first word, words) and ``score``, the share of words inside license wording."""
    automata = {label: Automaton(x) for label, x in templates.items()}
    fields = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("n", T.LongType())]))), ("score", T.DoubleType())]
    fields = [(f"{prefix}{n}", t) for n, t in fields]
    if clash := {c.lower() for c in docs.columns} & {n for n, _ in fields}:
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    span_type = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("n", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text):
                w = Words(texts, ALNUM_WORD, lower=True)
                data = b" " + w.data
                k = len(texts)
                spans: list[list[tuple[str, int, int]]] = [[] for _ in range(k)]
                base: list[list[tuple[str, int]]] = [[] for _ in range(k)]
                text_of = lambda word: int(np.searchsorted(w.first, word, "right")) - 1
                for phrase, label in phrases.items():
                    n = phrase.count(" ") + 1
                    for at in places(data, phrase.encode()):
                        word = int(np.searchsorted(w.starts, at))
                        d = text_of(word)
                        if word + n <= w.first[d + 1]:
                            base[d].append((label, word - int(w.first[d])))
                            spans[d].append((label, word - int(w.first[d]), n))
                for label, a in automata.items():
                    for at in places(data, a.anchor):
                        word = int(np.searchsorted(w.starts, at))
                        d = text_of(word)
                        for begin in range(max(int(w.first[d]), word - a.before), word + 1):
                            end = min(begin + a.most, int(w.first[d + 1]))
                            n = a.match(w.slice(begin, end - begin).split(b" "))
                            if n:
                                spans[d].append((label, begin - int(w.first[d]), n))
                                break
                flat = [(d, int(w.first[d]) + b, n) for d, x in enumerate(spans) for _, b, n in x]
                inside = sums(covered(np.array([x[1] for x in flat], dtype=np.int64), np.array([x[2] for x in flat], dtype=np.int64), w.n), w.first)
                columns = [
                    pa.array(w.per_text, pa.int64()),
                    pa.array([len(x) for x in base], pa.int64()),
                    pa.array([min((p for _, p in x), default=None) for x in base], pa.int64()),
                    pa.array([max((p for _, p in x), default=None) for x in base], pa.int64()),
                    pa.array([",".join(sorted({y for y, _ in x})) for x in base], pa.string()),
                    pa.array([",".join(sorted({y for y, _, _ in x})) for x in spans], pa.string()),
                    pa.array([[{"label": y, "begin": b, "n": n} for y, b, n in sorted(x)] for x in spans], span_type),
                    pa.array(inside / np.maximum(w.per_text, 1), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(n for n, _ in fields)])

    return docs.mapInArrow(scan, plus(docs.schema, *fields))
