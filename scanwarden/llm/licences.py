"""Licence statements by phrases and template markup (operator 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.llm.shared import PLAIN_WORDS, encoded

# ---- fixed values: phrases with their labels, and templates -----------------------------------

PHRASES: dict[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: ``[...]`` may be left out, ``<n>`` stands for up to n words of any kind, all else must be there word for word. Whole licence
#: texts and notices are given whole, so that one with altered conditions is not taken for them.
TEMPLATES: dict[str, str] = {
    "agpl-3": "licensed under [the terms of] the gnu affero general public license [agpl] version 3 [0] [or [at your option] any later version]",
    "agpl-3-notice": "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of "
                     "the license [or [at your option] any later version]",
    "apache-2": "licensed under the apache license version 2 [0 [the license]]",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you "
                       "may obtain a copy of the license at <1> www apache org licenses license 2 0 unless required by applicable law or agreed to in "
                       "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
                       "either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
             "conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the "
             "following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and "
             "the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by "
             "<6> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
             "for a particular purpose are disclaimed in no event shall <6> be liable for any direct indirect incidental special exemplary or "
             "consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
             "business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
             "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3": "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
             "conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the "
             "following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and "
             "the following disclaimer in the documentation and or other materials provided with the distribution [3] neither the name of <8> "
             "nor the names of <2> contributors may be used to endorse or promote products derived from this software without specific prior "
             "written permission this software is provided by <6> as is and any express or implied warranties including but not limited to the "
             "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <6> be liable for any "
             "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
             "or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
             "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of "
             "the possibility of such damage",
    "cc-by": "licensed under [a] [the] creative commons attribution <2> [international] license",
    "cc-by-nc": "licensed under cc by nc [4 0]",
    "cc-by-sa": "licensed under cc by sa [4 0]",
    "gpl-2": "licensed under [the terms of] the gnu general public license [gpl] version 2 [or [at your option] any later version]",
    "gpl-2-notice": "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the "
                    "license [or [at your option] any later version]",
    "gpl-3": "[this <3> is] licensed under [the terms of] the gnu general public license [as published by the free software foundation] [gpl] "
             "version 3 [of the license] [or [at your option] any later version]",
    "gpl-3-notice": "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the "
                    "license [or [at your option] any later version]",
    "isc": "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that "
           "the above copyright notice and this permission notice appear in all copies the software is provided as is and <3> disclaims all "
           "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <3> be "
           "liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
           "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
           "this software",
    "lgpl-3": "licensed under [the terms of] the gnu lesser general public license [lgpl] version 3 [or [at your option] any later version]",
    "lgpl-3-notice": "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of "
                     "the license [or [at your option] any later version]",
    "mit": "[<1>] under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
                "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do "
                "so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] "
                "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any "
                "kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
                "noninfringement in no event shall <6> be liable for any claim damages or other liability whether in an action of contract tort "
                "or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2": "subject to the terms of the mozilla public license v 2 0 [<4>]",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
                 "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and "
                 "by any means",
    "zlib": "this software is provided as is without any express or implied warranty in no event will <6> be held liable for any damages arising "
            "from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
            "applications and to alter it and redistribute it freely subject to the following restrictions [1] the origin of this software must "
            "not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
            "acknowledgment in the product documentation would be appreciated but is not required [2] altered source versions must be plainly "
            "marked as such and must not be misrepresented as being the original software [3] this notice may not be removed or altered from "
            "any source distribution",
}
ALIASES = {"agpl-3-notice": "agpl-3", "apache-2-notice": "apache-2", "gpl-2-notice": "gpl-2", "gpl-3-notice": "gpl-3", "lgpl-3-notice": "lgpl-3",
           "mit-text": "mit"}


class Automaton:
    """States of a template: 0 is the start; ``words[s]`` and ``any[s]`` lead on, ``free[s]`` without a word."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        tokens = re.findall(r"\[|\]|<\d+>|[^\s\[\]<>]+", template)
        self.literals = sum(t not in "[]" and t[0] != "<" for t in tokens)
        now, opened, self.required = 0, [], 0
        for t in tokens:
            if t == "[":
                opened.append(now)
            elif t == "]":
                self.free[opened.pop()].append(now)
            elif t[0] == "<":
                start = now
                for _ in range(int(t[1:-1])):
                    new = self._state()
                    self.any[now] = new
                    now = new
                end = self._state()
                # each of the words may be missing
                for s in range(start, end):
                    self.free[s].append(end)
                now = end
            else:
                new = self._state()
                self.words[now][t.encode()] = new
                self.required += not opened
                now = new
        self.accept = now
        self.closed = [self._reach(s) for s in range(len(self.words))]
        plain = [t for t in re.sub(r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]|<\d+>", " | ", template).split("|") if t.strip()]
        self.anchor = max((" ".join(x.split()) for x in plain), key=len).encode()
        # an accepted run has at most so many words, so its anchor stands at most so many after its start
        self.longest = self.literals + sum(int(t[1:-1]) for t in tokens if t[0] == "<")

    def _state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.words) - 1

    def _reach(self, state: int) -> frozenset[int]:
        seen, stack = {state}, [state]
        while stack:
            for x in self.free[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return frozenset(seen)

    def share(self, length: int) -> float:
        """Half for the mandatory wording, the rest by how much of the optional words an accepted run can hold."""
        more = self.literals - self.required
        return 1.0 if not more else 0.5 + 0.5 * min(1.0, max(0, length - self.required) / more)

    def accepts(self, words: Sequence[bytes], start: int) -> int | None:
        """Length of the longest accepted run of words from ``start``; None if there is none."""
        states, best = self.closed[0], None
        at = start
        while True:
            if self.accept in states:
                best = at - start
            if at >= len(words):
                return best
            after: set[int] = set()
            for s in states:
                if (x := self.words[s].get(words[at])) is not None:
                    after |= self.closed[x]
                if (x := self.any[s]) is not None:
                    after |= self.closed[x]
            if not after:
                return best
            states, at = frozenset(after), at + 1


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which a phrase stands; ``joined`` has a space around every word."""
    probe, at, seen, number = b" " + phrase + b" ", 0, 0, 0
    while (at := joined.find(probe, at)) >= 0:
        number += joined.count(b" ", seen, at)
        seen = at
        yield number
        at += 1


def scan(text: bytes, phrases: Mapping[bytes, str], automata: Mapping[str, Automaton]) -> tuple:
    """Number of words; places of phrases, first and last; their labels; all labels; score."""
    words = text.translate(PLAIN_WORDS).split()
    if not words:
        return 0, 0, None, None, [], [], 0.0
    joined = b" " + b" ".join(words) + b" "
    base: list[int] = []
    labels: set[str] = set()
    for phrase, label in phrases.items():
        found = list(places(joined, phrase))
        base += found
        if found:
            labels.add(label)
    every, score = set(labels), 0.0
    for label, automaton in automata.items():
        for anchor in places(joined, automaton.anchor):
            # the statement may begin before its longest fixed wording, by as many words as the template allows
            for start in range(max(0, anchor - automaton.longest), anchor + 1):
                length = automaton.accepts(words, start)
                if length and start + length > anchor:
                    every.add(ALIASES.get(label, label))
                    score = max(score, automaton.share(length))
                    break
    if labels and not score:
        score = 0.5
    return len(words), len(base), min(base, default=None), max(base, default=None), sorted(labels), sorted(every), score


_ROWS = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                   ("base", pa.list_(pa.string())), ("every", pa.list_(pa.string())), ("score", pa.float64())])


def licences(docs: DataFrame, ident: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES,
             templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Licence labels of each whole text, one row per row of ``docs``.

    Returns ``doc_id``, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (of those), ``base_labels``
    and ``labels`` (arrays; the second adds templates that are matched), ``score`` (0.5 for a phrase or a template's mandatory
    wording, up to 1 with the optional; 0 without any). A null
    text counts as empty; a text of any length is read whole; rows that repeat are scanned each; an empty table gives no
    rows; other columns are ignored.
    """
    kind = docs.schema[ident].dataType.simpleString()
    wanted = {k.encode(): v for k, v in phrases.items()}
    automata = {k: Automaton(v) for k, v in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x or b"", wanted, automata) for x in encoded(batch.column(1))]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _ROWS.types)] if rows else [pa.array([], t) for t in _ROWS.types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_ROWS.names])

    source = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = source.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, every array<string>, score double")
    return out.withColumnsRenamed({"base": "base_labels", "every": "labels"})
