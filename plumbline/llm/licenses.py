"""License scan by template-markup matching.

A template is license wording with markup: `<<optional>> ... <<end>>` encloses words that may be left
out, `<<any:N>>` stands for up to N words of any kind (names, years, versions).  Templates compile into
token automata; an automaton accepts a place in a text if all mandatory words stand there in order,
nothing but optional or replaceable words between them.  Words follow common.py, so case, punctuation
and line breaks do not matter.

All automata run over a text together: a state is entered by its word, and the first words of the
templates are looked up in one dictionary, so a text without any of them costs only the cutting.

Defined results: null and empty texts have no words and no labels; overlapping matches of a template
count each place it begins; labels that several matches give stand once; repeated rows are treated
alike; an empty table gives an empty table.  Templates without mandatory wording and phrases without
words are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts_of, words_of

#: Phrases of the base scan and their labels: the words stand consecutively.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Full wordings, as their licenses have them; whatever may vary is marked up.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall <<any:8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
    "<<optional>> <<optional>>3<<end>> neither the name of <<any:8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission <<end>> "
    "this software is provided by <<any:8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<any:8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <<any:4>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall <<any:4>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
    "<<optional>>1<<end>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
    "<<optional>>2<<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
    "<<optional>>3<<end>> this notice may not be removed or altered from any source distribution"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
    "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any:8>> "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license"
)
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {} of the license or <<optional>>at your option<<end>> any later version"

#: Full wordings and the lines by which texts state their license, as (label, template).
TEMPLATES = (
    ("mit", _MIT),
    ("bsd", _BSD),
    ("isc", _ISC),
    ("zlib", _ZLIB),
    ("unlicense", _UNLICENSE),
    ("apache-2", _APACHE),
    ("gpl-2", _GPL.format(2)),
    ("gpl-3", _GPL.format(3)),
    ("mit", "<<optional>>this<<end>> <<any:6>> licensed under the <<optional>>terms of the<<end>> mit license"),
    ("apache-2", "licensed under the apache license <<optional>>version<<end>> 2 <<optional>>0<<end>>"),
    ("bsd", "licensed under <<optional>>the<<end>> <<any:2>> bsd <<optional>>2 clause<<end>> <<optional>>3 clause<<end>> license"),
    ("gpl-2", "gnu general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 2"),
    ("gpl-3", "gnu general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 3"),
    ("lgpl", "gnu <<optional>>lesser<<end>> <<optional>>library<<end>> general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 2 1"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 3"),
    ("mpl-2", "mozilla public license <<optional>>v<<end>> <<optional>>version<<end>> 2 0"),
    ("epl", "eclipse public license <<optional>>v<<end>> <<any:2>> 0"),
    ("cc0", "creative commons <<optional>>cc0<<end>> 1 0 universal"),
    ("cc-by", "creative commons attribution <<any:1>> 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike <<any:1>> 0 international"),
    ("cc-by-nc", "creative commons attribution noncommercial <<any:1>> 0 international"),
    ("cc-by-nc", "licensed under <<optional>>a<<end>> cc by nc <<optional>>4 0<<end>>"),
    ("all-rights-reserved", "copyright <<optional>>c<<end>> <<any:6>> all rights reserved"),
)

_MARKUP = re.compile(r"<<(optional|end|any:(\d+))>>")


@dataclass
class Automaton:
    """Token automaton over one template.  edges[state][word] are the states a word leads to; `free`
    states also take any word; skips[state] are entered without a word."""

    label: str
    edges: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0

    def _state(self) -> int:
        self.edges.append({})
        self.free.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest acceptance that begins with word `at`; -1 if there is none."""
        states, end = self.closure({0}), -1
        while True:
            if self.final in states:
                end = at
            if at >= len(words):
                return end
            word = words[at]
            states = self.closure({t for s in states for t in (*self.edges[s].get(word, ()), *self.free[s])})
            if not states:
                return end
            at += 1

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.edges[s]}


def compile_template(label: str, template: str) -> Automaton:
    """Leading and trailing markup never widens a match: a match begins and ends with wording."""
    out, at, opened = Automaton(label), 0, []
    last = 0
    for m in [*_MARKUP.finditer(template), None]:
        for word in words_of(template[last : m.start() if m else len(template)]):
            new = out._state()
            out.edges[at].setdefault(word, []).append(new)
            at = new
        if m is None:
            break
        last = m.end()
        if m[1] == "optional":
            opened.append(at)
        elif m[1] == "end":
            out.skips[opened.pop()].append(at)
        else:
            begin = at
            for _ in range(int(m[2])):
                new = out._state()
                out.free[at].append(new)
                at = new
            end = out._state()
            for s in [begin, *range(end - int(m[2]), end)]:
                out.skips[s].append(end)
            at = end
    out.final = at
    if not _mandatory_words(out):
        raise ValueError(f"template of {label} has no wording that has to stand: {template}")
    return out


def _mandatory_words(a: Automaton) -> set[bytes]:
    """The words that every acceptance holds."""

    def accepts_without(word: bytes) -> bool:
        seen, todo = set(), [0]
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            todo += [*a.skips[s], *a.free[s], *(t for w, ts in a.edges[s].items() if w != word for t in ts)]
        return a.final in seen

    return {w for e in a.edges for w in e if not accepts_without(w)}


class Scanner:
    """All templates and base phrases at once."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES):
        self.phrases = [(words_of(phrase), label) for phrase, label in phrases]
        if not all(words for words, _ in self.phrases):
            raise ValueError("a phrase without words stands everywhere")
        self.automata = [compile_template(*t) for t in templates]
        self.starts: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for word in a.first_words():
                self.starts.setdefault(word, []).append(a)
        # a text has to hold all words of a phrase, or the rarest-looking mandatory word of a template
        self.needed = [(max(words, key=len), None) for words, _ in self.phrases] + [(self._mandatory(a), a) for a in self.automata]

    @staticmethod
    def _mandatory(a: Automaton) -> bytes:
        """The longest word that every acceptance holds."""
        return max(_mandatory_words(a), key=lambda w: (len(w), w))

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Number of words; base places and template matches as (first word, word after, label)."""
        words = words_of(text)
        have = set(words)
        base: list[tuple[int, int, str]] = []
        for phrase, label in self.phrases:
            if all(w in have for w in phrase):
                base += [(i, i + len(phrase), label) for i in places(words, phrase)]
        found: list[tuple[int, int, str]] = []
        live = {id(a) for word, a in self.needed if a is not None and word in have}
        if live:
            for word, automata in self.starts.items():
                own = [a for a in automata if id(a) in live]
                if own and word in have:
                    for i in places(words, [word]):
                        found += [(i, end, a.label) for a in own if (end := a.longest(words, i)) > 0]
        return len(words), sorted(base), sorted(found)


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase begins, overlapping places included."""
    out, at = [], 0
    while True:
        try:
            at = words.index(phrase[0], at)
        except ValueError:
            return out
        if words[at : at + len(phrase)] == phrase:
            out.append(at)
        at += 1


def covered(spans: list[tuple[int, int, str]]) -> int:
    """Words that lie in any span."""
    total, end = 0, 0
    for a, b, _ in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def label_list(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(sorted({s[2] for s in spans}))


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<first_word: int, end_word: int, label: string>>"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """A row per row of docs: words, base places, labels, the templates' matches, and as score the share
    of the text's words that lie in a base place or a match."""
    prepare(docs.sparkSession)
    scanner = Scanner(templates, phrases)
    match_type = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("label", pa.string())]))

    def scan(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for text in batch["text"]:
                n, base, found = scanner.scan(text.as_py())
                row = (n, len(base), base[0][0] if base else None, base[-1][0] if base else None, label_list(base), label_list(base + found), covered(base + found) / n if n else 0.0, [{"first_word": a, "end_word": b, "label": k} for a, b, k in found])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), match_type)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return texts_of(docs).mapInArrow(scan, RESULT)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("matches").cast("long").alias("n_matches"))
