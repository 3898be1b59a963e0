"""License scans by template markup: each template becomes an automaton over words.

Markup: <<optional>> ... <<end>> may be left out, <<any LEAST MOST>> stands for that many words of any kind.
All other wording is mandatory and must match word for word. All templates run together: a text word that can
begin a template starts its automaton there, and the states it can be in move on with each word. What may stand
before a template's first mandatory word is matched backwards from there, so an optional opening or a gap for a name
does not make every word a start.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from folioflux.llm.rows import attach, plain_words

# Phrases that name a license, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
    <<optional>>and associated documentation files<<end>> <<optional>>(the "Software")<<end>>, to deal in the Software
    without restriction"""
_MIT_RIGHTS = """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
    and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice <<optional>>(including the next
    paragraph)<<end>> shall be included in all copies or substantial portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
    LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
    <<any 1 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
_ISC = """Permission to use, copy, modify, <<optional>>and<<end>> <<optional>>or<<end>> distribute this software for any
    purpose with or without fee is hereby granted"""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND <<any 1 12>> <<optional>>DISCLAIMS<<end>> <<optional>>DISCLAIM<<end>>
    ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
    SHALL <<any 1 12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
    RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
    ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met"""
_BSD_SOURCE = """: <<optional>>1<<end>> Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. <<optional>>2<<end>> Redistributions in binary form must reproduce the above
    copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
    provided with the distribution."""
_BSD_ADVERTISING = """<<optional>>3<<end>> All advertising materials mentioning features or use of this software must display
    the following acknowledgement: This product includes software developed by <<any 1 16>>"""
_BSD_NAMES = """<<optional>>3<<end>> <<optional>>4<<end>> Neither the name of <<any 1 12>> nor the names of
    <<optional>>its<<end>> <<optional>>their<<end>> <<optional>>any<<end>> contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<any 1 16>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
    SHALL <<any 1 16>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
    (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
    INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
    NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
    DAMAGE"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); <<any 0 1>> you may not use
    <<optional>>this file<<end>> <<optional>>this work<<end>> except in compliance with the License"""
_GPL = """you can redistribute it and/or modify it under the terms of the GNU <<optional>>Lesser<<end>>
    <<optional>>Affero<<end>> General Public License as published by the Free Software Foundation"""


def _gnu(kind: str) -> str:
    """The notice of a GNU license, whose name stands in it three times."""
    return f"""you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the
        Free Software Foundation; <<optional>>either<<end>> version <<any 1 2>> of the License <<optional>>, or (at your option)
        any later version<<end>>. <<any 1 6>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public
        License for more details. You should have received a copy of the GNU {kind} General Public License along with
        <<any 1 6>> if not <<any 1 24>>"""


def _creative(terms: str) -> str:
    """The notice of a Creative Commons license of some terms."""
    return f"""licensed under a Creative Commons Attribution {terms} <<optional>>3.0<<end>> <<optional>>4.0<<end>>
        <<optional>>International<<end>> <<optional>>Unported<<end>> License"""


_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, <<optional>>v. 2.0<<end>>"

# Public wording of well-known licenses, or of the notice a long license gives for use in its place, with the parts that
# may vary marked.
TEMPLATES = {
    "mit": f"{_MIT}{_MIT_RIGHTS} {_MIT_DISCLAIMER}",
    "json": f"{_MIT}{_MIT_RIGHTS} The Software shall be used for Good, not Evil. {_MIT_DISCLAIMER}",
    "isc": f"""{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.
        {_ISC_DISCLAIMER}""",
    "0bsd": f"{_ISC}. {_ISC_DISCLAIMER}",
    "bsd-2": f"{_BSD}{_BSD_SOURCE} {_BSD_DISCLAIMER}",
    "bsd-3": f"{_BSD}{_BSD_SOURCE} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "bsd-4": f"{_BSD}{_BSD_SOURCE} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "apache-2": f"""{_APACHE}. You may obtain a copy of the License at <<any 1 12>> Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License""",
    "gpl": _gnu(""), "lgpl": _gnu("Lesser"), "agpl": _gnu("Affero"),
    "mpl-2": f"""{_MPL}. If a copy of the MPL was not distributed with this file, You can obtain one at
        <<optional>>http<<end>> <<optional>>https<<end>> mozilla.org/MPL/2.0""",
    "cc-by": _creative(""), "cc-by-sa": _creative("ShareAlike"), "cc-by-nc": _creative("NonCommercial"), "cc-by-nd": _creative("NoDerivatives"),
    "cc-by-nc-sa": _creative("NonCommercial-ShareAlike"), "cc-by-nc-nd": _creative("NonCommercial-NoDerivatives"),
    "cc0": """<<optional>>to the extent possible under law<<end>> <<any 0 6>> has waived all copyright and related or
        neighboring rights <<optional>>to this work<<end>>""",
}
# How licenses open; these tell nothing about the conditions that follow and do not count for the score.
EXCERPTS = {"mit": _MIT, "gnu": _GPL, "isc": _ISC, "bsd": _BSD, "apache-2": _APACHE, "mpl-2": _MPL}

SPAN = StructType([StructField("label", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
FOUND = [StructField("n_words", LongType()), StructField("phrases", ArrayType(SPAN)), StructField("templates", ArrayType(SPAN)),
         StructField("excerpts", ArrayType(SPAN)), StructField("score", DoubleType())]


def parse(markup: str) -> list:
    """A nested list: words, (least, most) gaps and lists of optional parts."""
    stack: list[list] = [[]]
    for tag, text in re.findall(r"<<(.*?)>>|((?:(?!<<).)+)", markup, re.S):
        if tag == "optional":
            stack.append([])
        elif tag == "end":
            part = stack.pop()
            stack[-1].append(part)
        elif tag:
            stack[-1].append(tuple(map(int, tag.split()[1:])))
        else:
            stack[-1] += plain_words(text.encode())
    if len(stack) != 1:
        raise ValueError("an optional part has no end")
    return stack[0]


def backwards(parts: list) -> list:
    return [backwards(p) if isinstance(p, list) else p for p in reversed(parts)]


class Automata:
    """States of all templates; a state moves by a word, by any word, or by nothing over what may be left out."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.word: list[tuple[bytes, int] | None] = []
        self.any: list[int | None] = []
        self.free: list[list[int]] = []
        self.accept: dict[int, int] = {}
        self.first: dict[bytes, set[int]] = defaultdict(set)
        self.reach: dict[int, frozenset[int]] = {}
        # By the start state of a template: where its opening, read backwards, starts.
        self.opening: dict[int, int] = {}
        starts = []
        for k, (_, markup) in enumerate(templates):
            parts = parse(markup)
            at = next((n for n, p in enumerate(parts) if isinstance(p, bytes)), 0)
            starts.append(self.state())
            self.accept[self.add(parts[at:], starts[-1])] = k
            if at:
                self.opening[starts[-1]] = self.state()
                self.accept[self.add(backwards(parts[:at]), self.opening[starts[-1]])] = k
        self.anywhere: set[int] = set()
        for s in starts:
            for q in self.closed(s):
                if q in self.accept:
                    raise ValueError("a template has no mandatory wording")
                if self.any[q] is not None:
                    self.anywhere.add(s)
                elif self.word[q]:
                    self.first[self.word[q][0]].add(s)

    def state(self) -> int:
        self.word.append(None)
        self.any.append(None)
        self.free.append([])
        return len(self.word) - 1

    def add(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, list):
                end = self.add(part, at_ := self.state())
                self.free[at] += [at_, end]
                at = end
                continue
            least, most = part if isinstance(part, tuple) else (1, 1)
            skips = []
            for n in range(most):
                if n >= least:
                    skips.append(at)
                after = self.state()
                if isinstance(part, tuple):
                    self.any[at] = after
                else:
                    self.word[at] = (part, after)
                at = after
            for s in skips:
                self.free[s].append(at)
            # A fresh state, so that a following part cannot add to one that skips lead to.
            after = self.state()
            self.free[at].append(after)
            at = after
        return at

    def closed(self, state: int) -> frozenset[int]:
        if state not in self.reach:
            seen, todo = {state}, [state]
            while todo:
                for q in self.free[todo.pop()]:
                    if q not in seen:
                        seen.add(q)
                        todo.append(q)
            self.reach[state] = frozenset(seen)
        return self.reach[state]

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end) of the longest acceptance from each start, with the longest opening before it."""
        found, first = [], self.first
        starts = range(len(words)) if self.anywhere else [i for i, w in enumerate(words) if w in first]
        for i in starts:
            for s in first.get(words[i], set()) | self.anywhere:
                name, end = self.run(s, words, i, 1)
                begin = i
                if name is not None and s in self.opening:
                    opened, begin = self.run(self.opening[s], words, i - 1, -1)
                    name, begin = (None, i) if opened is None else (name, begin + 1)
                if name is not None:
                    found.append((name, begin, end))
        return found

    def run(self, start: int, words: list[bytes], at: int, step: int) -> tuple[int | None, int]:
        """The template that the longest acceptance from ``at`` on completes, if any, and the place after it."""
        now, best = self.closed(start), at
        name = next((self.accept[q] for q in now if q in self.accept), None)
        while now and 0 <= at < len(words):
            moved = set()
            for q in now:
                if self.word[q] and self.word[q][0] == words[at]:
                    moved |= self.closed(self.word[q][1])
                if self.any[q] is not None:
                    moved |= self.closed(self.any[q])
            now, at = moved, at + step
            for q in now:
                if q in self.accept:
                    best, name = at, self.accept[q]
        return name, best


def scan_licenses(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None,
                  templates: dict[str, str] | None = None, excerpts: dict[str, str] | None = None) -> DataFrame:
    """Every input row with n_words, phrases, templates and excerpts (label, first word, end), and score.

    score: 1 where a template's mandatory wording matches, 0.5 where only a phrase names a license, else 0. Excerpts tell
    where a license opens, whatever follows, and leave the score as it is.
    A null or empty text has no words and scores 0. Rows are judged one by one, so repeated rows, ties and rows
    without id each get their result. Input columns that clash with a result are replaced.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    excerpts = EXCERPTS if excerpts is None else excerpts
    named = [*[(label, p) for p, label in phrases.items()], *templates.items(), *excerpts.items()]
    whole_from, part_from = len(phrases), len(phrases) + len(templates)

    def make():
        automata = Automata(named)

        def fn(texts):
            out = []
            for t in texts:
                words = plain_words(t)
                found = automata.matches(words)
                base = [(named[k][0], i, j) for k, i, j in found if k < whole_from]
                whole = [(named[k][0], i, j) for k, i, j in found if whole_from <= k < part_from]
                part = [(named[k][0], i, j) for k, i, j in found if k >= part_from]
                out.append((len(words), base, whole, part, 1.0 if whole else 0.5 if base else 0.0))
            return list(zip(*out, strict=True)) or [[]] * len(FOUND)
        return fn

    return attach(docs, text, FOUND, make)


def pattern(markup: str) -> str:
    """The same template as a regular expression over words joined by single spaces, each with a space before it."""
    def text(parts):
        return "".join(f"(?:{text(p)})?" if isinstance(p, list) else f"(?: [^ ]+){{{p[0]},{p[1]}}}" if isinstance(p, tuple)
                       else " " + p.decode() for p in parts)
    return text(parse(markup)) + "(?: |$)"
