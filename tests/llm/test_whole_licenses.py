"""Licenses that open alike, openings and gaps before the mandatory wording."""

import random
import re

from folioflux.llm import licenses
from folioflux.llm.rows import plain_words

ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
ISC_END = """. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
BSD_ADS = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This
product includes software developed by the Example Group. """
BSD_NAMES = """Neither the name of the Example Group nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE AUTHORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def labels(text, templates=licenses.TEMPLATES):
    named = list(templates.items())
    return sorted({named[k][0] for k, _, _ in licenses.Automata(named).matches(plain_words(text.encode()))})


def test_licenses_that_open_alike_are_told_apart():
    assert labels(ISC + ISC_KEEP + ISC_END) == ["isc"] and labels(ISC + ISC_END) == ["0bsd"]
    assert labels(BSD + BSD_END) == ["bsd-2"] and labels(BSD + "3. " + BSD_NAMES + BSD_END) == ["bsd-3"]
    assert labels(BSD + BSD_ADS + "4. " + BSD_NAMES + BSD_END) == ["bsd-4"]
    # Missing or altered conditions.
    assert labels(BSD) == labels(ISC) == labels(ISC + ISC_KEEP + ". Nothing else.") == []
    assert labels((BSD + BSD_END).replace("must retain", "may drop")) == []
    assert labels(BSD, licenses.EXCERPTS) == ["bsd"] and labels(ISC, licenses.EXCERPTS) == ["isc"]


def test_an_opening_belongs_to_the_span():
    text = "x To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work"
    named = list(licenses.TEMPLATES.items())
    (k, start, end), = licenses.Automata(named).matches(plain_words(text.encode()))
    assert (named[k][0], start, end) == ("cc0", 1, len(text.replace(",", "").split()))


def test_openings_agree_with_regular_expressions():
    rng = random.Random(4)
    for _ in range(300):
        opening = " ".join(rng.choice(["<<optional>>a b<<end>>", "<<any 0 2>>", "<<any 1 2>>", "<<optional>>c <<any 0 1>> a<<end>>"]) for _ in range(rng.randrange(1, 4)))
        markup = f"{opening} a <<any 0 1>> b"
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 10))]
        found = licenses.Automata([("x", markup)]).matches([w.encode() for w in words])
        assert bool(found) == bool(re.search(licenses.pattern(markup), " " + " ".join(words))), (markup, words)
        assert all(re.fullmatch(licenses.pattern(markup), "".join(" " + w for w in words[i:j])) for _, i, j in found)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or substantial portions of the Software. """
MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for
more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""


def test_mit_and_what_is_made_of_it():
    assert labels(MIT + MIT_END) == ["mit"] and labels(MIT + "The Software shall be used for Good, not Evil. " + MIT_END) == ["json"]
    assert labels((MIT + MIT_END).replace("without restriction,", "without restriction, except for commercial use,")) == []
    assert labels(MIT) == [] and labels(MIT, licenses.EXCERPTS) == ["mit"]


def test_gnu_licenses_are_told_apart():
    assert [labels(GNU.format(k, k)) for k in ("", "Lesser ", "Affero ")] == [["gpl"], ["lgpl"], ["agpl"]]
    assert labels(GNU.format("Lesser ", "")) == [] and labels(GNU.format("", ""), licenses.EXCERPTS) == ["gnu"]


def test_creative_commons_terms_are_told_apart():
    say = "This work is licensed under a Creative Commons Attribution{} International License."
    terms = {"": "cc-by", "-ShareAlike": "cc-by-sa", "-NonCommercial": "cc-by-nc", "-NoDerivatives": "cc-by-nd", "-NonCommercial-ShareAlike": "cc-by-nc-sa",
             "-NonCommercial-NoDerivatives": "cc-by-nc-nd"}
    for term, label in terms.items():
        assert labels(say.format(term + " 4.0")) == labels(say.format(term)) == [label]
    assert labels(say.format("-Sampling 4.0")) == labels("licensed under a Creative Commons International License") == []
