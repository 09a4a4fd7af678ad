"""License scans with patience alignment.

A text and a template are aligned on words that occur once in both: the longest increasing subsequence of these anchors
is kept, and the gaps between anchors are aligned in the same way (words may be unique inside a gap that are not in the
whole). Equal words next to an anchor or to a gap's ends extend the alignment. Coverage is the share of a template's words
that are aligned.

A notice may stand in a text more than once, where none of its words is unique. So a template is aligned with stretches of
about its length as well, one from each of its words in the text and of each width in WIDTHS, then with what lies between
the occurrences found, and with the whole text. Of stretches that overlap the closest alignment counts: twice the aligned
words less the words it spans. An alignment that spans more than MOST_SPREAD words for each aligned one is none: words that
lie about a text by themselves are no notice.

Common words make up most of a short notice, so its name must be there: words in `required` have to be aligned. And what
one template explains better isn't reported for another: an occurrence that lies within that of a template with more
aligned words and no lower coverage is left out.

Documents are rows of tasks and templates are few and fixed, so nothing is shuffled. A template is skipped for a text
when the words they share, counted with multiplicity, cannot reach the least coverage, and a stretch likewise; that bound
drops no result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, chunks, utf8, words

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
#: Notices by which licences are named in texts, openings of long licences and whole texts of short ones.
TEMPLATES = {
    "bsd-2-clause": _BSD + _AS_IS,
    "bsd-3-clause": (
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. " + _AS_IS
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
        "but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": "Released under the MIT License",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
}

#: Words without which a short notice is none.
REQUIRED = {"apache-2.0": ["apache"], "mit": ["mit"], "gpl-3.0": ["gnu", "general", "public"], "cc-by-nc-4.0": ["cc", "by", "nc"]}

#: Words that an alignment spans for each aligned one at most.
MOST_SPREAD = 3
#: Bytes of all templates at most.
TEMPLATE_BYTES = 8 << 20
#: Widths of stretches, in lengths of the template.
WIDTHS = (1, 1.5, 2, 4)


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct values."""
    tails: list[int] = []
    at_tail: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        p = bisect_left(tails, v)
        before[k] = at_tail[p - 1] if p else -1
        if p == len(tails):
            tails.append(v)
            at_tail.append(k)
        else:
            tails[p], at_tail[p] = v, k
    out, k = [], at_tail[-1] if at_tail else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _once(seq: list[int], low: int, high: int) -> dict[int, int]:
    """Places of the values that occur once in seq[low:high]."""
    seen: dict[int, int] = {}
    for k in range(low, high):
        seen[seq[k]] = -1 if seq[k] in seen else k
    return {v: k for v, k in seen.items() if k >= 0}


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        own, other = _once(text, a, b), _once(template, c, d)
        pairs = sorted((own[v], k) for v, k in other.items() if v in own)
        chosen = [pairs[k] for k in _increasing([k for _, k in pairs])]
        if not chosen:
            continue
        out += chosen
        ends = [(a - 1, c - 1), *chosen, (b, d)]
        gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:]) if x + 1 < u and y + 1 < v]
    return sorted(out)


def _stretches(text: list[int], template: list[int], least: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Stretches of text[low:high] that start with a word of the template and hold `least` of its words at least, with
    multiplicity. A stretch equal to the template stands alone: none starts inside it."""
    needs: dict[int, int] = {}
    for v in template:
        needs[v] = needs.get(v, 0) + 1
    size = len(template)
    widths = sorted({max(1, int(w * size)) for w in WIDTHS})
    places = [k for k in range(low, high) if text[k] in needs]
    have, end = dict.fromkeys(needs, 0), [0] * len(widths)
    shared, skip = 0, low
    for p, k in enumerate(places):
        while end[-1] < len(places) and places[end[-1]] < k + widths[-1]:
            v = text[places[end[-1]]]
            shared += have[v] < needs[v]
            have[v] += 1
            end[-1] += 1
        if k >= skip and shared >= least:
            if text[k : k + size] == template and k + size <= high:
                yield k, k + size
                skip = k + size
            else:
                for w in widths:
                    yield k, min(k + w, high)
        have[text[k]] -= 1
        shared -= have[text[k]] < needs[text[k]]


def occurrences(text: list[int], template: list[int], least: float, required: frozenset[int] = frozenset()) -> tuple[list[tuple], tuple | None]:
    """(aligned words, first place, last place) of the template's occurrences that do not overlap, in order, and of the
    alignment of most words. least: of coverage; required: words that have to be aligned."""

    def aligned(a: int, b: int) -> tuple | None:
        pairs = align(text[a:b], template)
        if not pairs or len(pairs) / len(template) < least or pairs[-1][0] - pairs[0][0] >= MOST_SPREAD * len(pairs):
            return None
        return (len(pairs), a + pairs[0][0], a + pairs[-1][0]) if required <= {template[k] for _, k in pairs} else None

    need = next(n for n in range(len(template) + 1) if n / len(template) >= least)
    seen = {x for a, b in _stretches(text, template, max(1, need), 0, len(text)) if (x := aligned(a, b))}
    whole = aligned(0, len(text))
    taken: list[tuple] = []
    used = np.zeros(len(text), bool)
    for x in sorted(seen, key=lambda x: (x[2] - x[1] + 1 - 2 * x[0], x[1])):
        if not used[x[1] : x[2] + 1].any():
            taken.append(x)
            used[x[1] : x[2] + 1] = True
    # What is spread wider, between these and over the whole.
    edges = [-1, *sorted(k for x in taken for k in x[1:]), len(text)]
    gaps = list(zip(edges[::2], edges[1::2]))
    while gaps:
        a, b = gaps.pop()
        if b - a - 1 >= need and (x := aligned(a + 1, b)):
            taken.append(x)
            gaps += [(a, x[1]), (x[2], b)]
    best = max([*taken, *([whole] if whole else [])], key=lambda x: (x[0], x[1] - x[2]), default=None)
    return sorted(taken, key=lambda x: x[1]), best


FOUND = "doc_id bigint, license string, coverage double, n_aligned bigint, first_word bigint, last_word bigint, found array<struct<license: string, coverage: double, n_aligned: bigint, first_word: bigint, last_word: bigint>>"


def templates_of(table: DataFrame, most_bytes: int = TEMPLATE_BYTES) -> dict[str, str]:
    """A table of whole licence texts (name, text) as templates; of rows that share a name the first text counts, rows of a
    null name or text are left out. They go to each task, so together they may hold most_bytes, else it is an error."""
    known = table.where("name is not null and text is not null").groupBy("name").agg(F.min("text").alias("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"templates hold {size} bytes, {most_bytes} at most")
    return {r["name"]: r["text"] for r in known.collect()}


def _unexplained(found: list[tuple]) -> list[tuple]:
    """Occurrences (name, coverage, aligned words, first and last place) in order of place that lie within no better one of another
    template."""
    out, over = [], []
    for x in sorted(found, key=lambda x: (x[3], -x[4], -x[2])):
        over = [y for y in over if y[4] >= x[3]]  # of each template one at most
        if not any(y[0] != x[0] and x[4] <= y[4] and y[2] > x[2] and y[1] >= x[1] for y in over):
            out.append(x)
        over.append(x)
    return sorted(out, key=lambda x: (x[3], x[0]))


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.6, required: dict[str, list[str]] = REQUIRED) -> DataFrame:
    """All templates in each document at all their places, and the one that covers best, over whole texts.

    docs: doc_id, text; other columns are ignored. Words are lower-cased runs of letters, digits and non-ASCII characters.
    One row per row of docs: doc_id, license, coverage, n_aligned, first_word, last_word (places of the first and last
    aligned word), of the best, and found: the same for every occurrence of every template that reaches `least`, by place.
    Occurrences of one template do not overlap, those of different ones may unless one explains the other. required: by
    template, words (in lower case) that an occurrence must have. Of equal coverage the template with more
    aligned words wins, then the first by name. Where none reaches `least`, license and places are null, coverage and
    n_aligned 0 and found is empty; so for null and empty texts. Templates without words are left out; repeated rows get
    equal results; an empty table gives no rows.
    """
    names = sorted(templates)
    data, offsets = utf8(pa.array([templates[k] for k in names], pa.string()))
    read = words(data, offsets, ALNUM)
    hashes = read.hashes(1)
    known, numbers = np.unique(hashes, return_inverse=True)
    sequences = [numbers[a:b].tolist() for a, b in zip(read.first[:-1], read.first[1:])]
    needs = np.array([np.bincount(s, minlength=len(known)) for s in sequences]).reshape(len(names), len(known))
    lengths = needs.sum(1)
    spelled = {data[s : s + n].tobytes().lower(): k for s, n, k in zip(read.start.tolist(), read.length.tolist(), numbers.tolist())}
    must = [frozenset(spelled.get(w.encode(), -2) for w in required.get(name, ())) for name in names]
    fields = ["license", "coverage", "n_aligned", "first_word", "last_word"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows: list[tuple] = []
            for i, j in chunks(offsets):
                found = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                h = found.hashes(1)
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    number = np.where(known[at] == h, at, -1)
                else:
                    number = np.full(len(h), -1)
                for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
                    own = number[a:b]
                    have = np.bincount(own[own >= 0], minlength=len(known))
                    possible = np.flatnonzero((np.minimum(needs, have).sum(1) >= least * lengths) & (lengths > 0))
                    best, all_found = None, []
                    # Words that no template has only stand apart, so they stay as they are: -1 is in no template.
                    text = own.tolist() if len(possible) else []
                    for t in possible.tolist():
                        if not must[t] <= {*own.tolist()}:
                            continue
                        taken, top = occurrences(text, sequences[t], least, must[t])
                        all_found += [(names[t], n / int(lengths[t]), n, x, y) for n, x, y in taken]
                        if top and (best is None or (top[0] / int(lengths[t]), top[0]) > best[:2]):
                            best = (top[0] / int(lengths[t]), top[0], names[t], top[1], top[2])
                    all_found = _unexplained(all_found)
                    rows.append((*((best[2], best[0], best[1], best[3], best[4]) if best else (None, 0.0, 0, None, None)), [dict(zip(fields, x)) for x in all_found]))
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            kinds.append(pa.list_(pa.struct(list(zip(fields, kinds)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=["doc_id", *fields, "found"])

    return docs.select("doc_id", "text").mapInArrow(scan, FOUND)
