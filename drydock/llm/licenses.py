"""License scans: winnowed template fingerprints in an inverted index, then banded alignment.

Null or empty texts give no row; each stretch of a document that matches a template is one
row, so repeated notices give several; ties of overlapping matches go to more matched words. Rows of a null or
repeated doc_id are scanned like others; texts of any length are read whole; an empty table gives no
rows; only doc_id and text are read, so further columns cannot clash.
"""
import re
from collections import Counter

import xxhash

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. "
_WARRANTY = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
_gnu = lambda what, name, version: (_GNU.format(what, name, version) + _WARRANTY.format(what, name), _GNU.format(what, name, version))
#: Notices to find (fixed values): one text or several for each name; callers may pass their own.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", *_gnu("program", "General Public License", 3)),
    "GPL-2.0": _gnu("program", "General Public License", 2),
    "LGPL-3.0": _gnu("library", "Lesser General Public License", 3), "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1"), "LGPL-2.0": _gnu("library", "Library General Public License", 2),
    "AGPL-3.0": _gnu("program", "Affero General Public License", 3),
    "MIT": ("Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": _BSD + _AS_IS, "BSD-3-Clause": _BSD + _BSD3 + _AS_IS,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.", "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "All-rights-reserved": "All rights reserved.",
}
WORD = re.compile(r"[^\W_]+")
#: Words that tell licenses of one family apart: a match may neither lack one of its template nor hold another.
TELLING = {"nc", "sa", "nd", "lesser", "library", "affero"}


def telling(name, words):
    """The words of a template that a match must hold: those of its name and of TELLING."""
    return Counter(w for w in words if w in TELLING or w in {x.lower() for x in WORD.findall(name)})


def winnow(words, k=2, window=2):
    """(position, hash) of the least k-gram hash in each window; the rightmost of equal ones."""
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k])) for i in range(len(words) - k + 1)]
    return sorted({min(((h[j], -j) for j in range(i, min(i + window, len(h))))) for i in range(max(1, len(h) - window + 1))}) if h else []


def aligned(doc, at, template, band):
    """Banded alignment of a template near diagonal `at`: (matched, first, last) in doc words."""
    best, prev = (0, at, at), {}
    for i, w in enumerate(template):
        row = {}
        for j in range(max(0, at + i - band), min(len(doc), at + i + band + 1)):
            up, left, diag = prev.get(j), row.get(j - 1), prev.get(j - 1, (0, j, j))
            cand = [(diag[0] + 1, diag[1] if diag[0] else j, j)] if doc[j] == w else []
            row[j] = max([c for c in (up, left) if c] + cand + [(0, j, j)], key=lambda c: (c[0], -(c[2] - c[1])))
            best = max(best, row[j], key=lambda c: (c[0], -(c[2] - c[1])))
        prev = row
    return best


def scan(docs, templates=None, coverage=0.8, band=3):
    """doc_id, license, coverage, n_matched, begin, end (character span in the text).

    The band is an eighth of a template's words, `band` at least. Templates of 16 words or
    more are found by winnowed runs of 3 words: if 4 of 5 words match, a run of 4 is left, and of the two
    runs of 3 in it one is kept. What coverage leaves open, the words that tell licenses apart decide.
    """
    words = {(n, i): [w.lower() for w in WORD.findall(t)] for n, ts in (templates or TEMPLATES).items() for i, t in enumerate([ts] if isinstance(ts, str) else ts)}
    index, bands = {}, {n: max(band, len(w) // 8) for n, w in words.items()}
    for n, w in words.items():
        for h, at in winnow(w, 3, 2) if len(w) >= 16 else winnow(w):
            index.setdefault(h, []).append((n, -at))
    first = {w for ws in words.values() for w in ws}
    bags = {n: Counter(w) for n, w in words.items()}
    own = {n: telling(n[0], w) for n, w in words.items()}

    def run(batches):
        import pyarrow as pa
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places = [m.span() for m in WORD.finditer(t or "")]
                doc = [t[x:y].lower() for x, y in places]
                known = [w in first for w in doc]
                found, seen = {}, set()
                for j in range(len(doc) - 1):
                    if not (known[j] and known[j + 1]):
                        continue
                    runs = [" ".join(doc[j:j + 2])] + ([" ".join(doc[j:j + 3])] if j + 2 < len(doc) and known[j + 2] else [])
                    for n, i in [x for r in runs for x in index.get(xxhash.xxh64_intdigest(r), ())]:
                        if (n, j - i) in seen:  # one diagonal, one alignment
                            continue
                        seen.add((n, j - i))
                        w, k = words[n], bands[n]
                        near = Counter(doc[max(0, j - i - k):max(0, j - i + len(w) + k)])
                        if sum(min(c, near[x]) for x, c in bags[n].items()) < coverage * len(w):
                            continue  # no alignment matches more words than both have
                        m, x, y = aligned(doc, j - i, w, k)
                        if m >= coverage * len(w):
                            here = Counter(doc[x:y + 1])
                            if all(here[k] >= c for k, c in own[n].items()) and not any(here[k] > own[n][k] for k in TELLING):
                                found[n, x, y] = m
                base = len(rows)  # overlaps count within this row of the table only
                for (n, x, y), m in sorted(found.items(), key=lambda f: (-f[1], len(words[f[0][0]]), f[0])):
                    if not any(places[x][0] < r[5] and r[4] < places[y][1] for r in rows[base:]):
                        rows.append((d, n[0], m / len(words[n]), m, places[x][0], places[y][1]))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "license", "coverage", "n_matched", "begin", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, n_matched long, begin long, end long")
