"""License scans by a positional index of rare words.

Every template is a sequence of words with mandatory phrases in it. The index holds, for the rarest words of a template, where
in it they stand. A file's words that the index knows are looked up, each template's from the highest IDF down; a word at
place p of the file that stands at place q of the template votes for the template beginning at p - q. Where the template's
rarest word votes and others agree, the mandatory phrases must stand at their places, word for word, and the rest of the
template must be there well enough. IDF comes from the document frequencies of all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import columns


@dataclass(frozen=True)
class Template:
    """label, words, mandatory phrases (all must stand in the words), and the least share of the words that must match."""

    label: str
    text: str
    mandatory: tuple[str, ...] = ()
    least: float = 0.6
    base: bool = False


#: Fixed phrases and labels that are always searched for, whole.
BASE = (
    Template("cc-by", "cc by", ("cc by",), 1.0, True),
    Template("gpl", "general public license", ("general public license",), 1.0, True),
    Template("reserved", "all rights reserved", ("all rights reserved",), 1.0, True),
)

#: Usual wordings of licence notices, with the words that none of them goes without.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    Template("mit", "released under the mit license", ("mit license",), 0.4),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("gpl", "licensed under the gnu general public license version", ("gnu general public license",), 0.4),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("is free software you can redistribute it",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",), 0.4),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",), 0.4),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 0.3),
    Template("epl", "this program is made available under the terms of the eclipse public license", ("eclipse public license",), 0.3),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",), 0.4),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",), 0.4),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",), 0.4),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",), 0.3),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0", ("waived all copyright and related rights",), 0.4),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",), 0.5),
)

#: Whole texts of short public licences as published, without the lines that name holder and year. A licence counts
#: where most of its words stand at their places; what sets it apart from its relatives is mandatory.
TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
        OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("publish distribute sublicense and or sell copies of the software", "merchantability fitness for a particular purpose and noninfringement")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ("with or without fee is hereby granted", "negligence or other tortious action")),
    ("0bsd", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""", ("with or without fee is hereby granted the software is provided as is",)),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED.""", ("materials provided with the distribution this software is provided by",)),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
        AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", ("used to endorse or promote products derived from this software without specific prior written permission",)),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
        notice may not be removed or altered from any source distribution.""", ("altered source versions must be plainly marked as such",)),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
        the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
        whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor.""", ("machine executable object code generated by a source language processor",)),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
        public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.""", ("dedicate any and all copyright interest in the software to the public domain",)),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""", ("you may obtain a copy of the license at", "distributed on an as is basis")),
    *[(f"{label}-{version}.0-or-later", f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General
        Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more
        details.""", (f"gnu {kind.lower()}general public license as published by the free software foundation", f"either version {version} of the license or at your option any later version"))
      for label, kind, versions in (("gpl", "", (2, 3)), ("lgpl", "Lesser ", (3,)), ("agpl", "Affero ", (3,))) for version in versions],
)


def plain_words(text: str) -> str:
    """A text's words as the scan sees them."""
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))


#: The texts as templates: four fifths of the words must match.
WHOLE = tuple(Template(label, plain_words(text), mandatory, 0.8) for label, text, mandatory in TEXTS)

#: How many words of a template are in the index.
ANCHORS = 3


@dataclass
class Index:
    """templates as word hashes; postings: word hash to its (template, place)s, for the rarest words of each template."""

    templates: tuple[Template, ...]
    idf: dict[int, float]
    hashes: list[np.ndarray] = field(default_factory=list)
    phrases: list[list[int]] = field(default_factory=list)
    rarest: list[list[int]] = field(default_factory=list)
    postings: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k, t in enumerate(self.templates):
            words = t.text.split()
            h = np.array([textkit.hash_word(w.encode()) for w in words], dtype=np.uint64)
            self.hashes.append(h)
            need: set[int] = set()
            for phrase in t.mandatory:
                p = phrase.split()
                at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
                need.update(range(at, at + len(p)))
            self.phrases.append(sorted(need))
            # anchors are taken from what is mandatory, so a notice that holds always has them all
            best = sorted(need, key=lambda i: (-self.idf.get(int(h[i]), math.inf), i))[:ANCHORS]
            self.rarest.append(best)
            for i in best:
                self.postings.setdefault(int(h[i]), []).append((k, i))
        self.known = np.array(sorted(self.postings), dtype=np.uint64)

    def scan(self, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(template, first word, share of the template's words that match) of every occurrence in a file's word hashes."""
        places: dict[int, list[int]] = {}
        for p in np.flatnonzero(np.isin(words, self.known)):
            places.setdefault(int(words[p]), []).append(int(p))
        votes: dict[tuple[int, int], set[int]] = {}
        by_idf = sorted(places, key=lambda h: -self.idf.get(h, math.inf))
        # a template's rarest word opens a candidate; its other words then agree with those that are open
        for opens in (True, False):
            for h in by_idf:
                for k, q in self.postings[h]:
                    if (q == self.rarest[k][0]) == opens:
                        for start in (p - q for p in places[h]):
                            if opens or (k, start) in votes:
                                votes.setdefault((k, start), set()).add(q)
        found = []
        for (k, start), agree in sorted(votes.items()):
            if len(agree) < len(self.rarest[k]):
                continue
            h = self.hashes[k]
            at = start + np.arange(len(h))
            inside = (at >= 0) & (at < len(words))
            same = np.zeros(len(h), bool)
            same[inside] = words[at[inside]] == h[inside]
            if same[self.phrases[k]].all() and same.mean() >= self.templates[k].least:
                found.append((k, start + self.phrases[k][0], float(same.mean())))
        return found


def frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[dict[int, int], int]:
    """In how many documents each word of the templates occurs, and the number of documents. The driver gets one row a word."""
    vocabulary = np.array(sorted({textkit.hash_word(w.encode()) for t in templates for w in t.text.split()}), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for piece in textkit.pieces(batch.column(0)):
                w = textkit.words(piece, textkit.ALNUM, textkit.LOWER)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == w.hash)
                doc = np.searchsorted(w.first, hit, side="right") - 1
                df += np.bincount(np.unique(at[hit] * len(piece) + doc) // len(piece), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(vocabulary)), -1)), pa.array(np.append(df, n))], ["word", "df"])

    rows = columns(docs, "text").mapInArrow(run, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    got = {r["word"]: r["df"] for r in rows}
    return {int(h): got.get(i, 0) for i, h in enumerate(vocabulary)}, got.get(-1, 0)


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES + WHOLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    docs has doc_id and text; other columns are ignored. Words are runs of digits, letters and everything beyond ASCII, with
    A-Z lower-cased. n_base counts all places of base phrases, first_word and last_word are their smallest and largest start
    (null without any). base_labels and labels are distinct, sorted and comma-joined, empty if there are none; score is the
    largest share of a template's words found, 0 without any; spans has (label, first word, share) of everything found. A
    null text counts as empty: no words, no labels. Repeated rows are scanned each.
    """
    df, n = frequencies(docs, templates)
    index = Index(templates, {h: math.log((n + 1) / (x + 1)) for h, x in df.items()})
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,share:double>>"
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("share", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for piece in textkit.pieces(batch.column(1)):
                w = textkit.words(piece, textkit.ALNUM, textkit.LOWER)
                hits = np.flatnonzero(np.isin(w.hash, index.known))
                with_hits = set((np.searchsorted(w.first, hits, side="right") - 1).tolist())
                for i in range(len(piece)):
                    found = index.scan(w.hash[w.first[i] : w.first[i + 1]]) if i in with_hits else []
                    base = [(templates[k].label, p) for k, p, _ in found if templates[k].base]
                    places = [p for _, p in base]
                    row = (
                        int(w.first[i + 1] - w.first[i]), len(base), min(places, default=None), max(places, default=None),
                        ",".join(sorted({x for x, _ in base})), ",".join(sorted({templates[k].label for k, _, _ in found})),
                        max((x for _, _, x in found), default=0.0), [{"label": templates[k].label, "first_word": p, "share": x} for k, p, x in found],
                    )
                    for col, x in zip(out, row):
                        col.append(x)
            arrays = [pa.array(x, t) for x, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return columns(docs, "doc_id", "text").mapInArrow(run, schema)
