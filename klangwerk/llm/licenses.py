"""License scan by a positional rare-token index (operator 9).

Licence templates are indexed by word and position.  Corpus document frequencies of the templates' words (counted over
all documents) rank a file's licence words; its rarest ones are looked up, and their postings are intersected by
relative position: hits of one template that agree on where the template would start form a candidate.  A candidate
counts if all mandatory key phrases of its template stand in the text near that place.  Labels whose words the base
phrases state are always reported.

Two passes over the texts, no shuffle but the sum of at most a few hundred word counts; the index depends on the
templates only.  Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .wordcodes import list_codes, slices, without_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that state a licence by themselves, and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str  # what is indexed
    keys: tuple[str, ...]  # phrases that must stand near the place found


def _gnu(program: str, name: str, version: str) -> str:
    return (f"{program} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, "
            "or (at your option) any later version.")


_GNU_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."
_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

#: Licences and notices as they are commonly written, whole or by their sentences.
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("permission is hereby granted free of charge",)),
    ("mit", "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
     "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software "
     "or the use or other dealings in the Software.", ("in no event shall the authors or copyright holders be liable", "noninfringement")),
    ("mit", "released under the MIT License", ("mit license",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license",)),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License.", ("specific language governing permissions and limitations",)),
    ("gpl-3", f"This work is licensed under the {_GPL}, version 3", ("gnu general public license", "version 3")),
    ("gpl-2", f"This program is free software under the terms of the {_GPL}, version 2", ("gnu general public license", "version 2")),
    ("gpl-3", _gnu("This program", _GPL, "3"), ("gnu general public license", "version 3")),
    ("gpl-2", _gnu("This program", _GPL, "2"), ("gnu general public license", "version 2")),
    ("lgpl", _gnu("This library", _LGPL, "2.1"), ("gnu lesser general public license",)),
    ("lgpl", f"under the terms of the {_LGPL}", ("gnu lesser general public license",)),
    ("lgpl", f"This library {_GNU_WARRANTY.format(_LGPL)}", ("gnu lesser general public license",)),
    ("agpl-3", _gnu("This program", _AGPL, "3"), ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
     "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution.", ("redistribution and use in source and binary forms",)),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products derived from this software",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
     ("with or without fee is hereby granted",)),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", ("origin of this software must not be misrepresented",)),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
     "distribute, execute, and transmit the Software", ("any person or organization obtaining a copy",)),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
     "for any purpose, commercial or non-commercial, and by any means.", ("unencumbered software released into the public domain",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 public domain dedication", ("waived all copyright",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons", "noncommercial")),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons", "sharealike")),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("proprietary", "Copyright. All rights reserved.", ("all rights reserved",)),
)


def plain_words(text: str) -> list[str]:
    """The words of a text as the scan sees them."""
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


TEMPLATES = tuple(Template(label, " ".join(plain_words(text)), keys) for label, text, keys in TEXTS)
#: Documents and bytes of text whose words are held at once.
SLICE_DOCS, SLICE_BYTES = 1000, 4_000_000
RARE_WORDS = 12  # looked up per file and template: all places of its rarest licence words
MIN_AGREEING = 2  # hits that must agree on a template's start
SLACK = 3  # words by which hits of one place may be off
MIN_SCORE = 0.5  # share of the template's words found in their place

OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string"


def _index():
    vocabulary = sorted({w for t in TEMPLATES for w in t.text.split()} | {w for t in TEMPLATES for k in t.keys for w in k.split()} | {w for p, _ in BASE_PHRASES for w in p.split()})
    number = {w: i for i, w in enumerate(vocabulary)}
    postings = defaultdict(list)
    for t, template in enumerate(TEMPLATES):
        for at, w in enumerate(template.text.split()):
            postings[number[w]].append((t, at))
    words_of = [({number[w] for w in t.text.split()}, {number[w] for k in t.keys for w in k.split()}) for t in TEMPLATES]
    return vocabulary, number, postings, words_of


def scan_words(places: list[int], ids: list[int], n_words: int, weights: list[float], index=None) -> tuple:
    """Columns of OUT after doc_id.  places: positions of licence words in the text; ids: which words stand there."""
    vocabulary, number, postings, _ = index = index or _index()
    if not places:
        return n_words, 0, None, None, "", "", 0.0, ""
    at = dict(zip(places, ids))
    base, labels = [], set()
    for phrase, label in BASE_PHRASES:
        want = [number[w] for w in phrase.split()]
        for p, i in at.items():
            if i == want[0] and all(at.get(p + k) == w for k, w in enumerate(want)):
                base.append((p, p))
                labels.add(label)
    base_labels = set(labels)
    by_word = defaultdict(list)
    for p, i in zip(places, ids):
        by_word[i].append(p)
    votes = defaultdict(set)  # (template, start) -> template positions that agree
    for t in range(len(TEMPLATES)):
        own, needed = index[3][t]
        if not needed <= by_word.keys():  # a key phrase cannot stand in this text
            continue
        for i in sorted(own & by_word.keys(), key=lambda i: (-weights[i], i))[:RARE_WORDS]:
            for k in (k for u, k in postings[i] if u == t):
                for p in by_word[i]:
                    votes[t, p - k].add(k)
    best, found = 0.0, []
    for (t, start), hits in sorted(votes.items()):
        agree = set().union(*(votes.get((t, start + d), set()) for d in range(-SLACK, SLACK + 1)))
        if len(agree) < MIN_AGREEING:
            continue
        want = [number[w] for w in TEMPLATES[t].text.split()]
        right = sum(any(at.get(start + k + d) == w for d in range(-SLACK, SLACK + 1)) for k, w in enumerate(want))
        score = right / len(want)
        lo, hi = start - SLACK, start + len(want) + SLACK
        keys = all(any(all(at.get(p + j) == number[w] for j, w in enumerate(key.split())) for p in range(lo, hi)) for key in TEMPLATES[t].keys)
        if keys and score >= MIN_SCORE:
            found.append((max(0, start), TEMPLATES[t].label, score))
            labels.add(TEMPLATES[t].label)
            best = max(best, score)
    starts = [p for p, _ in base]
    if base:
        best = 1.0
    spots = ",".join(f"{label}:{p}" for p, label in sorted({(p, label) for p, label, _ in found}))
    return (n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), best, spots)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def scanned_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the code of every word in order, and where each text's begin."""
    return without_empty(*list_codes(pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")))


def word_weights(docs: DataFrame) -> list[float]:
    """IDF of each licence word over all documents: one bounded row per task, summed."""
    vocabulary, number, *_ = _index()

    def count(batches):
        df, n = np.zeros(len(vocabulary), dtype=np.int64), 0
        for b in slices(batches, 1, SLICE_DOCS, SLICE_BYTES):
            distinct, codes, starts = scanned_words(b.column(1))
            ids = np.array([number.get(w, -1) for w in distinct], dtype=np.int64)[codes] if distinct else codes.astype(np.int64)
            docs_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            keep = ids >= 0
            pairs = np.unique(docs_of[keep] * len(vocabulary) + ids[keep])
            df += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            n += len(starts) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), -1)), pa.array(np.append(df[df > 0], n))], ["word", "df"])

    found = dict(in_arrow(_texts(docs), count, "word long, df long").groupBy("word").agg(F.sum("df")).collect())
    n = found.get(-1, 0)
    return [math.log((n + 1) / (found.get(i, 0) + 1)) for i in range(len(vocabulary))]


def scan_licenses(docs: DataFrame) -> DataFrame:
    weights = word_weights(docs)
    index = _index()
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches):
        number = index[1]
        for b in slices(batches, 1, SLICE_DOCS, SLICE_BYTES):
            distinct, codes, starts = scanned_words(b.column(1))
            ids = np.array([number.get(w, -1) for w in distinct], dtype=np.int64)[codes] if distinct else codes.astype(np.int64)
            hits = np.flatnonzero(ids >= 0)
            cut = np.searchsorted(hits, starts)
            rows = []
            for i in range(len(starts) - 1):
                own = hits[cut[i] : cut[i + 1]]
                rows.append(scan_words((own - starts[i]).tolist(), ids[own].tolist(), int(starts[i + 1] - starts[i]), weights, index))
            cols = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return in_arrow(_texts(docs), run, OUT)
