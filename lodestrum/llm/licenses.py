"""Find licence texts by a positional index of rare words.

Each template is a sequence of words. The index holds, for the rarer half of each
template's words (by inverse document frequency over the whole table), the
places where they stand. Of every stretch of a file its licence words of highest
inverse document frequency are looked up; every posting (template, place) puts
the template at an offset in the file, and postings are intersected by relative
position: offsets that agree but for a few words added or left out are a
candidate. It is accepted if enough of the template's words stand there in order
and the template's mandatory key phrases are there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Label, template text, mandatory key phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "deal in the software"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ["dedicated the work to the public domain"]),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["person or organization obtaining a copy"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ["permission is hereby granted free of charge", "deal in the software"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ["with or without fee is hereby granted"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["alter it and redistribute it freely"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["apache license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["gnu general public license"]),
]
#: Phrase and label of the base rule.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: A template's words that must stand there in order.
LEAST_MATCH = 0.75
#: Words of a stretch, and how many of its indexed words, the rarest, are looked up.
STRETCH, RARE = 32, 8
#: Different words that must agree on an offset, to within this share of the template's length (2 words at least).
LEAST_VOTES, SLACK = 2, 0.1
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER)) if text else []


def document_frequency(docs: DataFrame, vocabulary: frozenset[str]) -> tuple[int, dict[str, int]]:
    """Number of rows, and of those that hold each word of the templates' vocabulary: a bounded table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, int] = {}
        for b in batches:
            n[""] = n.get("", 0) + len(b)
            for t in b["text"]:
                for w in vocabulary.intersection(words(t)):
                    n[w] = n.get(w, 0) + 1
        if n:
            yield pd.DataFrame({"word": list(n), "n": list(n.values())})

    rows = docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found.pop("", 0), found


def in_order(masks: dict[str, int], m: int, words_: list[str]) -> int:
    """Length of the longest common subsequence, in one bit-parallel pass over words_."""
    full = v = (1 << m) - 1
    for x in words_:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


class Index:
    """Postings of the rarer half of each template's words."""

    def __init__(self, n_docs: int, df: dict[str, int], templates=TEMPLATES):
        self.templates = []
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) for _, t, _ in templates for w in t.split()}
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for n, (label, text, keys) in enumerate(templates):
            t = text.split()
            masks: dict[str, int] = {}
            for i, x in enumerate(t):
                masks[x] = masks.get(x, 0) | 1 << i
            self.templates.append((label, t, masks, [k.split() for k in keys], max(2, int(SLACK * len(t)))))
            by_rarity = sorted(masks, key=lambda w: (-self.idf[w], w))
            for w in by_rarity[: max(LEAST_VOTES, len(by_rarity) // 2)]:
                self.postings.setdefault(w, []).extend((n, i) for i, x in enumerate(t) if x == w)
        self.rare = frozenset(self.postings)

    def lookups(self, w: list[str]) -> list[tuple[int, str]]:
        """(place, word) of the rarest indexed words of each stretch."""
        out = []
        for at in range(0, len(w), STRETCH):
            part = w[at : at + STRETCH]
            held = self.rare.intersection(part)
            if len(held) > RARE:
                held = set(sorted(held, key=lambda x: (-self.idf[x], x))[:RARE])
            if held:
                out += [(at + i, x) for i, x in enumerate(part) if x in held]
        return out

    def find(self, w: list[str]) -> list[tuple[str, int, float]]:
        """(label, offset in words, share of the template matched) of every accepted candidate."""
        if len(self.rare.intersection(w)) < LEAST_VOTES:
            return []
        votes: dict[int, list[tuple[int, int, str]]] = {}
        for i, x in self.lookups(w):
            for n, at in self.postings[x]:
                votes.setdefault(n, []).append((i - at, at, x))
        out = []
        for n, found in votes.items():
            label, t, masks, keys, slack = self.templates[n]
            found.sort()
            # Different words within slack of each offset, in one pass with two ends.
            near: dict[str, int] = {}
            lo = hi = 0
            places = []
            for k, (offset, _, _) in enumerate(found):
                while hi < len(found) and found[hi][0] <= offset + slack:
                    near[found[hi][2]] = near.get(found[hi][2], 0) + 1
                    hi += 1
                while found[lo][0] < offset - slack:
                    x = found[lo][2]
                    near[x] -= 1
                    if not near[x]:
                        del near[x]
                    lo += 1
                if len(near) >= LEAST_VOTES and (not k or found[k - 1][0] != offset):
                    # Where the earliest of them puts the template is its start.
                    start = min((at, o) for o, at, _ in found[lo:hi])[1]
                    places.append((-len(near), offset, start))
            taken: list[int] = []
            for _, offset, start in sorted(places):
                if any(abs(offset - x) <= len(t) // 2 for x in taken):
                    continue
                part = w[max(0, offset - slack) : max(0, offset + len(t) + slack)]
                got = in_order(masks, len(t), part) / len(t)
                if got >= LEAST_MATCH and all(_has(part, k) for k in keys):
                    taken.append(offset)
                    out.append((label, max(0, start), got))
        return sorted(out, key=lambda x: (x[1], x[0]))


def _has(w: list[str], phrase: list[str]) -> bool:
    return any(w[i : i + len(phrase)] == phrase for i in range(len(w) - len(phrase) + 1))


def phrases(w: list[str]) -> list[tuple[int, str]]:
    """(place, label) of every place where a base phrase's words stand."""
    out = []
    held = set(w)
    for p, label in PHRASES:
        p = p.split()
        if held.issuperset(p):
            out += [(i, label) for i, x in enumerate(w[: len(w) - len(p) + 1]) if x == p[0] and w[i : i + len(p)] == p]
    return out


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    matches lists (label, first word, share) of the templates found, share being that of
    the template's words found in order; labels joins theirs
    to the base ones. score is the largest share matched, 0.5 for a base phrase alone and
    0 without either. A null or empty text has no words, labels "" and score 0.
    Repeated rows each get a row; other columns are not looked at. The index is
    as large as the list of templates.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = frozenset(w for _, t, _ in templates for w in t.split())
    n, df = document_frequency(docs, vocabulary)
    out = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:int,share:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(n, df, templates)
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                w = words(t)
                base, found = phrases(w), index.find(w)
                at = [x for x, _ in base]
                own = {x for _, x in base}
                share = max([s for _, _, s in found], default=0.5 if base else 0.0)
                rows.append((i, len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x for x, _, _ in found})), share, [{"label": x, "first": a, "share": s} for x, a, s in found]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]).astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return docs.mapInPandas(run, out)
