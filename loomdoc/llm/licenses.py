"""Licence scans with a positional index of rare tokens.

Templates (licence notices) and base phrases are indexed by word and place. How rare
each licence word is in the corpus is counted first, over all documents; it gives the
words' IDF. In a file, the ANCHORS licence words with the highest IDF of each template are
looked up; each occurrence proposes "template t begins at word p", and the words'
postings are intersected by that start: AGREE of a template's anchors (all, where it has
fewer) must propose the same one. Then the words at their places must carry COVERAGE of
the template's IDF, and its mandatory key phrases must stand there.

Nulls: a null text is empty; a null doc_id is kept; repeated rows give a row each. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_rows

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed values. Notices: label, text, phrases that must stand within it. The texts are the licences' own public wording.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4",)),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "with or without modification")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("without restriction", "shall be included in all copies", "provided as is")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license version 2", "unless required by applicable law")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "appear in all copies")),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("must retain the above copyright notice", "must reproduce the above copyright notice")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "without specific prior written permission")),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2")),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("gnu lesser general public license",)),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("permission is granted to anyone", "alter it and redistribute it freely")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("released into the public domain",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)

#: Anchor words of a template, how many must agree on a start, and the share of its IDF that must be in place.
ANCHORS, AGREE, COVERAGE = 4, 2, 0.7

TOKENS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then words; on UTF-8 bytes, of which all above 7F are in words."""
    return TOKENS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else []


def split(text: str) -> tuple[bytes, ...]:
    return tuple(text.encode().split())


class Index:
    """Postings of rare words over templates, and the base phrases by their first word."""

    def __init__(self, idf: dict[bytes, float], templates: tuple = TEMPLATES, base: dict = BASE):
        self.templates = [(label, split(t), [split(k) for k in keys]) for label, t, keys in templates]
        self.idf = idf
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words, _) in enumerate(self.templates):
            for w in sorted(set(words), key=lambda w: (-idf[w], w))[:ANCHORS]:
                self.postings[w] += [(k, p) for p, x in enumerate(words) if x == w]
        self.agree = [min(AGREE, len(set(words))) for _, words, _ in self.templates]
        self.mass = [sum(idf[w] for w in words) for _, words, _ in self.templates]
        self.base = [(split(p), label) for p, label in base.items()]
        # the rarest word of a phrase finds it
        self.rare_base = [(p, label, max(range(len(p)), key=lambda i: idf[p[i]])) for p, label in self.base]
        self.wanted = set(self.postings) | {p[r] for p, _, r in self.rare_base}

    def scan(self, words: list[bytes]) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score."""
        if self.wanted.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.wanted:
                places[w].append(i)
        found = []
        for phrase, label, r in self.rare_base:
            found += [(i - r, label) for i in places.get(phrase[r], ()) if i >= r and tuple(words[i - r : i - r + len(phrase)]) == phrase]
        starts: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for w, at in places.items():
            for k, p in self.postings.get(w, ()):
                for i in at:
                    starts[k, i - p].add(w)
        labels, score = {label for _, label in found}, 1.0 if found else 0.0
        for (k, start), anchors in starts.items():
            if len(anchors) < self.agree[k]:
                continue
            label, template, keys = self.templates[k]
            there = words[max(start, 0) : start + len(template)]
            off = max(-start, 0)
            share = sum(self.idf[w] for w, x in zip(template[off:], there, strict=False) if w == x) / self.mass[k]
            if share >= COVERAGE and all(stands(key, there) for key in keys):
                labels.add(label)
                score = max(score, share)
        base_labels = sorted({label for _, label in found})
        at = [i for i, _ in found]
        return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(sorted(labels)), min(score, 1.0)


def stands(phrase: tuple, words: list) -> bool:
    n = len(phrase)
    return any(tuple(words[i : i + n]) == phrase for i in range(len(words) - n + 1))


def vocabulary(templates: tuple = TEMPLATES, base: dict = BASE) -> frozenset[bytes]:
    return frozenset(w for t in (*(t for _, t, _ in templates), *base) for w in split(t))


def licence_idf(docs: DataFrame, text: str, templates: tuple = TEMPLATES, base: dict = BASE) -> dict[bytes, float]:
    """IDF of every licence word over all documents: one row for each licence word reaches the driver."""
    licence_words = vocabulary(templates, base)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n.update(licence_words.intersection(words_of(t)))
                n[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(n.values(), pa.int64())], schema=schema)

    rows = docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word.encode(): r.n for r in rows}
    n = df.get(b"", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in licence_words}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, base: dict = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    index = docs.sparkSession.sparkContext.broadcast(Index(licence_idf(docs, text, templates, base), templates, base))  # as large as the templates
    names = (("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double"))
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in names])

    def make(ids: list, texts: list) -> Iterator[tuple]:
        scan_ = index.value.scan
        for i, t in zip(ids, texts, strict=True):
            yield (i, *scan_(words_of(t)))

    return map_rows(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), schema, ", ".join(f"{n} {k}" for n, k in names), make)
