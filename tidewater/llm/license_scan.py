"""License scans: the rare words of a template look up its places, where all its words must agree on the relative position; key phrases verify."""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import documents, rows_of, table

#: A phrase and its label.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Notices by label: template text, and the key phrases of which one must stand in a match.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["general public license version 2", "either version 2 of the license"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["general public license version 3", "either version 3 of the license"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4", "cc by 3"]),
    ("cc0", "licensed under cc0 1 0 universal public domain dedication", ["cc0 1"]),
    # bodies and longer notices, in the words of the licences
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
        ["permission is hereby granted free of charge"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright "
        "notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ["permission to use copy modify and or distribute this software"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone "
        "to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ["permission is granted to anyone to use this software for any purpose"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        ["free and unencumbered software"],
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2"],
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        ["mozilla public license"],
    ),
    ("all-rights-reserved", "all rights reserved no part may be reproduced without permission", ["all rights reserved"]),
]
#: Words by which two places may differ in relative position, share of a template's weight that makes a label.
DRIFT, MIN_SCORE = 2, 0.5

_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then runs of characters other than ASCII ones that are neither digit nor letter."""
    return text.translate(_TABLE).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase starts, in words joined and enclosed by single spaces; overlapping places all count."""
    found, at, mark = [], joined.find(b" " + phrase + b" "), b" " + phrase + b" "
    while at >= 0:
        found.append(joined.count(b" ", 0, at))
        at = joined.find(mark, at + 1)
    return found


@dataclass
class TemplateIndex:
    """Words of each template, the places of its rarest ones, and the words' weight, the inverse document frequency over the corpus."""

    texts: list[list[bytes]]
    rarest: list[list[tuple[bytes, int]]]
    idf: dict[bytes, float]
    weight: list[float]

    @classmethod
    def build(cls, idf: dict[bytes, float]) -> "TemplateIndex":
        texts = [t.encode().split() for _, t, _ in TEMPLATES]
        weight = [sum(idf.get(w, 0.0) for w in t) for t in texts]
        rarest = []
        for text, total in zip(texts, weight, strict=True):
            # words without these cannot weigh MIN_SCORE, so every label has one of them at its place
            chosen: set[bytes] = set()
            for w in sorted(set(text), key=lambda w: (-idf.get(w, 0.0), w)):
                if sum(idf.get(x, 0.0) for x in text if x in chosen) > (1 - MIN_SCORE) * total + 1e-9:
                    break
                chosen.add(w)
            rarest.append([(w, at) for at, w in enumerate(text) if w in chosen])
        return cls(texts, rarest, idf, weight)

    def labels(self, words: list[bytes], joined: bytes) -> dict[str, float]:
        """Labels with their score: the weight share of all template words found at one relative position, key phrase verified."""
        verified = [k for k, (_, _, phrases) in enumerate(TEMPLATES) if any(b" " + p.encode() + b" " in joined for p in phrases)]
        if not verified:
            return {}
        wanted, own = {w for k in verified for w, _ in self.rarest[k]}, {}
        for i, w in enumerate(words):
            if w in wanted:
                own.setdefault(w, []).append(i)
        best: dict[str, float] = {}
        for k in verified:
            text, lines = self.texts[k], {}

            def line(shift: int, text=text, lines=lines) -> set[int]:
                if shift not in lines:
                    lines[shift] = {at for at in range(max(0, -shift), min(len(text), len(words) - shift)) if words[shift + at] == text[at]}
                return lines[shift]

            near = {i - at + d for w, at in self.rarest[k] for i in own.get(w, ()) for d in range(-DRIFT, DRIFT + 1)}
            for shift in near:
                if not line(shift):
                    continue
                met = set().union(*(line(shift + d) for d in range(-DRIFT, DRIFT + 1)))
                label, share = TEMPLATES[k][0], sum(self.idf.get(text[at], 0.0) for at in sorted(met)) / max(self.weight[k], 1e-9)
                if share >= MIN_SCORE and len(met) >= 2:
                    best[label] = max(best.get(label, 0.0), min(1.0, share))
        return best


VOCABULARY = frozenset(w for _, t, _ in TEMPLATES for w in t.encode().split())


def licence_idf(docs: DataFrame) -> dict[bytes, float]:
    """Inverse document frequency, over all documents, of the words that templates use (a fixed, small set)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, dict.fromkeys(VOCABULARY, 0)
        for batch, texts in rows_of(batches):
            n += len(texts)
            for t in texts:
                for w in VOCABULARY.intersection(words_of(t)):
                    found[w] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array([b"", *found], pa.binary()), "n": pa.array([n, *found.values()], pa.int64())})

    counts = {bytes(r[0]): r[1] for r in documents(docs).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n")).collect()}
    total = counts.pop(b"", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 0.01 for w in VOCABULARY}


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of docs.

    Base labels come from phrases whose words stand consecutively. Further labels come from the
    positional index: the rarest words of each template, which weigh enough that no label can do without
    them, look up its places in a file; there all words of the template that agree on the relative position
    (within DRIFT words) count, and a label needs a share MIN_SCORE of its template's weight and one of its key phrases. score is the best share, 1 with a base
    label, 0 with no label. No labels give empty texts; null texts count as empty; null ids are carried; repeated
    rows repeat their result; an empty table gives an empty result.
    """
    index = TemplateIndex.build(licence_idf(docs))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    base = [(p.encode(), label) for p, label in BASE]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            rows = []
            for t in texts:
                words = words_of(t)
                joined = b" " + b" ".join(words) + b" "
                found = [(at, label) for p, label in base for at in places(joined, p)]
                own = sorted({label for _, label in found})
                more = index.labels(words, joined)
                starts = [at for at, _ in found]
                score = 1.0 if own else max(more.values(), default=0.0)
                rows.append((len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted({*own, *more})), score))
            cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, x) for c, x in zip(cols, types, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return documents(docs).mapInArrow(scan, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
