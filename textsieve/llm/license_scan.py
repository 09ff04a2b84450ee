"""License scan by template-markup matching.

A template is a license text or notice with regions marked as optional
(``<<beginOptional>> ... <<endOptional>>``, which may nest) or replaceable
(``<<var;N>>``: up to N words of any kind).  It is compiled into an automaton
over word hashes, and a text is accepted where the automaton runs from a start
word to its end, so that all mandatory wording stands there exactly.
Independently of the templates the places of the base phrases are counted.

All texts are cut into words at once with numpy; an automaton runs only around
the places of its template's anchor, three mandatory words in a row: from as
many words before as the template can have there, until no state is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import kernels as K
from textsieve.session import spread

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall <<var;20>> be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution"""
_BSD_TAIL = """this software is provided by <<var;20>> as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed"""
_GNU = """is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
foundation either version {v} of the license or at your option any later version"""

#: Attribution licenses and their names, and labels that name themselves in an identifier line.
_CC = (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"), ("by-nd", "attribution noderivatives"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"))
_SPDX = ("mit", "isc", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "epl-2.0", "zlib", "unlicense", "cc0-1.0", "bsl-1.0")

#: (label, template); wording of the public license texts, in lower case without punctuation.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software " + _WARRANTY),
    ("mit", "released under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-3-clause", _BSD_HEAD + " <<beginOptional>>3<<endOptional>> neither the name of <<var;20>> nor the names of <<var;10>> contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_TAIL),
    ("bsd-2-clause", _BSD_HEAD + " " + _BSD_TAIL),
    ("apache-2.0", "licensed under the apache license version 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>"),
    ("gpl-2.0", "<<var;12>> " + _GNU.format(v="2")),
    ("gpl-3.0", "<<var;12>> " + _GNU.format(v="3")),
    ("gpl-2.0", "licensed under the gnu general public license <<beginOptional>>gpl<<endOptional>> version 2"),
    ("gpl-3.0", "licensed under the gnu general public license <<beginOptional>>gpl<<endOptional>> version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> <<beginOptional>>www<<endOptional>> mozilla org mpl 2 0"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0-1.0", "to the extent possible under law <<var;20>> has waived all copyright and related or neighboring rights to <<var;30>>"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and <<beginOptional>>limitations under the license<<endOptional>>"),
    ("agpl-3.0", "<<var;12>> " + _GNU.replace("gnu general", "gnu affero general").format(v="3")),
    ("lgpl-2.1", "<<var;12>> " + _GNU.replace("gnu general", "gnu lesser general").format(v="2 1")),
    ("lgpl-3.0", "<<var;12>> " + _GNU.replace("gnu general", "gnu lesser general").format(v="3")),
    ("epl-2.0", "the accompanying materials are made available under the terms of the eclipse public license <<beginOptional>>v<<endOptional>> 2 0 which <<beginOptional>>is available at <<beginOptional>>https<<endOptional>> <<beginOptional>>http<<endOptional>> www eclipse org legal epl <<beginOptional>>v<<endOptional>> 2 0<<endOptional>> <<beginOptional>>accompanies this distribution<<endOptional>>"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the <<beginOptional>>authors<<endOptional>> <<beginOptional>>author<<endOptional>> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    *((f"cc-{name}-4.0", f"this work is licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons {words} 4 0 <<beginOptional>>international <<beginOptional>>license<<endOptional>><<endOptional>>") for name, words in _CC),
    *((label, f"spdx license identifier {label.replace('-', ' ').replace('.', ' ')} <<beginOptional>>only<<endOptional>> <<beginOptional>>or later<<endOptional>>") for label in _SPDX),
)
MARK = re.compile(r"<<(beginOptional|endOptional|var;\d+)>>")


@dataclass
class Automaton:
    """States 0 to end; a state reads one word, loops over any word, or is skipped."""

    label: str
    words: list[int] = field(default_factory=list)  #: word that leads from state i to i + 1; 0: any word
    skips: dict[int, list[int]] = field(default_factory=dict)  #: states reached without a word
    anchor: tuple[int, ...] = ()
    before: int = 0  #: most words from a match's start to the anchor

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        """An automaton of a template; marks that do not pair, or that are not known, are an error."""
        out, opened, run = cls(label), [], []
        for i, part in enumerate(MARK.split(template)):
            if i % 2 == 0:
                if "<<" in part or ">>" in part:
                    raise ValueError(f"template {label} has an unknown mark: {part}")
                for h in K.hash_words(part, K.ALNUM).tolist():
                    out.words.append(h)
                    run = [] if opened else [*run, h]
                    if len(run) >= 3 and not out.anchor:
                        out.anchor, out.before = tuple(run[-3:]), len(out.words) - 3
                continue
            run = []
            if part == "beginOptional":
                opened.append(len(out.words))
            elif part == "endOptional":
                if not opened:
                    raise ValueError(f"template {label} ends an optional region that has not begun")
                out.skips.setdefault(opened.pop(), []).append(len(out.words))
            else:
                start, n = len(out.words), int(part[4:])
                out.words += [0] * n
                for k in range(n):
                    out.skips.setdefault(start + k, []).append(start + n)
        if opened:
            raise ValueError(f"template {label} has an optional region without an end")
        if not out.anchor:
            raise ValueError(f"template {label} has no three mandatory words in a row")
        return out

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts(self, hashes: np.ndarray | list[int], anchors: np.ndarray | list[int] | None = None) -> bool:
        """Whether the template stands anywhere in a text; anchors: places of the anchor, if they are known."""
        hashes = np.asarray(hashes, dtype=np.uint64)
        if anchors is None:
            k = len(self.anchor)
            anchors = [i for i in range(len(hashes) - k + 1) if tuple(hashes[i : i + k].tolist()) == self.anchor]
        end, start = len(self.words), self._closed({0})
        for at in anchors:
            states: set[int] = set()
            for i in range(max(0, int(at) - self.before), len(hashes)):
                if i > at and not states:
                    break
                h = int(hashes[i])
                states = self._closed({s + 1 for s in (states | start if i <= at else states) if s < end and self.words[s] in (0, h)})
                if end in states:
                    return True
        return False


def _places(h: np.ndarray, words: K.Words, phrase: np.ndarray) -> np.ndarray:
    """Start words of a phrase, within documents."""
    k = len(phrase)
    n = max(len(h) - k + 1, 0)
    hit = np.ones(n, dtype=bool)
    for j in range(k):
        hit &= h[j : j + n] == phrase[j]
    at = np.flatnonzero(hit)
    return at[words.doc[at] == words.doc[at + k - 1]]


def scan_licenses(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per row.

    n_base counts every place of a base phrase, overlapping ones included;
    first_word and last_word are the least and largest start, from 0, null
    without one.  Labels are distinct, sorted and comma-joined, an empty string
    without any.  score: 1.0 if a template's mandatory wording stands exactly,
    else 0.5 with a base phrase, else 0.0.  A null or empty text has no words.
    Repeated rows give repeated results; only doc_id and text are read.
    """
    K.tune(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(K.hash_words(p, K.ALNUM), label) for p, label in BASE_PHRASES]
        automata = [Automaton.compile(label, t) for label, t in templates]
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(1))
            for lo, hi in K.slices(offsets):
                at = offsets[lo : hi + 1]
                words = K.words_of(data[at[0] : at[-1]], at - at[0], K.ALNUM)
                h, docs = words.hashes(), hi - lo
                counts = np.zeros(docs, dtype=np.int64)
                first, last = np.full(docs, 2**62, dtype=np.int64), np.full(docs, -1, dtype=np.int64)
                base_labels: dict[int, set[str]] = {}
                for phrase, label in base:
                    found = _places(h, words, phrase)
                    d = words.doc[found]
                    place = found - words.first[d]
                    np.add.at(counts, d, 1)
                    np.minimum.at(first, d, place)
                    np.maximum.at(last, d, place)
                    for i in np.unique(d).tolist():
                        base_labels.setdefault(i, set()).add(label)
                labels = {i: set(x) for i, x in base_labels.items()}
                exact: set[int] = set()
                anchored: dict[tuple[int, ...], list[tuple[int, np.ndarray]]] = {}
                for a in automata:
                    if a.anchor not in anchored:
                        found = _places(h, words, np.array(a.anchor, dtype=np.uint64))
                        own, cut = np.unique(words.doc[found], return_index=True)
                        anchored[a.anchor] = list(zip(own.tolist(), np.split(found, cut[1:]), strict=True)) if len(own) else []
                    for i, places in anchored[a.anchor]:
                        if a.accepts(h[words.first[i] : words.first[i + 1]], places - words.first[i]):
                            labels.setdefault(i, set()).add(a.label)
                            exact.add(i)
                none = counts == 0
                join = lambda x: [",".join(sorted(x[i])) if i in x else "" for i in range(docs)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, docs),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(counts),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array(join(base_labels), pa.string()),
                        pa.array(join(labels), pa.string()),
                        pa.array([1.0 if i in exact else 0.5 if i in labels else 0.0 for i in range(docs)], pa.float64()),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return spread(documents.select("doc_id", F.col("text").cast("string"))).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole table ``documents``."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
