"""Licence scan by a positional index of rare licence words.

Every template is a licence text, or the words by which one is named or granted, with mandatory key
phrases. The index maps a word to its postings (template, position). Of a file the licence words of
highest inverse document frequency are looked up, as many as it takes: down to the rarest word of
every key phrase whose words the file has, if it has those of all of the template's key phrases.
Postings are intersected by relative position: a place at which a template may begin is one for which
the rarest words of all its key phrases vote. There the phrases are verified word by word. A template
is thus found wherever all its key phrases stand at their places, and nowhere else. All files of a
batch are worked on at once; document frequencies come from the whole corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices
from .words import byte_table, word_hash, word_hashes, word_spans

SEPARATORS = byte_table(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)))
class Template(NamedTuple):
    label: str
    words: str
    keys: tuple[str, ...]


# The base phrases and their labels.
BASE = [
    Template("cc-by", "cc by", ("cc by",)),
    Template("gpl", "general public license", ("general public license",)),
    Template("reserved", "all rights reserved", ("all rights reserved",)),
]
# Public licence texts and notices, and phrases by which licences are named or granted.
MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software"""
APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""
GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""
MPL = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"""
UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""
TEMPLATES = [
    Template("mit", MIT, ("permission is hereby granted free of charge to any person obtaining a copy",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("isc", ISC, ("for any purpose with or without fee is hereby granted",)),
    Template("isc", "released under the isc license", ("isc license",)),
    Template("bsd", BSD, ("redistribution and use in source and binary forms", "modification are permitted")),
    Template("zlib", ZLIB, ("permission is granted to anyone to use this software for any purpose",)),
    Template("apache-2.0", APACHE, ("apache license version 2 0", "use this file except in compliance with the license")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2", GPL.format(2), ("gnu general public license", "either version 2")),
    Template("gpl-3", GPL.format(3), ("gnu general public license", "either version 3")),
    Template("gpl-2", "gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3", "gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", MPL, ("subject to the terms of the mozilla public license", "2 0")),
    Template("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license", "2 0")),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("unlicense", UNLICENSE, ("free and unencumbered software released into the public domain",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-4.0", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "creative commons zero cc0 1 0 universal", ("cc0 1 0",)),
]


class Index:
    """Postings of all words of all templates as arrays, sorted by word; idf is by word hash."""

    def __init__(self, templates: list[Template], idf: dict[int, float] | None = None):
        self.templates = templates
        self.words = [np.array([word_hash(w.encode()) for w in t.words.split()], np.uint64) for t in templates]
        self.vocabulary = np.unique(np.concatenate(self.words)) if templates else np.zeros(0, np.uint64)
        self.idf = np.array([(idf or {}).get(int(h), 0.0) for h in self.vocabulary])
        number = [np.searchsorted(self.vocabulary, w) for w in self.words]
        word = np.concatenate([*number, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        self.template = np.repeat(np.arange(len(templates)), [len(w) for w in self.words])[order]
        self.position = np.concatenate([*(np.arange(len(w)) for w in self.words), np.zeros(0, np.int64)])[order]
        self.first = np.searchsorted(word[order], np.arange(len(self.vocabulary)))
        self.count = np.bincount(word, minlength=len(self.vocabulary))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        # Key phrases: their words, their rarest word, and whether a posting is that word's.
        self.keys: list[list[tuple[int, np.ndarray]]] = []
        must, phrases, self.key_template, rarest = set(), [], [], []
        for t, template in enumerate(templates):
            words, own = template.words.split(), []
            for key in template.keys:
                k = key.split()
                at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
                own.append((at, self.words[t][at : at + len(k)]))
                rare = max(range(at, at + len(k)), key=lambda i: (self.idf[number[t][i]], -i))  # noqa: B023
                must.add((t, rare))
                rarest.append(self.idf[number[t][rare]])
                phrases.append(number[t][at : at + len(k)])
                self.key_template.append(t)
            self.keys.append(own)
        self.must = np.array([(t, q) in must for t, q in zip(self.template.tolist(), self.position.tolist(), strict=True)], bool)
        self.musts = np.bincount([t for t, _ in must], minlength=len(templates))
        self.rarest, self.key_template = np.array(rarest), np.array(self.key_template, np.int64)
        self.phrase = np.zeros((len(phrases), len(self.vocabulary)), np.float32)
        for i, k in enumerate(phrases):
            self.phrase[i, k] = 1
        self.of = np.zeros((len(phrases), len(templates)), np.float32)
        self.of[np.arange(len(phrases)), self.key_template] = 1

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, vocabulary numbers) of the licence words among word hashes."""
        at = np.flatnonzero(self.maybe.take((words & np.uint64(0xFFFF)).astype(np.intp)))
        if not len(at):
            return at, at
        i = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        good = self.vocabulary[i] == words[at]
        return at[good], i[good]

    def match(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Verified (text, template, first word, share of the template's words in place).

        A template may begin before its text or end after it; its key phrases may not.
        """
        at, vocab = self.lookup(words)
        if not len(at):
            return []
        docs, row = np.unique(np.searchsorted(first, at, side="right") - 1, return_inverse=True)
        has = np.zeros((len(docs), len(self.vocabulary)), np.float32)
        has[row, vocab] = 1
        whole = has @ self.phrase.T == self.phrase.sum(axis=1)  # (text, phrase): all of its words are there
        able = whole @ self.of == self.of.sum(axis=0)  # (text, template): those of all its phrases
        wanted = np.where(whole & able[:, self.key_template], self.rarest[None, :], np.inf).min(axis=1, initial=np.inf)
        high = self.idf[vocab] >= wanted[row]  # the file's words of highest IDF, as many as it takes
        at, vocab, row = at[high], vocab[high], row[high]
        n = self.count[vocab]
        which = np.repeat(self.first[vocab], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin, row, template = np.repeat(at, n) - self.position[which], np.repeat(row, n), self.template[which]
        good = able[row, template]
        which, begin, row, template = which[good], begin[good], row[good], template[good]
        least = int(begin.min(initial=0))
        span = int(begin.max(initial=0)) - least + 1
        place, of = np.unique((row * len(self.templates) + template) * span + begin - least, return_inverse=True)
        voted = np.bincount(of, self.must[which], len(place))
        out = []
        for p, v in zip(place.tolist(), voted.tolist(), strict=True):
            rt, b = divmod(p, span)
            r, t = divmod(rt, len(self.templates))
            if v < self.musts[t]:
                continue
            i, b = int(docs[r]), b + least
            lo, hi = int(first[i]), int(first[i + 1])
            if all(lo <= b + q and b + q + len(k) <= hi and np.array_equal(words[b + q : b + q + len(k)], k) for q, k in self.keys[t]):
                own = self.words[t]
                a, z = max(b, lo), min(b + len(own), hi)
                out.append((i, t, b, float((words[a:z] == own[a - b : z - b]).sum() / len(own))))
        return out


def document_frequencies(docs: DataFrame, templates: list[Template]) -> dict[int, int]:
    """Texts that hold each licence word, over all documents; key -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, n = Index(templates), np.zeros(0, np.int64), 0
        total = np.zeros(len(index.vocabulary), np.int64)
        for rows, data, offs in slices(batches, "text"):
            starts, ends, first = word_spans(data, offs, SEPARATORS)
            at, vocab = index.lookup(word_hashes(data, starts, ends))
            doc = np.searchsorted(first, at, side="right") - 1
            total += np.bincount(np.unique(doc * len(total) + vocab) % len(total), minlength=len(total)) if len(at) else 0
            n += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.concatenate([[n], total]))], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}  # one row per licence word


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """Licences of every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. score is the
    share of the best verified template's words that stand in place, 0 without one. A null or empty
    text has no words, null places and empty labels; repeated rows repeat; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rest = TEMPLATES if templates is None else templates
    every = BASE + rest
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df = document_frequencies(docs, every)
    texts = df.get(-1, 0)
    known = {int(h): math.log((texts + 1) / (df.get(i, 0) + 1)) for i, h in enumerate(Index(every).vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(every, known)
        for rows, data, offs in slices(batches, "text"):
            starts, ends, first = word_spans(data, offs, SEPARATORS)
            words = word_hashes(data, starts, ends)
            n = rows.num_rows
            places: list[list[int]] = [[] for _ in range(n)]
            base: list[set[str]] = [set() for _ in range(n)]
            labels: list[set[str]] = [set() for _ in range(n)]
            score = np.zeros(n)
            for i, t, b, share in index.match(words, first):
                labels[i].add(every[t].label)
                score[i] = max(score[i], share)
                if t < len(BASE):
                    places[i].append(b - int(first[i]))
                    base[i].add(every[t].label)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(first)), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()), pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
