"""Licence detection by a positional index of rare template words.

Templates are licence notices with mandatory key phrases. Their words get inverse document frequencies over the whole corpus, and
the index holds for every word of a key phrase where it stands in the phrase. A file's licence words are looked up rarest first: the
first one that a phrase shares with the file proposes the phrase's places there, which are compared word by word; a phrase that
lacks a word is out at once. A notice is found where all its key phrases follow one another in order, each at most WINDOW words nearer
or farther than in the template, so added, dropped or reworded words between them do no harm. Its share is that of the notice's
words which stand there in order, its version the number that stands behind its last key phrase. The base phrases are templates that
consist of their key phrase, so that their places come out of the same index.

Defined results. Null and empty texts have no words and no findings: empty label strings, score 0, null places. Rows with
null identifier are scanned like others, an identifier that is no number becomes null; repeated rows give equal rows. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words by which the distance of two key phrases may differ from the template's, and words behind a notice in which its version stands.
WINDOW, VERSION_WORDS = 8, 6

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label, notice and mandatory key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction", ("permission is hereby granted", "software without restriction")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
     " the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
     " granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
     " this software without specific prior written permission", ("neither the name of", "endorse or promote products derived from this software")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"
     " arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial"
     " applications and to alter it and redistribute it freely", ("held liable for any damages", "permission is granted to anyone to use this software", "redistribute it freely")),
    ("bsl", "boost software license version 1 0", ("boost software license",)),
    ("wtfpl", "do what the fuck you want to public license version 2", ("do what the fuck you want to",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("eupl", "licensed under the european union public licence version 1 2", ("european union public licence",)),
    ("artistic", "you may copy distribute and modify under the terms of the artistic license 2 0", ("artistic license",)),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in"
     " writing software distributed under the license is distributed on an as is basis", ("www apache org licenses", "distributed on an as is basis")),
)

#: Bytes that stand between words become spaces; A-Z become lower case.
_TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Template:
    def __init__(self, label: str, notice: str, phrases: tuple[str, ...], base: bool):
        self.label, self.base = label, base
        self.words = notice.encode().split()
        self.phrases = []
        for phrase in phrases:
            own = phrase.encode().split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(own)] == own)
            self.phrases.append((at, own))
        self.phrases.sort()


def default_templates() -> list[Template]:
    base = [Template(label, phrase, (phrase,), True) for phrase, label in BASE]
    return base + [Template(label, notice, phrases, False) for label, notice, phrases in TEMPLATES]


def _in_order(notice: list[bytes], words: list[bytes]) -> int:
    """The length of the longest sequence of words that stands in both in order."""
    best = [0] * (len(words) + 1)
    for word in notice:
        before = 0
        for i, other in enumerate(words, 1):
            here = best[i]
            best[i] = before + 1 if word == other else max(here, best[i - 1])
            before = here
    return best[-1]


def version_behind(words: list[bytes], at: int) -> str | None:
    """The first number of up to two digits in the words from `at` on, with the digit behind it if there is one."""
    for i in range(at, min(at + VERSION_WORDS, len(words))):
        number = words[i][1:] if words[i][:1] == b"v" else words[i]
        if number.isdigit() and len(number) <= 2:
            minor = words[i + 1] if i + 1 < len(words) else b""
            return (number + (b"." + minor if minor.isdigit() and len(minor) == 1 else b"")).decode()
    return None


class RareIndex:
    """Postings (template, phrase, place in it) of the words of key phrases."""

    def __init__(self, templates: list[Template], idf: dict[bytes, float], window: int = WINDOW):
        self.templates, self.window = templates, window
        postings: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        self.wanted: dict[tuple[int, int], frozenset[bytes]] = {}
        for t, template in enumerate(templates):
            for k, (_, own) in enumerate(template.phrases):
                self.wanted[t, k] = frozenset(own)
                for place, word in enumerate(own):
                    postings[word].append((t, k, place))
        self.postings = dict(postings)
        self.order = {w: i for i, w in enumerate(sorted(postings, key=lambda w: (-idf[w], w)))}

    def _share(self, template: Template, words: list[bytes], start: int, last: int) -> float:
        n = len(template.words)
        if start >= 0 and words[start : start + n] == template.words:
            return 1.0
        end = last + n - template.phrases[-1][0] + self.window
        return _in_order(template.words, words[max(start - self.window, 0) : end]) / n

    def _phrases(self, words: list[bytes]) -> dict[tuple[int, int], list[int]]:
        """Places of the key phrases, by the file's licence words, rarest first."""
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            if word in self.order:
                at[word].append(i)
        found: dict[tuple[int, int], list[int]] = {}
        settled: set[tuple[int, int]] = set()
        for word in sorted(at, key=self.order.__getitem__):
            for t, k, place in self.postings[word]:
                if (t, k) in settled and found.get((t, k), [None])[0] != word:
                    continue
                if (t, k) not in settled:
                    settled.add((t, k))
                    if not self.wanted[t, k] <= at.keys():
                        continue
                    found[t, k] = [word]
                own = self.templates[t].phrases[k][1]
                found[t, k] += [i - place for i in at[word] if i >= place and words[i - place : i - place + len(own)] == own]
        return {key: sorted(set(places[1:])) for key, places in found.items() if len(places) > 1}

    def findings(self, words: list[bytes]) -> list[tuple[int, int, float, str | None]]:
        """(template, start, share of the notice's words that stand there in order, version) of every place with all key phrases."""
        found, out = self._phrases(words), []
        for t in sorted(t for t, k in found if k == 0):
            template = self.templates[t]
            for first in found[t, 0]:
                reached = [first]
                for k, (at, _) in enumerate(template.phrases[1:], 1):
                    before, own = template.phrases[k - 1]
                    places, after = found.get((t, k), []), set()
                    for place in reached:
                        low = max(place + min(len(own), at - before), place + at - before - self.window)
                        high = place + at - before + self.window
                        after.update(places[bisect_left(places, low) : bisect_right(places, high)])
                    reached = sorted(after)
                if reached:
                    start = first - template.phrases[0][0]
                    version = None if template.base else version_behind(words, reached[-1] + len(template.phrases[-1][1]))
                    out.append((t, max(start, 0), self._share(template, words, start, reached[-1]), version))
        return out


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                rows += 1
                found.update(vocabulary.intersection(words_of(text.as_py())))
        found[b""] = rows
        columns = [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    return run


def corpus_idf(docs: DataFrame, templates: list[Template]) -> dict[bytes, float]:
    """Inverse document frequencies of the templates' words over all texts; one row per word and task is shuffled."""
    vocabulary = frozenset(w for t in templates for w in t.words)
    counted = docs.select("text").mapInArrow(_frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {bytes(word): n for word, n in counted.collect()}  # as many rows as the templates have words
    rows = seen.get(b"", 0)
    return {w: math.log((rows + 1) / (seen.get(w, 0) + 1)) for w in vocabulary}


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, places array<struct<label:string,start:long,words:int,share:double,version:string>>"
)
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("share", pa.float64()), ("version", pa.string())]))


def _scan(index: RareIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = index.findings(words)
                base = sorted(start for t, start, *_ in found if index.templates[t].base)
                labels = {index.templates[t].label for t, *_ in found}
                base_labels = {index.templates[t].label for t, *_ in found if index.templates[t].base}
                places = [(index.templates[t].label, start, len(index.templates[t].words), share, version) for t, start, share, version in sorted(found, key=lambda x: (x[1], x[0]))]
                row = (
                    len(words), len(base), base[0] if base else None, base[-1] if base else None, ",".join(sorted(base_labels)),
                    ",".join(sorted(labels)), max((share for _, _, share, _ in found), default=0.0),
                    [dict(zip(("label", "start", "words", "share", "version"), p, strict=True)) for p in places],
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _PLACES)
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """Licence findings of every text, with the places of all of them."""
    templates = templates or default_templates()
    index = RareIndex(templates, corpus_idf(docs, templates))
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(_scan(index), SCHEMA)
