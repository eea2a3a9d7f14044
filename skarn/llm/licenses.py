"""12. License scans by a positional index of rare words.

A template is a short passage of a license: its label, its words, and key phrases that must stand in it. Words of templates are weighed by how few of all documents
hold them: round(1000 (1 + ln((N + 1) / (df + 1)))), whole numbers, counted over the whole table. A template stands at a place of a file if the words that agree there, each in its relative position,
hold at least SHARE of the template's weight, and every word of the key phrases is among them.

Each template is indexed by its rarest words, those of highest weight that make up at least PROBED of its weight, with their positions. A file's words are looked up in that index, and postings are
intersected by relative position (place in the file less position in the template): as a template that stands there lacks at most 1 - SHARE of its weight, its indexed words lack no more, so
places with less than that guaranteed weight go, and the others are verified by all words and the key phrases. Nothing that stands is lost, however often words repeat; a word of a file
costs no more than its postings.

Base templates are phrases that must stand whole. Words are runs of letters, digits and signs beyond ASCII, A-Z lower-cased.

Defined results: a null, empty or wordless text has no words and no places, score 0; a very long text is scanned whole; repeated rows and null ids get a row each; an empty table gives no rows (and
weights as if no word were anywhere); other columns are not read. Equal weights (ties) index the earlier word; a file may hold many templates, and one many times: all places are kept.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_memory

SHARE, PROBED = 0.8, 0.5
#: (label, base, words, key phrases). Phrases of public licenses and their usual notices.
TEMPLATES = (
    ("mit", True, "under the mit license", ("under the mit license",)),
    ("apache-2", True, "apache license version 2", ("apache license version 2",)),
    ("cc-by-nc", True, "cc by nc", ("cc by nc",)),
    ("agpl-3", False, "under the terms of the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("apache-2", False, "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses")),
    ("artistic-2", False, "the artistic license 2 0", ("artistic license 2",)),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("bsl-1", False, "boost software license version 1 0", ("boost software license",)),
    ("cc-by", False, "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by", False, "creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by-nc", False, "creative commons attribution noncommercial 4 0 international license", ("commons attribution noncommercial",)),
    ("cc-by-nd", False, "cc by nd", ("cc by nd",)),
    ("cc-by-sa", False, "cc by sa", ("cc by sa",)),
    ("cc-by-sa", False, "creative commons attribution sharealike 4 0 international license", ("commons attribution sharealike",)),
    ("cc0", False, "cc0 1 0 universal", ("cc0 1 0",)),
    ("epl-2", False, "eclipse public license version 2 0", ("eclipse public license",)),
    ("gpl-2", False, "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2", False, "either version 2 of the license or at your option any later version", ("either version 2 of the license",)),
    ("gpl-3", False, "gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", False, "either version 3 of the license or at your option any later version", ("either version 3 of the license",)),
    ("isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("lgpl", False, "gnu lesser general public license", ("gnu lesser general public license",)),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mpl-2", False, "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", False, "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", False, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("must be plainly marked as such",)),
)
#: Bytes of words; all others part them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def mandatory(words: list[str], phrases) -> list[int]:
    """Positions of the key phrases' words in a template."""
    out: set[int] = set()
    for phrase in phrases:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        if not at:
            raise ValueError(f"the template has no such phrase: {phrase}")
        out.update(range(at[0], at[0] + len(p)))
    return sorted(out)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, _, words, _ in templates for w in words.split()})


def _as_bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def word_weights(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Weight of each word of the templates, from all documents. A row for each such word comes to the driver, however many documents there are."""
    known = {w.encode(): i for i, w in enumerate(vocabulary(templates))}

    def count(batches):
        worker_memory("licenses", dict)  # nothing is remembered; what other operators left goes
        n, df = 0, np.zeros(len(known), "i8")
        for b in batches:
            for text in b.column(1):
                n += 1
                df[[known[w] for w in known.keys() & set(words_of(text.as_py()))]] += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *np.flatnonzero(df).tolist()], "int32"), pa.array([n, *df[df > 0].tolist()], "int64")], names=["word", "n"])

    found = dict(map(tuple, _as_bytes(docs).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n")).collect()))
    n = found.get(-1, 0)
    return {w: math.floor(1000 * (1 + math.log((n + 1) / (found.get(i, 0) + 1))) + 0.5) for i, w in enumerate(vocabulary(templates))}


def probes(words: list[str], weights: dict[str, int]) -> list[int]:
    """Positions of the rarest words that make up PROBED of a template's weight."""
    total, own, out = sum(weights[w] for w in words), 0, []
    for i in sorted(range(len(words)), key=lambda i: (-weights[words[i]], i)):
        out.append(i)
        own += weights[words[i]]
        if own >= PROBED * total:
            break
    return out


class Index:
    """Postings of templates by rare words, and what verifies them."""

    def __init__(self, templates, weights: dict[str, int]):
        self.numbers = {w.encode(): i for i, w in enumerate(sorted(weights))}
        split = [words.split() for _, _, words, _ in templates]
        self.words = [np.asarray([self.numbers[w.encode()] for w in ws]) for ws in split]
        self.weights = [np.asarray([weights[w] for w in ws]) for ws in split]
        self.needed = [np.asarray(mandatory(ws, t[3])) for ws, t in zip(split, templates, strict=True)]
        self.totals = [int(w.sum()) for w in self.weights]
        postings: list[list] = [[] for _ in self.numbers]  # by word: (template, position)
        self.sure = np.zeros(len(templates))
        for t, ws in enumerate(split):
            for i in probes(ws, weights):
                postings[self.words[t][i]].append((t, i))
                self.sure[t] += self.weights[t][i]
            self.sure[t] -= (1 - SHARE) * self.totals[t]
        self.count = np.asarray([len(p) for p in postings])
        self.first = np.cumsum(self.count) - self.count
        self.template, self.position = np.asarray([x for p in postings for x in p]).reshape(-1, 2).T
        self.weight = np.asarray([self.weights[t][i] for p in postings for t, i in p])
        self.width = max(map(len, self.words))

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, place of its first word, weight that agrees) of all that stands in a file, by template and place."""
        number = np.fromiter(map(self.numbers.get, words, [-1] * len(words)), "i4", len(words))
        at = np.flatnonzero(number >= 0)
        n = self.count[number[at]]
        at, n = at[n > 0], n[n > 0]
        if not len(at):
            return []
        post = np.repeat(self.first[number[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        t, place = self.template[post], np.repeat(at, n) - self.position[post]
        key = t * (len(number) + self.width) + place + self.width  # template and relative position
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        t, place, got = t[order][new], place[order][new], np.add.reduceat(self.weight[post][order], new)
        sure = got >= self.sure[t] - 1e-6
        return [(a, p, w) for a, p in zip(t[sure].tolist(), place[sure].tolist(), strict=True) if (w := self._stands(number, a, p))]

    def _stands(self, number: np.ndarray, t: int, place: int) -> int:
        """The weight that agrees, 0 if too little or a key phrase is missing."""
        at = np.arange(place, place + len(self.words[t]))
        agree = (at >= 0) & (at < len(number))
        agree[agree] = number[at[agree]] == self.words[t][agree]
        weight = int(self.weights[t][agree].sum())
        return weight if agree[self.needed[t]].all() and weight >= SHARE * self.totals[t] else 0


def scan(docs: DataFrame, weights: dict[str, int] | None = None, templates=TEMPLATES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, places (array of label, base, start, n_words, share of the template's weight), by template and start."""
    weights = weights or word_weights(docs, templates)

    def run(batches):
        index = worker_memory(("licenses", tuple(weights.items()), templates), lambda: Index(templates, weights))
        for b in batches:
            n, rows = [], []
            for text in b.column(1):
                words = words_of(text.as_py())
                n.append(len(words))
                rows.append([{"label": templates[t][0], "base": templates[t][1], "start": p, "n_words": len(index.words[t]), "share": w / index.totals[t]} for t, p, w in index.places(words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, "int64"), pa.array(rows, _PLACES)], names=["doc_id", "n_words", "places"])

    return _as_bytes(docs).mapInArrow(run, "doc_id long, n_words long, places array<struct<label: string, base: boolean, start: long, n_words: int, share: double>>")


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("n_words", pa.int32()), ("share", pa.float64())]))


def digests(found: DataFrame) -> DataFrame:
    """found(doc_id, n_words, places) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share, 0 without any)."""
    base = F.filter("places", lambda p: p["base"])
    starts, named = F.transform(base, lambda p: p["start"]), lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named(base).alias("base_labels"),
                        named(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
