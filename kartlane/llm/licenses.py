"""Operator 11, licence scans with a positional index of rare tokens.

1. The words of all templates are the licence words. One pass over the corpus
   counts in how many documents each occurs; that gives their IDF.
2. Only the ``rare`` words of highest IDF of each template (for a phrase: of all
   its words) have postings ``(template, position)``. Each file's licence words are looked
   up there.
3. Postings of one template are intersected by relative position: for a phrase
   the places of its rarest word that the file has, narrowed word by word, so
   that every place of the whole phrase is found; for a passage all hits whose
   file position less template position differ by at most ``drift`` from the next.
4. A passage counts if ``share`` of its words lie in that alignment and each of
   its mandatory key phrases stands in the same stretch of the file.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Defined
results: a null or empty text has no words and no labels; repeated rows, null
ids and ties are rows like any other; a very long text is searched as a whole;
only ``doc_id`` and ``text`` are read, whatever other columns there are; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .words import bytes_in, split

GAP = bytes_in((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SCHEMA = "doc_id bigint, n_words bigint, matches array<struct<label:string,base:boolean,first:bigint,length:bigint,share:double>>"


@dataclass(frozen=True)
class Template:
    """A phrase (all words in a row) or, with ``keys``, a passage that may differ in a few words."""
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        column = _column([self.text])
        w = split(column, GAP)
        return [w.names[int(c)].as_py().decode() for c in w.code]


def _column(texts):
    import pyarrow as pa
    return pa.array(texts, pa.large_string())


# FIXED VALUES - the phrases that the contract names, and public notices and licence passages.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
NOTICES = (
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl", "gnu general public license"),
    Template("gpl-3", "gpl v3"),
    Template("gpl-2", "gpl v2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl-3", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("epl-2", "eclipse public license v 2"),
    Template("bsd-3-clause", "bsd 3 clause license"),
    Template("bsd-2-clause", "bsd 2 clause license"),
    Template("boost-1", "boost software license version 1"),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("isc", "isc license"),
    Template("mit", "spdx license identifier mit"),
    Template("apache-2", "spdx license identifier apache 2 0"),
    Template("gpl-3", "spdx license identifier gpl 3 0"),
    Template("gpl-2", "spdx license identifier gpl 2 0"),
    Template("bsd-3-clause", "spdx license identifier bsd 3 clause"),
)
PASSAGES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction including without limitation the rights "
             "to use copy modify merge publish distribute sublicense and or sell copies of the software",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
             "with the license you may obtain a copy of the license at",
             ("apache license version 2", "in compliance with the license")),
    Template("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided "
             "that the following conditions are met redistributions of source code must retain the above copyright notice this list "
             "of conditions and the following disclaimer neither the name of the copyright holder nor the names of its contributors "
             "may be used to endorse or promote products derived from this software without specific prior written permission",
             ("redistribution and use in source and binary forms", "endorse or promote products")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met redistributions of source code must retain the above copyright notice this list of "
             "conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
             "license as published by the free software foundation", ("free software", "gnu general public license")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
             "public license as published by the free software foundation", ("free software", "gnu lesser general public license")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
             "distributed with this file you can obtain one at", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
             "provided that the above copyright notice and this permission notice appear in all copies",
             ("with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
             "use compile sell or distribute this software", ("free and unencumbered software", "public domain")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
             "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
             "purpose including commercial applications", ("permission is granted to anyone to use this software",)),
)
TEMPLATES = BASE + NOTICES + PASSAGES


class Index:
    """Positional postings of the rare words of the templates, and the phrases to verify."""

    def __init__(self, templates, df: dict[str, int], n: int, rare: int = 8, drift: int = 3, share: float = 0.7):
        self.templates, self.drift, self.share = list(templates), drift, share
        self.vocabulary = vocabulary(templates)
        number = {w: i for i, w in enumerate(self.vocabulary)}
        count = np.array([df.get(w, 0) for w in self.vocabulary], float)
        self.idf = np.log1p((n - count + 0.5) / (count + 0.5)) if len(count) else count
        self.words = [np.array([number[w] for w in t.words], np.int64) for t in self.templates]
        self.keys = [[np.array([number[w] for w in Template("", k).words], np.int64) for k in t.keys] for t in self.templates]
        self.rare = []  # of each passage: (word, its positions) of highest IDF
        for t, w in zip(self.templates, self.words):
            distinct = sorted(set(w.tolist()), key=lambda v: (-self.idf[v], self.vocabulary[v]))[:rare] if t.keys else []
            self.rare.append([(v, np.flatnonzero(w == v)) for v in distinct])

    def code(self, words) -> np.ndarray:
        """Number of each word among the licence words, or -1."""
        import pyarrow as pa
        import pyarrow.compute as pc
        known = pa.array([w.encode() for w in self.vocabulary], pa.large_binary())
        own = pc.index_in(words.names, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
        return own[words.code].astype(np.int64) if len(words.code) else np.empty(0, np.int64)

    def scan(self, words) -> list[tuple[int, int, int, int, float]]:
        """``(row, template, first word, length, share)`` of all verified places, over all rows at once."""
        code = self.code(words)
        at = np.flatnonzero(code >= 0)
        order = np.argsort(code[at], kind="stable")
        begin = np.searchsorted(code[at][order], np.arange(len(self.vocabulary) + 1))
        places = [at[order[a:b]] for a, b in zip(begin[:-1], begin[1:])]  # of each licence word, ascending
        found = []
        for t, (template, w) in enumerate(zip(self.templates, self.words)):
            if template.keys:
                found += self._passage(t, code, places, words)
            else:
                hits = self._phrase(w, code, places, words.doc)
                found += [(int(words.doc[i]), t, int(i - words.first[words.doc[i]]), len(w), 1.0) for i in hits]
        return found

    def _phrase(self, w, code, places, doc) -> np.ndarray:
        """Every place where the words ``w`` stand in a row within one text."""
        by = sorted(range(len(w)), key=lambda j: (-self.idf[w[j]], j))
        start = places[w[by[0]]] - by[0]
        start = start[(start >= 0) & (start + len(w) <= len(code))]
        for j in by[1:]:
            start = start[code[start + j] == w[j]]
        return start[doc[start] == doc[start + len(w) - 1]]

    def _passage(self, t, code, places, words):
        w, doc = self.words[t], words.doc
        key = [self._phrase(k, code, places, doc) for k in self.keys[t]]
        if any(not len(k) for k in key):
            return []
        hit, line, word = [], [], []
        for v, position in self.rare[t]:
            p = places[v]
            hit.append(np.repeat(p, len(position)))
            line.append(np.repeat(p, len(position)) - np.tile(position, len(p)))
            word.append(np.full(len(p) * len(position), v))
        hit, line, word = np.concatenate(hit), np.concatenate(line), np.concatenate(word)
        # an alignment's lines lie close together, and so do its places: a text may hold a licence more than once
        order = np.lexsort((hit, line, doc[hit]))
        hit, line, word = hit[order], line[order], word[order]
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(line) > self.drift) | (np.diff(doc[hit]) != 0)
        group, out = np.split(np.arange(len(hit)), np.flatnonzero(new)[1:]), []
        for g in group:
            if len(np.unique(word[g])) < min(2, len(self.rare[t])):
                continue
            d = doc[hit[g[0]]]
            lines, votes = np.unique(line[g], return_counts=True)
            at = int(lines[np.argmax(votes)])
            a, b = max(int(words.first[d]), at - self.drift), min(int(words.first[d + 1]), at + len(w) + self.drift)
            share = _covered(w, code[a:b], at - a, self.drift)
            if share >= self.share and all(((k >= a) & (k + len(x) <= b)).any() for k, x in zip(key, self.keys[t])):
                out.append((int(d), t, max(at, a) - int(words.first[d]), len(w), share))
        return out


def _covered(w: np.ndarray, text: np.ndarray, shift: int, drift: int) -> float:
    """Share of the words ``w`` that stand in ``text`` at most ``drift`` words beside their place."""
    got = np.zeros(len(w), bool)
    for s in range(shift - drift, shift + drift + 1):
        a, b = max(0, -s), min(len(w), len(text) - s)
        if a < b:
            got[a:b] |= w[a:b] == text[a + s:b + s]
    return float(got.mean())


def vocabulary(templates) -> list[str]:
    return sorted({w for t in templates for text in (t.text, *t.keys) for w in Template("", text).words})


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many of all documents each licence word occurs, and the number of documents."""
    names = vocabulary(templates)

    def run(batches):
        import pyarrow as pa
        index, total, rows = Index(templates, {}, 0), np.zeros(len(names), np.int64), 0
        for b in pieces(batches):
            w = split(b.column(0), GAP)
            code = index.code(w)
            at = np.flatnonzero(code >= 0)
            total += np.bincount(np.unique(w.doc[at] * len(names) + code[at]) % len(names), minlength=len(names))
            rows += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), pa.array([*total.tolist(), rows], pa.int64())], ["word", "df"])

    sums = docs.select("text").mapInArrow(run, "word string, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    df = {r.word: r.df for r in sums.collect()}  # one row per licence word
    return df, df.pop(None, 0)


def matches(docs: DataFrame, templates=TEMPLATES, rare: int = 8, drift: int = 3, share: float = 0.7) -> DataFrame:
    """``(doc_id, n_words, matches)`` per row of ``docs``: label, first word, length and share of every verified place."""
    df, n = document_frequencies(docs, templates)
    index = Index(templates, df, n, rare, drift, share)

    def run(batches):
        import pyarrow as pa
        for b in pieces(batches):
            w = split(b.column(1), GAP)
            found = sorted(index.scan(w))
            bounds = np.searchsorted([x[0] for x in found], np.arange(b.num_rows + 1)) if found else np.zeros(b.num_rows + 1)
            t = [index.templates[x[1]] for x in found]
            items = pa.StructArray.from_arrays(
                [pa.array([x.label for x in t], pa.string()), pa.array([x.base for x in t], pa.bool_()),
                 pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64()),
                 pa.array([x[4] for x in found], pa.float64())], ["label", "base", "first", "length", "share"])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(w.first), pa.int64()), lists], ["doc_id", "n_words", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """Places and labels of each row: base ones alone, and all; ``score`` is the best share, 0 without a match."""
    def join(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.filter("matches", lambda m: m.base)
    places = F.transform(base, lambda m: m.first)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        join(F.transform(base, lambda m: m.label)).alias("base_labels"),
        join(F.transform("matches", lambda m: m.label)).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.share)), F.lit(0.0)).alias("score"))
