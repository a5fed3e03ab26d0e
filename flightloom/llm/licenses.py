"""Licence scan with a positional rare-token index.

Templates are word sequences; the index holds, for every template word, the templates and offsets it stands at. Each
file looks up the rarest licence words it holds: of every template so many, of highest inverse document frequency first,
that a place with `least` cover cannot do without all of them (words the file lacks are missed everywhere; the others
looked up stand at more offsets than may still be missed). A posting (template, offset) of a word at place p proposes
the start p - offset; proposals are intersected by relative position: a start's cover is the share of the template's
words that stand at their offset. A template is accepted at `least` cover if its mandatory
key phrase stands in the file at the same relative place.

Scale: two passes without a shuffle of texts; document frequencies are counted for the template words alone (a fixed
list), so they and the index are of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flightloom.llm.shared import lookup
from flightloom.llm.text import ALPHANUMERIC, Words, joined, slices, word_hash


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: must stand word by word inside the match; the whole text if empty
    key: str = ""
    base: bool = False


#: The phrases every place of which is counted.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
#: Notices of well-known licences, in words.
NOTICES = (
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: First paragraphs of the licences' own notices, in words.
PARAGRAPHS = (
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution and use in source and binary forms"),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
)

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass
class _Entry:
    label: str
    base: bool
    ids: np.ndarray  # vocabulary ids by offset
    order: np.ndarray  # distinct vocabulary ids, rarest first
    key_at: int
    key_len: int


class Index:
    """Vocabulary hashes of all templates and, for each template, its words by offset and by rarity."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = tuple(templates)
        words = sorted({w for t in self.templates for w in t.text.split()})
        self.hashes, order = np.unique(np.array([word_hash(w, ALPHANUMERIC) for w in words], np.uint64), return_index=True)
        self.id_of = {words[o]: i for i, o in enumerate(order)}
        self.entries: list[_Entry] = []

    def rank(self, df: np.ndarray) -> None:
        """Orders each template's words by document frequency, rarest first (ties by vocabulary order)."""
        self.entries = []
        for t in self.templates:
            ids = np.array([self.id_of[w] for w in t.text.split()])
            distinct = np.unique(ids)
            key = t.key.split()
            words = t.text.split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key) if key else 0
            self.entries.append(_Entry(t.label, t.base, ids, distinct[np.lexsort((distinct, df[distinct]))], at, len(key) or len(words)))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of licence words and their vocabulary ids."""
        at, there = lookup(self.hashes, words.hash)
        places = np.flatnonzero(there)
        return places, at[places]

    def matches(self, words: Words, least: float) -> Iterator[tuple[_Entry, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, starts, covers, key phrase present, text) for every start of `least` cover, and others."""
        places, ids = self.hits(words)
        vocabulary = np.full(len(words.hash) + 1, -1, np.int32)
        vocabulary[places] = ids
        text_of = words.text
        held = np.zeros((words.texts, len(self.hashes)), bool)
        held[text_of[places], ids] = True
        for e in self.entries:
            n = len(e.ids)
            size = np.bincount(e.ids, minlength=len(self.hashes))[e.order]
            present = held[:, e.order]
            # offsets that may be missed, less those of words the text has nowhere
            left = n - (n if e.base else int(np.ceil(least * n - 1e-9))) - (~present * size).sum(1)
            rarer = np.cumsum(present * size, 1) - present * size
            looked = present & (rarer <= left[:, None])
            proposals = []
            for k in np.flatnonzero(looked.any(0)):
                mine = places[(ids == e.order[k]) & looked[text_of[places], k]]
                proposals += [np.stack([text_of[mine], mine - offset]) for offset in np.flatnonzero(e.ids == e.order[k])]
            if not proposals:
                continue
            # a start may lie before its text
            owner, s = np.unique(np.concatenate(proposals, 1), axis=1)
            found = np.zeros((len(s), n), bool)
            for j, v in enumerate(e.ids):
                p = s + j
                ok = (p >= words.first[owner]) & (p < words.first[owner + 1])
                found[:, j] = ok & (vocabulary[np.where(ok, p, -1)] == v)
            yield e, s, found.mean(1), found[:, e.key_at : e.key_at + e.key_len].all(1), owner


def _frequencies(docs: DataFrame, index: Index, text: str) -> np.ndarray:
    """Texts that hold each template word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(index.hashes), np.int64)
        for batch in batches:
            data, offsets = joined(batch.column(text))
            for a, b in slices(offsets):
                words = Words(data, offsets, a, b, ALPHANUMERIC)
                places, ids = index.hits(words)
                pairs = np.unique(words.text[places] * len(df) + ids)
                df += np.bincount(pairs % len(df), minlength=len(df))
        yield pa.RecordBatch.from_pydict({"id": np.arange(len(df)), "df": df})

    out = np.zeros(len(index.hashes), np.int64)
    for row in docs.select(text).mapInArrow(count, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        out[row["id"]] = row["df"]
    return out


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES + PARAGRAPHS, least: float = 0.75, text: str = "text") -> DataFrame:
    """docs (without the text) with the places of base phrases and the labels of all templates.

    n_base counts every start of a base phrase, overlapping ones too; first_word and last_word are the smallest and
    largest start; labels and base_labels are distinct, sorted and comma-joined (empty string if none); score is the
    best cover of an accepted template, 0 if none is. Null and empty texts have no words. Columns with the names of results
    are replaced.
    """
    index = Index(templates)
    index.rank(_frequencies(docs, index, text))
    rest = [f for f in docs.schema if f.name != text and f.name not in {x.split()[0] for x in RESULT.split(", ")}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = joined(batch.column(text))
            n = batch.num_rows
            n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: dict[int, set[str]] = {}
            base_labels: dict[int, set[str]] = {}
            for a, b in slices(offsets):
                words = Words(data, offsets, a, b, ALPHANUMERIC)
                n_words[a:b] = words.counts
                for e, starts, cover, key, owner in index.matches(words, least):
                    good = (cover == 1) if e.base else (cover >= least) & key
                    starts, cover, owner = starts[good], cover[good], owner[good]
                    if e.base:
                        np.add.at(n_base, a + owner, 1)
                        np.minimum.at(first, a + owner, starts - words.first[owner])
                        np.maximum.at(last, a + owner, starts - words.first[owner])
                    np.maximum.at(score, a + owner, cover)
                    for d in np.unique(owner):
                        labels.setdefault(a + int(d), set()).add(e.label)
                        if e.base:
                            base_labels.setdefault(a + int(d), set()).add(e.label)
            none = n_base == 0
            out = [
                pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                pa.array([",".join(sorted(base_labels.get(i, ()))) for i in range(n)], pa.string()),
                pa.array([",".join(sorted(labels.get(i, ()))) for i in range(n)], pa.string()), pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *out], names=[*(f.name for f in rest), *(x.split()[0] for x in RESULT.split(", "))])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select(*(f"`{f.name}`" for f in rest), text).mapInArrow(run, f"{ddl}, {RESULT}" if rest else RESULT)
