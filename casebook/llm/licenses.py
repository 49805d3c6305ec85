"""Licence scan with a positional index of rare words.

Templates are licence notices as word lists, each with the key phrases that a
real notice must hold.  The index maps a word to its postings, (template,
position).  A first pass counts, over all documents, how many hold each word
of the templates; that gives the words' inverse document frequencies.

A file's licence words are found with their positions.  A template can only
stand where all words of its key phrases stand, so of each template whose words
the file holds, the key words of highest inverse frequency are looked up, the
rarest first: a word at file position p and template position q puts the
template's start at p - q, and these starts are intersected word by word until
none is left or ``RARE_WORDS`` words agree.  What is left is verified: every key
phrase must stand at its place, word by word.  Its score is the share of the
template's inverse frequency found at the right positions.  ``rare_words`` sets
how much is left to verify, never the result.

The base phrases are templates of one key phrase each, so their places come
out of the same index.

Cases: a null or empty text has no words, no labels and score 0; texts of any
length are scanned whole; a notice never crosses texts; repeated rows each get
their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, KeyTable, TextBlock, byte_table, map_text, word_ranges

RARE_WORDS = 12

WORD_BYTES = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))  # of lower-cased text


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


BASE = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)
TEMPLATES = BASE + (
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the "
             "license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Template("artistic", "the artistic license", ("artistic license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
             "that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "released under the bsd license", ("bsd license",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal", ("cc0",)),
    Template("creative-commons", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
             "general public license as published by the free software foundation",
             ("free software you can redistribute it and or modify it", "gnu general public license")),
    Template("gpl-2", "gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3", "gnu general public license version 3", ("general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
             "hereby granted", ("permission to use copy modify and or distribute",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files", ("permission is hereby granted free of charge",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("proprietary", "unauthorized copying of this file via any medium is strictly prohibited",
             ("unauthorized copying of this file",)),
    Template("public-domain", "released into the public domain", ("into the public domain",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)


class Index:
    """Vocabulary, inverse frequencies, postings and key phrases of templates."""

    def __init__(self, templates: tuple[Template, ...], n_docs: int, doc_counts: dict[int, int]):
        self.templates = templates
        words = [t.text.split() for t in templates]
        self.vocabulary = list(dict.fromkeys(w for t in words for w in t))
        ids = {w: k for k, w in enumerate(self.vocabulary)}
        self.idf = np.array([math.log((n_docs + 1) / (doc_counts.get(k, 0) + 1)) + 1e-3 for k in range(len(ids))])
        self.words = [np.array([ids[w] for w in t], np.int64) for t in words]
        self.weight = [float(self.idf[w].sum()) for w in self.words]
        self.postings: list[list[tuple[int, int]]] = []  # of each template: (word id, place) of its key words, rarest first
        self.keys, anchors = [], set()  # of each template: (place, word ids) of its key phrases
        for t, template in enumerate(templates):
            row = []
            for key in template.keys:
                phrase = np.array([ids[w] for w in key.split()], np.int64)
                at = next(k for k in range(len(words[t])) if words[t][k:k + len(phrase)] == key.split())
                row.append((at, phrase))
                anchors.add(int(phrase[np.argmax(self.idf[phrase])]))
            self.keys.append(row)
            places = {at + k: int(v) for at, phrase in row for k, v in enumerate(phrase)}
            self.postings.append([(v, q) for q, v in sorted(places.items(), key=lambda x: (-self.idf[x[1]], x[0]))])
        self.anchor = np.zeros(len(ids), bool)
        self.anchor[list(anchors)] = True

    def table(self) -> KeyTable:
        return KeyTable([w.encode() for w in self.vocabulary])

    def starts(self, t: int, at: dict[int, np.ndarray], rare_words: int) -> np.ndarray:
        """Where the template's rarest key words agree that it starts; ``at`` has
        the file positions of each word, rising."""
        left = np.zeros(0, np.int64)
        if all(v in at for v, _ in self.postings[t]):
            for k, (v, q) in enumerate(self.postings[t][:max(1, rare_words)]):
                left = at[v] - q if k == 0 else left[np.isin(left, at[v] - q, assume_unique=True)]
                if not len(left):
                    break
        return left

    def places(self, ids: np.ndarray, found: np.ndarray, rare_words: int) -> list[tuple[int, int, float]]:
        """(template, start, score) of the verified places in one file, whose
        words have vocabulary ids (-1: none) and licence words at ``found``."""
        order = found[np.argsort(ids[found], kind="stable")]
        kinds, firsts = np.unique(ids[order], return_index=True)
        at = dict(zip(kinds.tolist(), np.split(order, firsts[1:])))
        out = []
        for t in range(len(self.templates)):
            for start in self.starts(t, at, rare_words).tolist():
                for offset, phrase in self.keys[t]:
                    a = start + offset
                    if a < 0 or a + len(phrase) > len(ids) or not np.array_equal(ids[a:a + len(phrase)], phrase):
                        break
                else:
                    row = self.words[t]
                    lo, hi = max(0, -start), min(len(row), len(ids) - start)
                    same = row[lo:hi] == ids[start + lo:start + hi]
                    out.append((t, start, float(self.idf[row[lo:hi][same]].sum()) / self.weight[t]))
        return out


def _words(block: TextBlock):
    data = LOWER[block.data]
    starts, ends, before = word_ranges(data, block.offsets, WORD_BYTES)
    return data, starts, ends, before


def word_document_counts(df: DataFrame, text_col: str, templates: tuple[Template, ...]) -> tuple[int, dict[int, int]]:
    """The number of documents, and for each word of the templates in how many
    it occurs: sums per block, added up by Spark; what reaches the driver is
    one row a word of the fixed vocabulary."""
    vocabulary = Index(templates, 0, {}).vocabulary

    def run(batches):
        from .common import text_blocks
        known = KeyTable([w.encode() for w in vocabulary])
        total, docs = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, _, block in text_blocks(batch.column(0)):
                data, starts, ends, before = _words(block)
                which, rows = known.find(data, starts, ends)
                doc = np.searchsorted(before, which, "right") - 1
                pairs = np.unique(doc * len(vocabulary) + rows)
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                docs += len(block)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(vocabulary)), pa.int64()), pa.array([docs, *total.tolist()], pa.int64())],
                                         names=["word", "docs"])

    counts = (df.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "word bigint, docs bigint")
              .groupBy("word").agg(F.sum("docs").alias("docs")).collect())
    found = {r["word"]: r["docs"] for r in counts}
    return found.pop(-1, 0), found


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: tuple[Template, ...] = TEMPLATES, rare_words: int = RARE_WORDS) -> DataFrame:
    """Per row: the id, n_words, and ``places``: label, whether it is a base
    phrase, first word, number of words and score of each verified place."""
    n_docs, counts = word_document_counts(df, text_col, templates)
    index = Index(templates, n_docs, counts)
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("n_words", pa.int64()),
                               ("score", pa.float64())]))

    def make():
        known = index.table()

        def work(block: TextBlock) -> list[pa.Array]:
            data, starts, ends, before = _words(block)
            which, rows = known.find(data, starts, ends)
            ids = np.full(len(starts), -1, np.int64)
            ids[which] = rows
            hit = which[index.anchor[rows]]  # a file without any key phrase's rarest word has no place
            docs = np.unique(np.searchsorted(before, hit, "right") - 1)
            cuts = np.searchsorted(which, before)
            out: list[list[dict]] = [[] for _ in range(len(block))]
            for d in docs.tolist():
                lo, hi = before[d], before[d + 1]
                for t, start, score in index.places(ids[lo:hi], which[cuts[d]:cuts[d + 1]] - lo, rare_words):
                    template = templates[t]
                    out[d].append({"label": template.label, "base": template.base, "word": start,
                                   "n_words": len(index.words[t]), "score": min(1.0, score)})
            return [pa.array(np.diff(before)), pa.array(out, kind)]
        return work

    return map_text(df, text_col, [id_col], [("n_words", "bigint"), (
        "places", "array<struct<label:string,base:boolean,word:bigint,n_words:bigint,score:double>>")], make)


def license_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score
    (the best place's, 0 without any), from scan_licenses."""
    found = scan_licenses(df, id_col, text_col)
    base = F.filter("places", lambda x: x["base"])
    labels = lambda places: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))))
    starts = F.transform(base, lambda x: x["word"])
    return found.select(F.col(f"`{id_col}`"), "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"))
