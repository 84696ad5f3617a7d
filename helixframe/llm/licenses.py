"""Licence scans with a positional rare-token index.

Templates are licence phrases and notices as word sequences.  The words of all templates form a fixed vocabulary whose document
frequencies are counted over the whole corpus.  Each template is indexed by its RARE words of highest inverse document frequency
(those that stand in the corpus at all go first) with their places in the template.  In a file, every occurrence of an indexed word proposes the start that its place
implies; proposals of a template's words that agree on a start are intersected, and a start with enough of them is
verified: all mandatory key phrases must stand at their places.  Its confidence is the idf-weighted share of the
template's words that stand in place; a file's score is the largest confidence.

Words are runs of digits, a-z and bytes from 0x80 on, after lower-casing A-Z.  Null and empty texts have no words and no
labels and score 0.  Matches never cross texts; texts of any length are scanned whole.  Labels that tie in a place all count, each once;
repeated rows repeat their result (and count each for the document frequencies); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEP_LUT, Words, arrow_map, hash_words, pieces, texts_of


class Template(NamedTuple):
    """keys: (first word, last word + 1) of each mandatory phrase; agree: share of the indexed words that must propose a start."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]
    agree: float = 1.0


def phrase(label: str, text: str) -> Template:
    words = tuple(text.split())
    return Template(label, words, ((0, len(words)),))


def notice(label: str, text: str, *keys: str) -> Template:
    """A longer text of which only the key phrases are mandatory."""
    words = text.split()
    at = []
    for key in keys:
        k = key.split()
        at.append(next((i, i + len(k)) for i in range(len(words)) if words[i : i + len(k)] == k))
    return Template(label, tuple(words), tuple(at), 0.5)


#: The base phrases and their labels.
BASE = (
    phrase("gpl", "gnu general public license"),
    phrase("apache", "apache license"),
    phrase("cc-by", "cc by"),
    phrase("mit", "mit license"),
)
#: Further phrases and notices.
MORE = (
    phrase("gpl-3.0", "gnu general public license version 3"),
    phrase("gpl-2.0", "gnu general public license version 2"),
    phrase("lgpl", "gnu lesser general public license"),
    phrase("agpl", "gnu affero general public license"),
    phrase("apache-2.0", "apache license version 2 0"),
    phrase("cc-by-nc", "cc by nc"),
    phrase("cc-by-sa", "cc by sa"),
    phrase("cc0", "cc0 1 0 universal"),
    phrase("mpl-2.0", "mozilla public license version 2 0"),
    phrase("bsd", "bsd license"),
    phrase("rights-reserved", "all rights reserved"),
    notice(
        "bsd-notice",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "source and binary forms", "with or without modification",
    ),
    notice(
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted", "free of charge",
    ),
    notice("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify", "with or without fee"),
    notice("warranty", "the software is provided as is without warranty of any kind express or implied", "provided as is", "without warranty of any kind"),
)
RARE = 4


class Index:
    """The vocabulary, its idf, and the indexed words of each template."""

    def __init__(self, templates: tuple[Template, ...], df: dict[int, int] | None = None, n_docs: int = 0):
        self.templates = templates
        self.vocabulary = sorted({w for t in templates for w in t.words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        hashes = hash_words(self.vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        df = df or {}
        self.idf = np.array([math.log((n_docs + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(self.vocabulary))])
        self.ids = [np.array([number[w] for w in t.words]) for t in templates]
        self.rare = []
        for ids in self.ids:
            last = {int(i): k for k, i in enumerate(ids)}  # a word that stands twice is indexed by its last place
            self.rare.append(sorted(((k, i) for i, k in last.items()), key=lambda p: (bool(df) and not df.get(p[1]), -self.idf[p[1]], p[0]))[:RARE])

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], -1)

    def matches(self, w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each template, the starts (word numbers of w) and the confidence of each."""
        ids = self.lookup(w.hash)
        at = np.flatnonzero(ids >= 0)
        kind = ids[at]
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(len(self.vocabulary) + 1))
        padded = np.concatenate([ids, np.full(64, -1)])
        text = np.repeat(np.arange(len(w.first)), w.n)
        out = []
        for template, words, rare in zip(self.templates, self.ids, self.rare, strict=True):
            places = [at[order[bounds[i] : bounds[i + 1]]] - k for k, i in rare]
            start, agree = np.unique(np.concatenate(places), return_counts=True)
            start = start[(agree >= max(1, math.ceil(template.agree * len(rare)))) & (start >= 0)]
            start = start[start + max(b for _, b in template.keys) <= len(ids)]
            for a, b in template.keys:
                start = start[(padded[start[:, None] + np.arange(a, b)] == words[a:b]).all(1)]
                start = start[text[start + b - 1] == text[start]] if len(start) else start
            step = start[:, None] + np.arange(len(words))
            inside = step < len(ids)
            here = (padded[np.minimum(step, len(ids))] == words) & inside
            if len(start):
                here &= text[np.minimum(step, len(ids) - 1)] == text[start][:, None]
            weight = self.idf[words]
            out.append((start, (here * weight).sum(1) / weight.sum()))
        return out


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> tuple[dict[int, int], int]:
    """In how many texts each vocabulary word stands, and the number of texts: at most one row for each vocabulary word."""
    index = Index(templates)

    def run(batches):
        for batch in batches:
            total, n = np.zeros(len(index.vocabulary) + 1, np.int64), 0
            texts = texts_of(batch.column(0))
            for i, j in pieces(texts):
                w = Words(texts[i:j], ALNUM_SEP_LUT)
                ids = index.lookup(w.hash)
                has = np.flatnonzero(ids >= 0)
                pair = np.unique(np.repeat(np.arange(j - i), w.n)[has] * len(index.vocabulary) + ids[has])
                total[:-1] += np.bincount(pair % len(index.vocabulary), minlength=len(index.vocabulary))
                n += j - i
            total[-1] = n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    counts = arrow_map(docs.select(F.col(text_col).cast("string").alias("text")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in counts}
    return found, found.pop(len(index.vocabulary), 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = MORE) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs; labels are sorted and joined by commas."""
    templates = base + more
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, *document_frequencies(docs, templates, text_col)))
    source = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    schema = source.drop("__text").schema
    for name, kind in (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")):
        schema = schema.add(name, kind)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            n = len(texts)
            words, hits, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[tuple[set, set]] = [(set(), set()) for _ in range(n)]
            for i, j in pieces(texts):
                w = Words(texts[i:j], ALNUM_SEP_LUT)
                words[i:j] = w.n
                if not len(w.hash):
                    continue
                text = np.repeat(np.arange(j - i), w.n)
                for k, (start, sure) in enumerate(index.value.matches(w)):
                    who = text[start] + i
                    np.maximum.at(score, who, sure)
                    for t in np.unique(who):
                        labels[t][k >= len(base)].add(templates[k].label)
                    if k < len(base):
                        np.add.at(hits, who, 1)
                        local = start - w.first[who - i]
                        np.minimum.at(first, who, local)
                        np.maximum.at(last, who, local)
            none = hits == 0
            columns = [
                pa.array(words), pa.array(hits), pa.array(first, mask=none), pa.array(last, mask=none),
                pa.array([",".join(sorted(a)) for a, _ in labels]), pa.array([",".join(sorted(a | b)) for a, b in labels]), pa.array(np.minimum(score, 1.0)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return arrow_map(source, run, schema)
