"""Licence scans: TF-IDF cosine of header lines and licence files to templates, then inheritance down directories."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.llm.wordhash import ALNUM_WORDS, words_by_block
from corbel.workspace import Workspace

#: Short forms and standard notices of the licences looked for.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    *((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
      for name, kind, version in (("GPL-3.0", "", "3"), ("GPL-2.0", "", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
#: Whole licences, a file each; AGPL 3 is the wording of GPL 3 under its own name.
TEXTS_DIR = Path(__file__).with_name("licence_texts")
#: Passages of the length of a whole licence begin at every so manieth part of that length.
STRIDES = 8
#: A passage is looked at closely if its cosine is at most so far below the wanted one: it may begin up to half a stride off.
SLACK = 0.1
#: A line or file is a licence when its best cosine reaches this.
COSINE = 0.75
LICENCE_NAMES = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
#: At most so many directories (path and licence) are broadcast.
BROADCAST_DIRS = 200_000


def licence_texts() -> tuple[tuple[str, str], ...]:
    found = {p.stem: p.read_text() for p in sorted(TEXTS_DIR.glob("*.txt"))}
    found["AGPL-3.0"] = re.sub(r"(?i)(\bGNU\s+)(General\s+Public\s+License)", r"\1Affero \2", found["GPL-3.0"])
    return tuple(found.items())


class _Index:
    """Weights of template terms, and terms of texts counted over them."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        self.counts: list[Counter] = []
        for column in ([t for _, t in templates],):
            for *_, split, _, _, hashes in words_by_block(pa.array(column), ALNUM_WORDS):
                self.counts += [Counter(hashes[a:b].tolist()) for a, b in zip(split[:-1], split[1:], strict=True)]
        self.terms = np.array(sorted({t for c in self.counts for t in c}), np.uint64)
        self.tf = np.zeros((len(self.counts), len(self.terms)))
        for k, c in enumerate(self.counts):
            for term, n in c.items():
                self.tf[k, np.searchsorted(self.terms, np.uint64(term))] = n
        self.words = self.tf.sum(1).astype(int)

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        self.idf = np.log((1 + n_docs) / (1 + df)) + 1
        self.unseen = float(np.log(1 + n_docs) + 1)
        weighed = self.tf * self.idf
        self.unit = weighed / np.maximum(np.sqrt((weighed**2).sum(1, keepdims=True)), 1e-12)
        self.power = np.r_[self.idf**2, 0.0]  # of the term in each slot, and of slot -1

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among the terms, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def held(self, slots: np.ndarray) -> np.ndarray:
        """For each template the greatest cosine that any part of these words can have with it.

        A part's vector has no more terms than the whole, so by Cauchy's inequality its product with the template's unit
        vector is at most its length times that of the unit vector on those terms.
        """
        there = np.zeros(len(self.terms), bool)
        there[slots[slots >= 0]] = True
        return np.sqrt((self.unit[:, there] ** 2).sum(1))

    def cosine(self, hashes: np.ndarray, slots: np.ndarray, k: int) -> float:
        """The cosine of words with template ``k``."""
        known = slots >= 0
        weighed = np.bincount(slots[known], minlength=len(self.terms)) * self.idf
        other = np.unique(hashes[~known], return_counts=True)[1]
        norm = np.sqrt((weighed**2).sum() + ((other * self.unseen) ** 2).sum())
        return float(self.unit[k] @ weighed / max(norm, 1e-12))

    def best(self, hashes: np.ndarray, slots: np.ndarray) -> tuple[float, int]:
        """The greatest cosine and its template, for the words of one line or file."""
        known = slots >= 0
        tf = np.bincount(slots[known], minlength=len(self.terms))
        other = np.unique(hashes[~known], return_counts=True)[1]
        weighed = tf * self.idf
        norm = np.sqrt((weighed**2).sum() + ((other * self.unseen) ** 2).sum())
        cos = self.unit @ weighed / max(norm, 1e-12)
        return float(cos.max()), int(cos.argmax())


def _term_counts(index: _Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(index.terms), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for lo, hi, _, _, split, _, _, hashes in words_by_block(batch.column("text"), ALNUM_WORDS):
                slot = index.slots(hashes)
                row = np.searchsorted(split, np.arange(len(hashes)), side="right") - 1
                pairs = np.unique((row * len(index.terms) + slot)[slot >= 0])
                df += np.bincount(pairs % len(index.terms), minlength=len(index.terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df), dtype=np.int32)), pa.array(np.r_[n, df])], names=["term", "df"])

    return run


class _Reach:
    """Whether the words from x to y can reach a cosine of ``least`` with any template.

    A template has nothing in the direction of unknown words.  So cos^2 <= K / (K + U), where K, the squared weight of
    known words, is at most their number times the sum of their squared idf (n words count at most n times each), and U, of
    unknown words, at least their number times theirs.
    """

    def __init__(self, index: _Index, slot: np.ndarray, least: float):
        self.index, self.least = index, least
        self.known, self.power = np.r_[0, np.cumsum(slot >= 0)], np.r_[0.0, np.cumsum(index.power[slot])]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        known = self.known[y] - self.known[x]
        most, other = known * (self.power[y] - self.power[x]), (y - x - known) * self.index.unseen**2
        return (known >= 2) & (most * (1 - self.least**2) * (1 + 1e-9) + 1e-9 >= self.least**2 * other)


def _runs(ends: np.ndarray, reach: _Reach, most: int) -> Iterator[tuple[int, int]]:
    """Runs of lines of at most ``most`` words, and single lines of any length, that may reach the cosine.

    A line without known words at either end only lowers the cosine, so runs begin and end with known ones.
    """
    some = np.flatnonzero(reach.known[ends[1:]] > reach.known[ends[:-1]])  # lines with known words
    first, last = ends[some], ends[some + 1]
    for more in range(len(some)):
        x, y = first[: len(some) - more], last[more:]
        short = y - x <= most
        if more and not short.any():
            break
        for i in np.flatnonzero(reach(x, y) & (short | (more == 0))):
            yield x[i], y[i]


def _passages(whole: _Index, hashes: np.ndarray, slots: np.ndarray, ends: np.ndarray, least: float) -> list[tuple[float, int, int, int]]:
    """(cosine, licence, first word, end) of passages of a file that are whole licences.

    For each licence that the file's words could hold, passages of its length are compared at fixed strides.  Around those that
    come near, first and last words move to starts and ends of lines, an end at a time, as long as the cosine grows.
    """
    found = []
    for k in np.flatnonzero(whole.held(slots) >= least - SLACK):
        size = int(whole.words[k])
        step = max(1, size // STRIDES)
        near = []
        for x in range(0, max(1, len(hashes) - size + step), step):
            y = min(len(hashes), x + size)
            cos = whole.cosine(hashes[x:y], slots[x:y], k)
            if cos >= least - SLACK:
                near.append((cos, x, y))
        for cos, x, y in sorted(near, reverse=True):
            if any(x < q and p < y for _, j, p, q in found if j == k):  # another start of the same one
                continue
            for _ in range(3):
                was = (x, y)
                for q in ends[(ends > x) & (np.abs(ends - y) <= step)]:
                    cos, y = max((cos, y), (whole.cosine(hashes[x:q], slots[x:q], k), int(q)))
                for p in ends[(ends < y) & (np.abs(ends - x) <= step)]:
                    cos, x = max((cos, x), (whole.cosine(hashes[p:y], slots[p:y], k), int(p)))
                if was == (x, y):
                    break
            if cos >= least:
                found.append((cos, k, x, y))
    return found


def _detect(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, whole = shared.value
        most = 2 * index.words.max(initial=0)
        for batch in batches:
            found, score, kind = [None] * batch.num_rows, [0.0] * batch.num_rows, [None] * batch.num_rows
            every: list[str | None] = [None] * batch.num_rows
            for lo, hi, part, cuts, split, starts, _, hashes in words_by_block(batch.column("text"), ALNUM_WORDS):
                slot, slot_w = index.slots(hashes), whole.slots(hashes)
                newline = np.cumsum(part == 10) if len(part) else np.zeros(0, np.int64)
                line = newline[starts] if len(starts) else np.zeros(0, np.int64)
                reach, reach_w = _Reach(index, slot, least), _Reach(whole, slot_w, least)
                for r in range(hi - lo):
                    a, b = split[r], split[r + 1]
                    if a == b:
                        continue
                    ends = np.r_[a, np.flatnonzero(np.diff(line[a:b])) + a + 1, b]
                    hits = []  # whole licences: the file, and passages of it
                    if reach_w(a, b):
                        cos, k = whole.best(hashes[a:b], slot_w[a:b])
                        if cos >= least:
                            hits.append((cos, -k, a, b, "file"))
                    hits += [(cos, -k, x + a, y + a, "passage") for cos, k, x, y in _passages(whole, hashes[a:b], slot_w[a:b], ends - a, least)]
                    said = []  # (cosine, name, first word, end, kind): the best ones that do not overlap
                    for cos, k, x, y, what in sorted(hits, reverse=True):
                        if all(y <= p or q <= x for _, _, p, q, _ in said):
                            said.append((cos, whole.names[-k], x, y, what))
                    units = [(x, y, "header") for x, y in _runs(ends, reach, most)]
                    if reach(a, b):
                        units.append((a, b, "file"))
                    lines = []
                    for n, (x, y, what) in enumerate(units):
                        cos, k = index.best(hashes[x:y], slot[x:y])
                        if cos >= least:
                            lines.append((-cos, n, k, x, y, what))
                    for cos, _, k, x, y, what in sorted(lines):  # lines inside a whole licence say less
                        if all(y <= p or q <= x for _, _, p, q, _ in said):
                            said.append((-cos, index.names[k], x, y, what))
                    if said:
                        score[lo + r], found[lo + r], _, _, kind[lo + r] = said[0]
                        every[lo + r] = ",".join(dict.fromkeys(name for _, name, *_ in sorted(said, key=lambda s: s[2])))
            cols = [batch.column("given"), batch.column("path"), pa.array(found, pa.string()), pa.array(every, pa.string()), pa.array(score, pa.float64()), pa.array(kind, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["given", "path", "licence", "licences", "cosine", "via"])

    return run


def scan_licences(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = COSINE, ws: Workspace | None = None, texts: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """``files(path, text, ...)`` -> ``path``, the key columns given besides ``text``, licence, licences, cosine, via, inherited_from.

    Each file is compared with ``texts`` (whole licences, by default those of ``TEXTS_DIR``): the whole of it, whatever its
    length, and its passages (``_passages``), so a licence is found inside a longer file.  Its lines, its runs of neighbouring
    lines (those of up to twice the words of the longest template) and its whole are compared with ``templates``; fewer than two words
    that templates know are no match.  The measure is the TF-IDF cosine: terms are runs of letters and digits (A-Z folded), a
    term's weight its count times ln((1 + N) / (1 + df)) + 1 with document counts over all files, 0 for words no template has.

    Of matches that overlap the one with the greatest cosine counts, whole licences before lines; of equal cosines the first
    template, then the first place.  ``licences`` names all that are left, in the order of their places, joined by commas; ``licence``
    is the best of them, with its cosine; ``via`` is file, passage or header.  A file without a licence of its own inherits those of
    the nearest directory above it (its own first) that holds a licence file: one named LICENSE, COPYING or NOTICE with a match;
    of several, the least path.  Then ``via`` is inherited and ``inherited_from`` that directory.  A null or empty text has no
    licence but may inherit; a null path inherits nothing; repeated rows are answered each.
    """
    spark = files.sparkSession
    ws = ws or Workspace(spark, "licences")
    texts = licence_texts() if texts is None else texts
    every = _Index([*templates, *texts])
    index, whole = _Index(list(templates)), _Index(list(texts))
    counts = files.select("text").mapInArrow(_term_counts(every), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row for each term
    df = {r.term: r.df for r in counts}
    for x in (index, whole):
        x.weigh(np.array([df.get(k, 0) for k in every.slots(x.terms).tolist()], float), df.get(-1, 0))
    names = [c for c in files.columns if c not in ("text", "licence", "licences", "cosine", "via", "inherited_from")]
    # the columns given travel as one, so that none clashes with those made here
    given = files.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("given"), "path", "text")
    shared = spark.sparkContext.broadcast((index, whole))
    schema = T.StructType([given.schema["given"], given.schema["path"], T.StructField("licence", T.StringType()), T.StructField("licences", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("via", T.StringType())])
    own = given.mapInArrow(_detect(shared, least), schema)
    own = ws.save(own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "own")

    named = own.filter(F.col("licence").isNotNull() & F.element_at(F.split("path", "/"), -1).rlike(LICENCE_NAMES))
    held = ws.save(named.groupBy(F.col("dir").alias("above")).agg(F.min_by(F.struct("licence", "licences"), F.struct("path", "licence")).alias("up_licence")), "held")
    dirs = own.filter("licence is null and path is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("above")).distinct()
    held_ = F.broadcast(held) if held.count() <= BROADCAST_DIRS else held
    near = above.join(held_, "above").groupBy("dir").agg(F.max_by(F.struct("up_licence", "above"), F.length("above")).alias("up"))
    near = ws.save(near.select("dir", "up.up_licence", "up.above"), "near")
    near_ = F.broadcast(near) if near.count() <= BROADCAST_DIRS else near
    out = own.join(near_, "dir", "left")
    heir = F.col("licence").isNull() & F.col("up_licence").isNotNull()
    return out.select(
        *[F.col(f"given.`{c}`").alias(c) for c in names], *[F.when(heir, F.col(f"up_licence.{c}")).otherwise(F.col(c)).alias(c) for c in ("licence", "licences")], "cosine",
        F.when(heir, F.lit("inherited")).otherwise(F.col("via")).alias("via"), F.when(heir, F.col("above")).alias("inherited_from"),
    )
