"""License notices in documents: known phrases, and text blocks that contain most of a notice's wording.

The second part is an exact set-similarity join between blocks of text and templates. A template's tokens are its distinct
shingles of five words. A block, for a template of ``m`` words, is ``2 m`` consecutive words, beginning at every ``m``-th
word of a document, so ``m`` words in a row always lie whole within one. A block matches if it holds at least the share
``least`` of the template's tokens. All such blocks are found:

* one scan of the texts writes the places of all template tokens, compared by hash and then word for word;
* the tokens are ordered by how often the corpus has them, over all documents, rarest first;
* prefix filter: of ``n`` tokens a matching block has ``need`` and so at least one of the first ``n - need + 1``. Only
  pairs of a block and a template with such a token become candidates;
* length filter: a block cut off by the end of its document needs room for ``need`` shingles;
* positional filter: the tokens missing before the last prefix token found must leave ``need`` reachable;
* the candidates are joined with all token places of their blocks and the distinct tokens are counted.

What is broadcast are the templates' tokens, whose number is that of the templates given, not that of the documents. Groups are the
tokens within one block, never more than a template has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.llm import words as W
from reachlens.session import materialize

# The phrases of the contract with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Published notices of common licenses, short and long forms, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions:",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
        " in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY"
        " KIND, either express or implied.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met:",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass(frozen=True)
class Licenses:
    """``least``: share of a template's shingles of ``shingle`` words that a block must hold."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES
    shingle: int = 5
    least: float = 0.8


def words_of(text: str) -> list[bytes]:
    """The words of one short text."""
    return [w for part in W.chunks(pc.ascii_lower(pa.array([text])), W.NO_LETTER_OR_DIGIT) for w in _bytes(part, 0, int(part.first[-1]))]


def _bytes(words: W.Words, first: int, count: int) -> list[bytes]:
    return [words.data[words.starts[i] : words.ends[i]].tobytes() for i in range(first, first + count)]


@dataclass
class Vocabulary:
    """The templates' shingles by hash, and which templates have them. A template shorter than a shingle is refused."""

    rule: Licenses
    tokens: list[tuple[bytes, ...]] = field(default_factory=list)
    sets: list[tuple[int, ...]] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        number: dict[tuple[bytes, ...], int] = {}
        for _, text in self.rule.templates:
            found = words_of(text)
            if len(found) < self.rule.shingle:
                raise ValueError(f"a template needs {self.rule.shingle} words: {text!r}")
            shingles = {tuple(found[i : i + self.rule.shingle]) for i in range(len(found) - self.rule.shingle + 1)}
            self.sets.append(tuple(sorted(number.setdefault(s, len(number)) for s in sorted(shingles))))
            self.lengths.append(len(found))
        self.tokens = list(number)
        hashes = np.array([_hash_of(s)[0] for s in self.tokens], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[self.hashes >> np.uint64(48)] = True
        self.phrases = [(words_of(phrase), _hash_of(words_of(phrase))[1]) for phrase, _ in self.rule.phrases]

    def need(self, template: int) -> int:
        """Tokens that a matching block holds at least."""
        return max(1, math.ceil(self.rule.least * len(self.sets[template]) - 1e-9))


def _hash_of(found: list[bytes] | tuple[bytes, ...]) -> tuple[np.uint64, np.ndarray]:
    """Hash of a word sequence, and those of its words."""
    (part,) = W.chunks(pa.array([b" ".join(found).decode()]), W.NO_LETTER_OR_DIGIT)
    hashes = part.hashes()
    return W.sequence_hashes(W.sequence_sums(hashes), np.array([0]), len(hashes))[0], hashes


def _runs(words: W.Words, text: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Of ``starts`` those with ``size`` words left in their text."""
    return starts[words.first[text[starts] + 1] >= starts + size]


def _places(rule: Licenses):
    """Words, phrase places and template tokens of every text. Texts are taken some at a time, whole."""

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, row = Vocabulary(rule), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0), pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            for words in W.chunks(texts, W.NO_LETTER_OR_DIGIT):
                n, text, hashes = len(words.rows), words.texts(), words.hashes()
                base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                hits: list[list[dict]] = [[] for _ in range(n)]
                for (found, known), (_, label) in zip(vocabulary.phrases, rule.phrases):
                    starts = _runs(words, text, np.flatnonzero(hashes == known[0]), len(found))
                    for i in starts.tolist():
                        if _bytes(words, i, len(found)) == found:
                            base[text[i]].append((i - int(words.first[text[i]]), label))
                starts = np.arange(max(0, len(hashes) - rule.shingle + 1))
                runs = W.sequence_hashes(W.sequence_sums(hashes), starts, rule.shingle)
                near = np.flatnonzero(vocabulary.sieve[runs >> np.uint64(48)])
                place = np.minimum(np.searchsorted(vocabulary.hashes, runs[near]), len(vocabulary.hashes) - 1)
                same = vocabulary.hashes[place] == runs[near]
                near, token = near[same], vocabulary.order[place[same]]
                whole = words.first[text[near] + 1] >= near + rule.shingle
                for i, t in zip(near[whole].tolist(), token[whole].tolist()):
                    if tuple(_bytes(words, i, rule.shingle)) == vocabulary.tokens[t]:
                        hits[text[i]].append({"at": i - int(words.first[text[i]]), "token": t})
                starts_of = [[at for at, _ in b] for b in base]
                columns = [
                    pa.array(range(row, row + n), pa.int64()),
                    ids.slice(words.rows.start, n),
                    pa.array(words.counts().astype(np.int64)),
                    pa.array([len(b) for b in base], pa.int64()),
                    pa.array([min(s, default=None) for s in starts_of], pa.int64()),
                    pa.array([max(s, default=None) for s in starts_of], pa.int64()),
                    pa.array([sorted({label for _, label in b}) for b in base], pa.list_(pa.string())),
                    pa.array(hits, pa.list_(pa.struct([("at", pa.int64()), ("token", pa.int32())]))),
                ]
                row += n
                names = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "hits"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return function


_PLACES = (
    "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>,"
    " hits array<struct<at:long,token:int>>"
)


def _ordered_templates(vocabulary: Vocabulary, hits: DataFrame) -> DataFrame:
    """``token, template, rank, size, need, words``: the tokens of every template, the corpus' rarest first."""
    counted = dict(hits.groupBy("token").agg(F.count(F.lit(1))).collect())  # one row for each template token at most
    rows = []
    for template, tokens in enumerate(vocabulary.sets):
        ordered = sorted(tokens, key=lambda t: (counted.get(t, 0), t))
        rows += [
            (t, template, rank, len(tokens), vocabulary.need(template), vocabulary.lengths[template])
            for rank, t in enumerate(ordered)
        ]
    schema = "token int, template int, rank int, size int, need int, words long"
    return F.broadcast(hits.sparkSession.createDataFrame(rows, schema))


def _in_blocks(hits: DataFrame, templates: DataFrame, rule: Licenses) -> DataFrame:
    """Every token place in the one or two blocks that hold all of its words, for each template that has the token."""
    at, block = F.col("at"), F.floor(F.col("at") / F.col("words"))
    ends_before = at + rule.shingle <= (block + 1) * F.col("words")
    blocks = F.when((block > 0) & ends_before, F.array(block - 1, block)).otherwise(F.array(block))
    return hits.join(templates, "token").withColumn("block", F.explode(blocks))


def matching_blocks(hits: DataFrame, templates: DataFrame, rule: Licenses) -> DataFrame:
    """``row, template, block, contained, size, words``: all blocks that reach the share.

    ``hits`` has the token places (row, n_words, at, token).
    """
    key = ["row", "template", "block"]
    placed = _in_blocks(hits, templates, rule)
    missing = F.col("size") - F.col("need")
    room = F.least(F.col("n_words"), (F.col("block") + 2) * F.col("words")) - F.col("block") * F.col("words") - (rule.shingle - 1)
    ranks = F.array_sort(F.collect_set("rank"))
    prefix = placed.where((F.col("rank") <= missing) & (room >= F.col("need")))
    candidates = prefix.groupBy(key).agg(ranks.alias("ranks"), F.first("size").alias("size"), F.first("need").alias("need"))
    missed = F.element_at("ranks", -1) - (F.size("ranks") - 1)
    candidates = candidates.where(missed <= missing).select(*key)
    counted = placed.join(candidates, key, "left_semi").groupBy(*key, "size", "need", "words")
    found = counted.agg(F.count_distinct("rank").alias("contained"))
    return found.where(F.col("contained") >= F.col("need")).select(*key, "contained", "size", "words")


def scan(docs: DataFrame, rule: Licenses = Licenses(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks`` of every document.

    ``blocks`` lists the matching blocks as (label, first word, end, containment) by place. The score is 1 with a known
    phrase, else the largest containment found, else 0. A null text has no words; null and repeated ids keep a row each; an
    empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    places = materialize(texts.mapInArrow(_places(rule), _PLACES), "licenses")
    hits = places.where(F.size("hits") > 0).select("row", "n_words", F.explode("hits").alias("hit")).select("row", "n_words", "hit.*")
    vocabulary = Vocabulary(rule)
    found = matching_blocks(hits, _ordered_templates(vocabulary, hits), rule)
    labels = F.array(*[F.lit(label) for label, _ in rule.templates])
    first = F.col("block") * F.col("words")
    block = F.struct(
        first.alias("first_word"),
        (first + 2 * F.col("words")).alias("end"),
        F.get(labels, F.col("template")).alias("label"),
        (F.col("contained") / F.col("size")).alias("containment"),
    )
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    joined = places.drop("hits").join(by_row, "row", "left")
    own = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>"))
    cut = F.transform("blocks", lambda b: b.withField("end", F.least(b["end"], F.col("n_words"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)))
        .alias("score"),
        F.coalesce(cut, F.array().cast("array<struct<first_word:long,end:long,label:string,containment:double>>")).alias("blocks"),
    )
