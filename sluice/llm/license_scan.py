"""License scan: an exact set-similarity join of text blocks with templates.

Blocks are windows of a text's words: a template of m words is sought in windows
of ``L`` words, the power of two that is 2m at least, every ``L / 4`` words. A
block meets a template when it holds at least ``threshold`` of the template's
tokens, where a token is a word with its occurrence number.

1. One scan counts the templates' words in the whole corpus. Rarest first, this
   is the global order of tokens.
2. A second scan finds the blocks. Prefix filter: a block that meets a template
   of t tokens, ``need`` of them, holds one of the template's first
   ``t - need + 1``; only blocks around those words are looked at. Length filter:
   a block has ``need`` words at least. Positional filter: in the global order,
   a block is given up as soon as the tokens left cannot make up ``need``.

The templates are the operator's argument; they and their counts are all that is
broadcast. Nothing of the documents shuffles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import byte_words, read_table

KEY = "op6_license_scan"

#: Phrases that give a label wherever their words stand consecutively.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Opening words of public licenses and of their usual notices, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


class Template:
    def __init__(self, label: str, text: str, threshold: float, counts: dict[bytes, int]):
        words = byte_words(text.encode())
        self.label, self.n = label, len(words)
        self.need = max(1, math.ceil(threshold * self.n - 1e-9))
        self.order = sorted(Counter(words).items(), key=lambda x: (counts.get(x[0], 0), x[0]))  # (word, times), rarest first
        self.block = 1 << max(3, (2 * self.n - 1).bit_length())
        left, self.prefix = self.n - self.need + 1, set()
        for w, times in self.order:
            if left > 0:
                self.prefix.add(w)
            left -= times

    def overlap(self, block: list[bytes]) -> int:
        """Tokens that the block shares with the template; 0 if they are fewer than needed."""
        if len(block) < self.need:
            return 0
        has, left, met = Counter(block), self.n, 0
        for w, times in self.order:
            met += min(times, has.get(w, 0))
            left -= times
            if met + left < self.need:
                return 0
        return met

    def blocks(self, words: list[bytes], at: list[int]) -> Iterator[tuple[int, int, int]]:
        """(first word, word behind the last, shared tokens) of the blocks that meet the template."""
        step, done = self.block // 4, -1
        for p in at:
            for k in range(max(done + 1, (p - self.block) // step + 1, 0), p // step + 1):
                done = k
                if met := self.overlap(words[k * step:k * step + self.block]):
                    yield k * step, min(k * step + self.block, len(words)), met


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], threshold: float, counts: dict[bytes, int]):
        self.templates = [Template(label, text, threshold, counts) for label, text in templates if byte_words(text.encode())]
        self.phrases = [(byte_words(p.encode()), label) for p, label in phrases]
        self.anchors = set().union(*[t.prefix for t in self.templates])

    def places(self, words: list[bytes], joined: bytes) -> list[tuple[int, str]]:
        """(word number, label) where a phrase's words stand consecutively."""
        found = []
        for phrase, label in self.phrases:
            want, at = b" " + b" ".join(phrase) + b" ", -1
            while (at := joined.find(want, at + 1)) >= 0:
                found.append((joined.count(b" ", 0, at), label))
        return found

    def scan(self, text: bytes | None) -> dict:
        words = byte_words(text)
        base = self.places(words, b" " + b" ".join(words) + b" ")
        anchors: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.anchors:
                anchors.setdefault(w, []).append(i)
        blocks = []
        for t in self.templates if anchors else ():
            at = sorted(p for w in t.prefix for p in anchors.get(w, ()))
            blocks += [{"label": t.label, "first": a, "last": b, "containment": met / t.n} for a, b, met in t.blocks(words, at)]
        starts, own = [p for p, _ in base], {x for _, x in base}
        return {"n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {b["label"] for b in blocks})),
                "score": 1.0 if base else max((b["containment"] for b in blocks), default=0.0), "blocks": blocks}


BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))
FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
          "labels": pa.string(), "score": pa.float64(), "blocks": BLOCKS}
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "blocks array<struct<label:string,first:bigint,last:bigint,containment:double>>")


def count_tokens(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            n.update(filter(vocabulary.__contains__, byte_words(t)))
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])


def scan_batches(batches: Iterator[pa.RecordBatch], scanner) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scanner.value.scan(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], kind) for k, kind in FIELDS.items()]], ["doc_id", *FIELDS])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
                 phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.9) -> DataFrame:
    """Labels of every row: phrases, and the blocks that meet a template.

    Returns ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, blocks)``; ``blocks`` are ``(label, first, last, containment)`` over word
    numbers. ``score`` is 1 with a phrase, else the best containment of a block that
    meets a template, else 0.

    Defined cases: a null or empty text has no words, no places, empty labels and
    score 0. Null ids and repeated rows are kept, texts are scanned whole. Other
    columns are ignored, an empty table gives no rows; without templates only the
    phrases give labels.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    vocabulary = frozenset(w for _, t in templates for w in byte_words(t.encode()))
    counted = base.select("text").mapInArrow(lambda it: count_tokens(it, vocabulary), "word binary, n long")
    counts = {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()} if vocabulary else {}
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates, phrases, threshold, counts))
    return base.mapInArrow(lambda it: scan_batches(it, scanner), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents")).drop("blocks")


ORACLE = None
