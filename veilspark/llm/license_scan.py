"""License scans: an exact set-similarity join of text blocks with license notices.

A notice matches a block when the block holds at least `threshold` of the notice's distinct words. Words
are ordered by how many documents hold them, rarest first. Of a notice with m words, of which o must be
shared, a matching block holds one of the m - o + 1 rarest (prefix filter), has at least o distinct words
(length filter), and the words of the notice from the first shared one on must still suffice
(positional filter). What passes is counted exactly. Notices share their common words, so a match gives its
label only if no match in the block that is as good shares all its words and more. The words that tell licenses apart must be
among the shared ones.

A block is a line. A line of more than two spans (a span: 64 words, at least twice the longest notice)
is cut into blocks of two spans that overlap by one, so a notice within a span's length is never cut.
Notices are wrapped anywhere, so the word sequence of the whole text is cut the same way. What matches in such a piece is a
block where it lies within a window of five quarters of the notice's length: a bag of words from several lines says little.
Base phrases are consecutive words anywhere in the text. Null texts are empty and have score 0. Repeated
documents are scanned each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import plain_words, utf8

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
THRESHOLD = 0.8
SPAN = 64
#: Words that a match shares if the notice has them: without its name a short notice is any license's.
NAMING = frozenset(b"mit apache lesser affero bsd mozilla cc commons".split())
#: (label, notice). Short forms as projects write them, and the opening sentences of the long forms.
NOTICES = (
    ("mit", "released under the MIT license"),
    ("mit", "licensed under the MIT license"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache", "licensed under the Apache license, version 2.0"),
    ("gpl", "licensed under the GNU general public license, version 3"),
    ("gpl", "licensed under the GNU general public license"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU general public license as published by the free software foundation"),
    ("lgpl", "licensed under the GNU lesser general public license"),
    ("agpl", "licensed under the GNU affero general public license"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "licensed under the BSD 3-clause license"),
    ("mpl", "subject to the terms of the Mozilla public license"),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc", "licensed under CC BY 4.0"),
    ("cc", "licensed under CC BY-SA 4.0"),
    ("cc", "licensed under CC BY-NC 4.0"),
    ("cc", "licensed under a Creative Commons Attribution license"),
)


def notice_word_counts(docs: DataFrame, notices: tuple[tuple[str, str], ...]) -> dict[bytes, int]:
    """In how many documents each word of the notices occurs: one count per word of a fixed set."""
    wanted = frozenset(w for _, text in notices for w in plain_words(text.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(wanted, 0)
        for batch in batches:
            for text in utf8(batch.column(0)):
                for word in wanted.intersection(plain_words(text)):
                    seen[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(wanted, 0) | {bytes(r["word"]): r["n"] for r in counts.collect()}


class NoticeIndex:
    """Notices as word lists in global order, and for each prefix word the notices and positions it stands at."""

    def __init__(self, notices: tuple[tuple[str, str], ...], counts: dict[bytes, int], threshold: float) -> None:
        self.notices: list[tuple[str, list[bytes], int]] = []
        self.names: list[frozenset[bytes]] = []
        self.lengths: list[int] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (label, text) in enumerate(notices):
            words = sorted(set(plain_words(text.encode())), key=lambda w: (counts[w], w))
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            self.notices.append((label, words, need))
            self.lengths.append(len(plain_words(text.encode())))
            self.names.append(NAMING.intersection(words))
            for position, word in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(word, []).append((k, position))

    def matches(self, block: set[bytes]) -> Iterator[tuple[str, float, frozenset[bytes]]]:
        """(label, containment, shared words) of every notice that `block` contains far enough."""
        for _, *match in self._matches(block):
            yield tuple(match)

    def _matches(self, block: set[bytes]) -> Iterator[tuple[int, str, float, frozenset[bytes]]]:
        first: dict[int, int] = {}
        for word in self.prefix.keys() & block:
            for k, position in self.prefix[word]:
                first[k] = min(position, first.get(k, position))
        for k, position in first.items():
            label, words, need = self.notices[k]
            if len(block) < need or len(words) - position < need:
                continue
            shared = block.intersection(words[position:])  # none before the first shared word
            if len(shared) >= need:
                yield k, label, len(shared) / len(words), frozenset(shared)

    def windows(self, piece: list[bytes]) -> Iterator[frozenset[bytes]]:
        """The windows of `piece` that hold most of a notice that matches it, if enough."""
        block = set(piece)
        for (_, listed, need), length in zip(self.notices, self.lengths, strict=True):
            wanted = block.intersection(listed)
            if len(wanted) < need:
                continue
            held = [frozenset(piece[at : at + length + length // 4 + 1]) for at, word in enumerate(piece) if word in wanted]
            most = max(len(wanted & window) for window in held)
            if most >= need:
                yield from {window for window in held if len(wanted & window) == most}

    def named(self, block: set[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of the matches with their names that no match as good explains, sharing all their words and more."""
        found = [(label, c, words) for k, label, c, words in self._matches(block) if self.names[k] <= words]
        return [(label, c) for label, c, words in found if not any(words < more and c <= best for _, best, more in found)]


def _pieces(words: list[bytes], span: int) -> Iterator[list[bytes]]:
    for at in range(0, max(1, len(words) - span), span):
        yield words[at : at + 2 * span]


def _blocks(index: NoticeIndex, text: bytes, words: list[bytes], span: int) -> Iterator[set[bytes]]:
    for line in text.split(b"\n"):
        yield from map(set, _pieces(plain_words(line), span))
    for piece in _pieces(words, span):
        yield from index.windows(piece)


def _phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> Iterator[tuple[int, str]]:
    for phrase, label in phrases:
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(phrase)] == phrase:
                yield at, label


def scan_licenses(
    docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of `docs` (doc_id, text).

    `score` is the largest containment of a matching notice; a base phrase is a notice held in whole, 1.
    """
    index = NoticeIndex(notices, notice_word_counts(docs, notices), threshold)
    base = [(p.encode().split(), label) for p, label in phrases.items()]
    span = max(SPAN, *(2 * len(plain_words(t.encode())) for _, t in notices))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = set(index.prefix)
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                words = plain_words(text)
                places = list(_phrase_places(words, base))
                starts = [at for at, _ in places]
                based = {label for _, label in places}
                found = [m for block in _blocks(index, text, words, span) for m in index.named(block)] if not rare.isdisjoint(words) else []
                labels = based | {label for label, _ in found}
                score = max([float(bool(based)), *(c for _, c in found)])
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(based)), ",".join(sorted(labels)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
