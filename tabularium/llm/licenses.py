"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are pairs of neighbouring words. A block (a line, a paragraph of several lines, or
a window of either) matches a template if it holds at least ``THRESHOLD`` of the
template's distinct tokens, and all tokens of the phrase that names the license: the
notices of different licenses differ in little else. The join is exact and filtered:

* Tokens are ordered by how many documents of the corpus hold them, rarest first. Only
  tokens of templates can add to an overlap, so these are counted, over all documents.
* Prefix filter: a template of n tokens that needs c of them is met only by blocks that
  hold one of its n - c + 1 rarest tokens.
* Length filter: a block with fewer than c template tokens is no candidate.
* Positional filter: from the places of the first common token in both orders, the
  largest possible overlap follows; below c the pair is dropped.

What is left is verified. Templates are a fixed list of known size, so their index
travels with the tasks; documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import trimmed, utf8

THRESHOLD = 0.8
#: Phrases whose places are the base scan, and their labels. Fixed values.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: (label, template, naming phrase): notices by which the licenses ask to be named or by which
#: they begin, at most ``WINDOW`` // 2 words long. Fixed values.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ""),
    ("bsd", "released under the bsd license", "bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("mpl-2", "licensed under the mozilla public license version 2 0", "mozilla public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
#: Words of a window; a longer block is cut into windows of which each begins in the middle of the last.
WINDOW = 120
Token = tuple[bytes, bytes]
#: Bytes of words stay (A-Z in lower case), line feeds stay, all others become blanks.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or b == 10 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Index:
    """Templates in the global order, and by prefix token."""

    rank: dict[Token, int]
    labels: list[str]
    tokens: list[list[int]]
    naming: list[frozenset[int]]
    needed: list[int]
    by_prefix: dict[int, list[tuple[int, int]]]
    prefix_tokens: frozenset[Token]


def tokens_of(words: list[bytes]) -> set[Token]:
    """The distinct pairs of neighbouring words."""
    return set(zip(words, words[1:], strict=False))


def _of(text: str) -> set[Token]:
    return tokens_of(text.encode().translate(WORDS).split())


def vocabulary(templates=TEMPLATES) -> set[Token]:
    return {x for _, text, _ in templates for x in _of(text)}


def build_index(frequency: dict[Token, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> Index:
    """The templates' index under a global order, rarest token first, ties by the token.

    Raises where a template is too long for the windows or lacks its naming phrase.
    """
    for label, text, naming in templates:
        if not 2 <= len(text.split()) <= WINDOW // 2 or not _of(naming) <= _of(text):
            raise ValueError(f"template of {label}: {text}")
    order = sorted(vocabulary(templates), key=lambda w: (frequency.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    tokens = [sorted(rank[w] for w in _of(text)) for _, text, _ in templates]
    needed = [max(1, math.ceil(threshold * len(t) - 1e-9)) for t in tokens]
    by_prefix: dict[int, list[tuple[int, int]]] = {}
    for k, (t, c) in enumerate(zip(tokens, needed, strict=True)):
        for at, x in enumerate(t[: len(t) - c + 1]):
            by_prefix.setdefault(x, []).append((k, at))
    naming = [frozenset(rank[w] for w in _of(phrase)) for _, _, phrase in templates]
    return Index(rank, [label for label, _, _ in templates], tokens, naming, needed, by_prefix, frozenset(order[x] for x in by_prefix))


def matches(words: list[bytes], ix: Index) -> dict[int, float]:
    """Containment of every template that a block of these words meets."""
    block = sorted(ix.rank[w] for w in tokens_of(words) if w in ix.rank)
    seen: dict[int, bool] = {}
    for place, x in enumerate(block):
        for k, at in ix.by_prefix.get(x, ()):
            if k not in seen:
                c = ix.needed[k]
                possible = 1 + min(len(ix.tokens[k]) - at - 1, len(block) - place - 1)
                seen[k] = len(block) >= c and possible >= c
    held = set(block)
    out = {}
    for k, candidate in seen.items():
        if candidate and ix.naming[k] <= held and (n := len(held.intersection(ix.tokens[k]))) >= ix.needed[k]:
            out[k] = n / len(ix.tokens[k])
    return out


def windows(at: int, words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """A block, or its windows; every run of at most WINDOW // 2 words lies in one."""
    if len(words) <= WINDOW:
        yield at, words
        return
    for lo in range(0, len(words) - WINDOW // 2, WINDOW // 2):
        yield at + lo, words[lo : lo + WINDOW]


def blocks(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(first word's place, words) of the windows of each line with words, and of each paragraph of several such lines."""
    at, para, start, lines = 0, [], 0, 0
    for line in [*text.split(b"\n"), b""]:
        words = line.split()
        if words:
            yield from windows(at, words)
            if not lines:
                start = at
            para += words
            lines += 1
            at += len(words)
        else:
            if lines > 1:
                yield from windows(start, para)
            para, lines = [], 0


_PHRASES = {p.encode(): label for p, label in PHRASES.items()}
_LAST = tuple({p.split()[-1] for p in _PHRASES})
_PLACES = {p: re.compile(rb"(?<= )(?=%s )" % re.escape(p)) for p in _PHRASES}


def base_scan(plain: bytes, words: list[bytes]) -> tuple[list[int], set[str]]:
    """Starts of all places of the phrases, and the labels of those that occur."""
    if not any(w in plain for w in _LAST):
        return [], set()
    joined = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for p, find in _PLACES.items():
        at = word = 0
        for m in find.finditer(joined):
            word += joined.count(b" ", at, m.start())
            at = m.start()
            starts.append(word - 1)
            labels.add(_PHRASES[p])
    return starts, labels


def global_order(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[Token, int]:
    """In how many documents each template token occurs. One row a token and task is shuffled."""
    known = frozenset(vocabulary(templates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[Token] = Counter()
        for b in batches:
            for t in utf8(b, "text"):
                words = (t or b"").translate(WORDS).split()
                n.update(known.intersection(zip(words, words[1:], strict=False)))
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(x) for x in n], pa.binary()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(trimmed(count), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # At most one row a token of the templates.
    return {tuple(bytes(r.token).split(b" ")): r.n for r in rows.collect()}


def license_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every match: id, label, template (its number), first_word, n_words of the block, containment.

    Null and empty texts have none. Null ids and repeated rows give their matches; other
    columns are ignored; an empty table gives no rows. A line and the paragraph it is in,
    or two windows, may both match.
    """
    ix = build_index(global_order(docs, text_col, templates), templates, threshold)
    cols = "label string, template int, first_word long, n_words long, containment double"
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(cols).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, t in enumerate(utf8(b, "__text")):
                plain = (t or b"").translate(WORDS)
                words = plain.split()
                if ix.prefix_tokens.isdisjoint(zip(words, words[1:], strict=False)):
                    continue
                for at, words in blocks(plain):
                    for k, c in matches(words, ix).items():
                        rows.append(i)
                        out.append((ix.labels[k], k, at, len(words), c))
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *cols], names=schema.names)

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(trimmed(run), schema)


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest containment of a matching block, 1 where a phrase stands,
    0 without either. Null texts count as empty. Null ids and repeated rows keep their
    rows; other columns are ignored; an empty table gives no rows.
    """
    ix = build_index(global_order(docs, text_col, templates), templates, threshold)
    cols = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(cols).fields])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def row(text: bytes) -> tuple:
        plain = text.translate(WORDS)
        words = plain.split()
        starts, base = base_scan(plain, words)
        found: dict[str, float] = dict.fromkeys(base, 1.0)
        if not ix.prefix_tokens.isdisjoint(zip(words, words[1:], strict=False)):
            for _, part in blocks(plain):
                for k, c in matches(part, ix).items():
                    found[ix.labels[k]] = max(c, found.get(ix.labels[k], 0.0))
        ends = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(found)), max(found.values(), default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(t or b"") for t in utf8(b, "__text")]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(trimmed(run), schema)
