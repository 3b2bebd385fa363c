r"""License scans as an exact set-similarity join between blocks of text and license templates.

Texts are cut into blocks of ``BLOCK`` words, one every ``STRIDE`` words. A template with token set T matches a block with token
set B where ``|T & B| >= ceil(t |T|)``. All tokens are ordered by their frequency over all documents, rarest first; candidates
come from an index over the templates' prefixes and pass the prefix, length and positional filters before their overlap is
counted. Tokens that stand in no template can't add to an overlap and are left out of B. The templates are a short fixed table
(``MAX_TEMPLATE_TOKENS`` bounds what is sent to the tasks), so the join needs no shuffle of texts; a first pass counts the
template tokens, combined in each task before the shuffle.

Phrases of the base (``base=True``) are templates that a block must contain whole; the places where their words stand
consecutively are then read off the matching blocks. The score is the greatest containment found.

Defined results: a null, empty or wordless text has 0 words and no labels, score 0; repeated rows are scanned row by row; an
empty table gives no rows; other columns are carried unless they clash with the result's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, STRIDE = 64, 32
MAX_TEMPLATE_TOKENS = 100_000


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    containment: float = 0.8
    base: bool = False


# The phrases of the base, and notices from the texts of well-known licenses.
TEMPLATES = (
    Template("mit-phrase", "mit", "mit license", 1.0, True),
    Template("apache-phrase", "apache", "apache license", 1.0, True),
    Template("gpl-phrase", "gpl", "general public license", 1.0, True),
    Template("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("apache-notice", "apache", "you may not use this file except in compliance with the apache license you may obtain a copy of the license at http www apache org licenses"),
    Template("gpl-notice", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl-phrase", "lgpl", "gnu lesser general public license", 1.0),
    Template("agpl-phrase", "agpl", "gnu affero general public license", 1.0),
    Template("bsd-conditions", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-notice", "mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("isc-grant", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense-notice", "unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by-notice", "cc-by", "this work is licensed under a creative commons attribution international license"),
)

#: Lower-cases A-Z and turns every byte outside of words into a space; bytes of other code points stay.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<template:string,label:string,first_word:long,n_words:long,containment:double>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def _binary(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def token_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Occurrences of the vocabulary's words over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in _binary(batch, "text"):
                words = words_of(text)
                if not vocabulary.isdisjoint(words):
                    seen.update(filter(vocabulary.__contains__, words))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r.token): r.n for r in rows.collect()}  # at most one row for each template token


@dataclass(frozen=True)
class TemplateIndex:
    """The templates with their tokens in global order, and an inverted index over their prefixes."""

    templates: tuple[Template, ...]
    ordered: tuple[tuple[bytes, ...], ...]
    needed: tuple[int, ...]
    rank: dict[bytes, int]
    prefix: dict[bytes, list[tuple[int, int]]]

    @staticmethod
    def build(templates: tuple[Template, ...], counts: dict[bytes, int]) -> TemplateIndex:
        tokens = {w for t in templates for w in words_of(t.text.encode())}
        if len(tokens) > MAX_TEMPLATE_TOKENS:
            raise ValueError(f"templates have {len(tokens)} tokens; at most {MAX_TEMPLATE_TOKENS} are sent to the tasks")
        rank = {w: k for k, w in enumerate(sorted(tokens, key=lambda w: (counts.get(w, 0), w)))}
        ordered = tuple(tuple(sorted(set(words_of(t.text.encode())), key=rank.__getitem__)) for t in templates)
        needed = tuple(ceil(t.containment * len(o)) for t, o in zip(templates, ordered, strict=True))
        prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (o, need) in enumerate(zip(ordered, needed, strict=True)):
            for i in range(len(o) - need + 1):
                prefix.setdefault(o[i], []).append((k, i))
        return TemplateIndex(templates, ordered, needed, rank, prefix)

    def probe(self, block: list[bytes]) -> Iterator[tuple[int, int]]:
        """(template, overlap) of every template that the block contains to its threshold."""
        own = sorted({w for w in block if w in self.rank}, key=self.rank.__getitem__)
        tried: set[int] = set()
        for j, token in enumerate(own):
            for k, i in self.prefix.get(token, ()):
                need, size = self.needed[k], len(self.ordered[k])
                if k in tried or len(own) < need:  # length filter
                    continue
                tried.add(k)
                if 1 + min(size - i - 1, len(own) - j - 1) >= need:  # positional filter at the first common token
                    overlap = len(set(self.ordered[k]).intersection(own))
                    if overlap >= need:
                        yield k, overlap


def scan_words(words: list[bytes], index: TemplateIndex) -> tuple:
    """The result columns of one text."""
    places: list[int] = []
    base_labels, labels, matches = set(), set(), []
    if not index.prefix.keys().isdisjoint(words):
        hits = [i // STRIDE for i, w in enumerate(words) if w in index.prefix]
        for b in sorted({x for h in hits for x in (h, h - 1) if x >= 0}):
            block = words[b * STRIDE : b * STRIDE + BLOCK]
            for k, overlap in index.probe(block):
                t = index.templates[k]
                part = overlap / len(index.ordered[k])
                if not t.base:
                    labels.add(t.label)
                    matches.append((t.name, t.label, b * STRIDE, len(block), part))
                    continue
                phrase = t.text.encode().split()
                found = [b * STRIDE + p for p in range(min(STRIDE, len(block))) if block[p : p + len(phrase)] == phrase]
                if found:
                    places += found
                    base_labels.add(t.label)
                    matches += [(t.name, t.label, p, len(phrase), part) for p in found]
    score = max((m[4] for m in matches), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)), score, [dict(zip(("template", "label", "first_word", "n_words", "containment"), m, strict=True)) for m in matches]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> DataFrame:
    """The documents' other columns with counts, labels, score and the matching spans of each text."""
    from pyspark.sql.types import StructType

    tokens = {w for t in templates for w in words_of(t.text.encode())}
    index = TemplateIndex.build(templates, token_counts(docs, tokens, text_col))
    result = StructType.fromDDL(RESULT)
    keep = [c for c in docs.columns if c != text_col and c not in result.names]
    schema = StructType([docs.schema[c] for c in keep] + result.fields)
    match_type = pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match_type]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_words(words_of(x), index) for x in _binary(batch, text_col)]
            found = [pa.array([r[c] for r in rows], types[c]) for c in range(len(types))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + found, names=[*keep, *result.names])

    return docs.select(*keep, text_col).mapInArrow(apply, schema)


def _oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    sets = [sorted({w.decode() for w in words_of(t.text.encode())}) for t in templates]
    rows = ", ".join(f"({k}, '{t.label}', {len(s)}, {ceil(t.containment * len(s))}, {t.base}, {[w for w in t.text.split()]})" for k, (t, s) in enumerate(zip(templates, sets, strict=True)))
    return rf"""
WITH t(k, label, size, need, base, phrase) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
b AS (SELECT r, word, i, i // {STRIDE} AS b FROM x UNION ALL SELECT r, word, i, i // {STRIDE} - 1 FROM x WHERE i >= {STRIDE}),
o AS (SELECT r, b, k, count(DISTINCT word) AS n FROM b JOIN (SELECT DISTINCT k, unnest(phrase) AS word FROM t) USING (word) GROUP BY r, b, k),
m AS (SELECT r, label, n / size AS part FROM o JOIN t USING (k) WHERE NOT base AND n >= need),
p AS (SELECT d.r, label, i, 1.0::DOUBLE AS part FROM x JOIN t ON base AND word = phrase[1] JOIN d ON d.r = x.r AND d.w[i + 1:i + len(phrase)] = phrase),
a AS (SELECT r, label, part, i FROM p UNION ALL SELECT r, label, part, NULL FROM m),
g AS (SELECT r, count(i) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (i IS NOT NULL) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al, max(part) AS score FROM a GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""


ORACLE_SQL = _oracle()
