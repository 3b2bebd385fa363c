r"""Ranked lexical search: the documents of the highest scores for every item, as a blocked sparse matrix product.

The left matrix has a row for each item and a column for each term: how often the item counts the term (``once``: 0 or 1). The
right one has a row for each term and a column for each document: the term's impact in it, ``w * ((1000000000 * tf) div (1000 * tf
+ 8 * m))`` in 64-bit integers, with the term's weight ``w`` = floor(1000 * ln((2N + 2) / (2 df + 1))) and the document's ``m`` = 10 + ((90 *
n * N) div L). Documents are read in blocks; a block's part of the right matrix is kept by terms, and an item's row of the product is the merge
of its terms' rows (Gustavson's order) in one accumulator of the block's width. A task keeps the best ``k`` of every item over its
blocks; two grouped ranks, first by shares of the tasks and then by item, reduce these to the result, so that no task sees all of an item's rows.

Terms are the maximal matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` in the whole text, only A-Z lower-cased. N counts the documents
with a term, L all their terms, n one document's terms, df the documents that hold a term, all over the whole table. Texts are
read once: what they hold of the items' terms is written to the checkpoint folder, and counts and product read that.

The items' terms are collected and broadcast in blocks of at most ``TERM_LIMIT`` entries (items dealt by a hash of their id, so a block's size
varies a little, and a single item's terms stay together); further blocks read the documents again.

Defined results: null and wordless texts hold no term and are not counted in N; an item's terms are those of all rows with its
item_id, a null item_id is one item, items without terms or matches have no rows; repeated rows of documents are
documents of their own and may share a doc_id; equal scores go by doc_id, null last; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import written

BEST = 10
TERM_LIMIT = 2_000_000
#: Rows of a block of the right matrix, and shares in which the tasks' results are reduced first.
BLOCK_ROWS, SHARES = 2_048, 256
_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Separators become spaces and A-Z lower case; bytes from 0x80 on are those of longer characters, which belong to terms.
_TABLE = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text's UTF-8 in order."""
    return (text or b"").translate(_TABLE).split()


def _item_rows(items: DataFrame, blocks: int, block: int, once: bool) -> tuple[list, list[Counter]]:
    """Ids and counted terms of the items of a block."""
    mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
    found: dict[int | None, Counter] = {}
    for row in mine.toLocalIterator():
        found.setdefault(row.item_id, Counter()).update(terms_of((row.text or "").encode()))
    if once:
        found = {i: Counter(dict.fromkeys(c, 1)) for i, c in found.items()}
    found = {i: c for i, c in found.items() if c}
    return list(found), list(found.values())


def _held(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of every document with a term: doc_id, its number of terms, and the vocabulary's terms in it with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ns, ids, tfs, ends = [], [], [], [0]
                for raw in batch.column(1).cast(pa.large_binary()).to_pylist():
                    words = terms_of(raw)
                    counts = Counter(map(known.get, words))
                    counts.pop(None, None)
                    ns.append(len(words))
                    ids += counts.keys()
                    tfs += counts.values()
                    ends.append(len(ids))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (ids, tfs)]
                out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(np.array(ns) > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, "doc_id long, n long, terms array<int>, tfs array<int>")


class _Best:
    """The best ``k`` (score, doc_id) of one item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.docs, self.has_id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, has_id: np.ndarray) -> None:
        scores, docs, has_id = (np.concatenate(x) for x in ((self.scores, scores), (self.docs, docs), (self.has_id, has_id)))
        order = np.lexsort((docs, ~has_id, -scores))[: self.k]
        self.scores, self.docs, self.has_id = scores[order], docs[order], has_id[order]

    def least(self) -> int:
        """What a score must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1


def block_impacts(n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, docs: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block of the right matrix by terms: where each term's row begins, the columns and the impacts of the rows."""
    m = np.array([10 + (90 * int(x) * docs) // total for x in n], np.int64)
    column = np.repeat(np.arange(len(n)), lengths)
    tf = tfs.astype(np.int64)
    impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[column]))
    order = np.argsort(terms, kind="stable")
    begins = np.searchsorted(terms[order], np.arange(len(weights) + 1))
    return begins, column[order], impact[order]


def _product(held: DataFrame, ids: list, rows: list[list[tuple[int, int]]], weights: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """The best of each task: share, item_id, doc_id, score."""
    shared = held.sparkSession.sparkContext.broadcast((ids, [(np.array([t for t, _ in r]), [c for _, c in r]) for r in rows], weights))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, weights = shared.value
        best = [_Best(k) for _ in ids]
        share = 0
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                has_id = np.asarray(batch.column(0).is_valid())
                doc = batch.column(0).fill_null(0).to_numpy()
                terms, tfs = batch.column(2), batch.column(3)
                lengths = np.diff(terms.offsets.to_numpy())
                share = (share * 31 + int(doc[0])) % SHARES
                begins, columns, impacts = block_impacts(batch.column(1).to_numpy(), lengths, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), weights, docs, total)
                for b, (own, counts) in zip(best, rows, strict=True):
                    row = np.zeros(len(doc), np.int64)
                    for t, count in zip(own, counts, strict=True):
                        lo, hi = begins[t], begins[t + 1]
                        row[columns[lo:hi]] += count * impacts[lo:hi]  # a term stands once in a column
                    at_least = np.flatnonzero(row >= b.least())
                    if len(at_least):
                        b.add(row[at_least], doc[at_least], has_id[at_least])
        for item, b in zip(ids, best, strict=True):
            if len(b.scores):
                size = len(b.scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([share] * size, pa.int32()), pa.array([item] * size, pa.int64()), pa.array(b.docs, pa.int64(), mask=~b.has_id), pa.array(b.scores)], names=["share", "item_id", "doc_id", "score"]
                )

    return held.mapInArrow(apply, "share int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, once: bool = True) -> DataFrame:
    """The ``k`` documents of the highest scores above 0 of each item: item_id, rank, doc_id, score.

    ``once``: a term counts once for an item, however often it says it; else its occurrences are the left matrix' entries."""
    items = items.select(F.col("item_id").cast("long"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (2 * TERM_LIMIT)))  # a term and what parts it from the next take two characters at least
    found = []
    for block in range(blocks):
        ids, counted = _item_rows(items, blocks, block, once)
        vocabulary = {t: i for i, t in enumerate(sorted({t for c in counted for t in c}))}
        held = written(_held(docs, vocabulary), "held")
        docs_n, total = held.agg(F.count("*"), F.sum("n")).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
            weights[term] = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df + 1)))
        rows = [sorted((vocabulary[t], c) for t, c in counts.items()) for counts in counted]
        found.append(_product(held, ids, rows, weights, docs_n, total or 1, k))
    highest = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*highest))).where(F.col("rank") <= k)
    first = ranked(reduce(DataFrame.unionByName, found), "share", "item_id").drop("rank")
    return ranked(first, "item_id").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM w GROUP BY 1, 2),
d AS (SELECT doc_id, count(*)::BIGINT AS n FROM w GROUP BY 1),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, docs),
p AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * docs) // total)))))::BIGINT AS score
      FROM i JOIN t USING (term) JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
