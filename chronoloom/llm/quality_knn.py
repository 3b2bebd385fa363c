r"""Quality classifier: labelled documents vote for their nearest neighbours in a latent-semantic space.

A text's terms are its words (hashed to ``WORDS`` buckets), its pairs of neighbouring characters by class (letters by kind, digits,
white space, every common symbol for itself), its length, the share of its words in repeated passages and of words said twice in a
row, in steps. Term weights are tf-idf; a truncated singular value decomposition of the labelled texts gives the latent space. Every document's vector is compared with all labelled vectors
by exact cosine products, block by block; the ``NEIGHBOURS`` nearest vote with their label, weighted by similarity, and
those as near as the last of them vote as well.

The model is fitted on a bounded sample, ``MAX_LABELLED`` labelled documents in the order of a hash of doc_id; its size (sample x
``RANK`` numbers) bounds what is broadcast. Scoring covers every document and its whole text.

Defined results: null and empty texts are scored by their (zero) length; several labels of one doc_id count as their mean, of
several texts of a labelled doc_id that of the smallest hash is learnt from; labels without doc_id or quality are left out; without any labels the score is 0.5; repeated rows are scored row by row; an empty table
gives no rows; other columns are carried unless they clash with the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoloom.llm.common import free_name
from chronoloom.llm.shingles import shingle_sets, text_chunks, word_hashes

MAX_LABELLED, RANK, NEIGHBOURS = 4096, 32, 25
SHARPNESS = 4
THRESHOLD = 0.3
RESULT = "score double, predicted int"

_SYMBOLS = "#*$%&|<>!.,;:?'\"()-_/=@"
_OTHER = 7
CLASSES = _OTHER + 1 + len(_SYMBOLS)
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[[ord(c) for c in "aeiou"]] = 0
_CLASS[[ord(c) for c in "bcdfghjklmnpqrstvwxyz"]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[128:] = 6
for _k, _c in enumerate(_SYMBOLS):
    _CLASS[ord(_c)] = _OTHER + 1 + _k

_LENGTHS = np.array([0, 1, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560, 5120, 10240])
_REPEATED = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75])
_DOUBLED = np.array([0.05, 0.1, 0.2, 0.4])
PAIRS, WORDS = CLASSES * CLASSES, 256
STEPS = PAIRS + WORDS
TERMS = STEPS + len(_LENGTHS) + len(_REPEATED) + len(_DOUBLED)
#: Rows that are compared with the labelled vectors at a time.
BLOCK = 256
#: How many times words and a step of length or repetition count, beside characters as a share of 100.
WORD_WEIGHT, LENGTH_WEIGHT, REPEATED_WEIGHT = 10.0, 1.0, 12.0


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x TERMS: character pairs and words as a percentage of the text, and the steps of length and repetition reached."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros((n, TERMS))
    if len(data):
        kind = _CLASS[data]
        pair = kind[:-1] * CLASSES + kind[1:] + np.repeat(np.arange(n), sizes)[:-1] * PAIRS
        inside = np.ones(len(data), bool)
        inside[offsets[1:][sizes > 0] - 1] = False
        found = np.bincount(pair[inside[:-1]], minlength=n * PAIRS).reshape(n, PAIRS)
        out[:, :PAIRS] = 100.0 * found / np.maximum(sizes - 1, 1)[:, None]
    hashes, at = word_hashes(data, offsets)
    words = np.diff(at)
    if len(hashes):
        bucket = (hashes % np.uint64(WORDS)).astype(np.int64) + np.repeat(np.arange(n), words) * WORDS
        out[:, PAIRS:STEPS] = WORD_WEIGHT * np.bincount(bucket, minlength=n * WORDS).reshape(n, WORDS) / np.maximum(words, 1)[:, None]
    as_before = np.concatenate([[0], np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]]))])[: len(hashes) + 1]
    doubled = (as_before[at[1:]] - as_before[np.minimum(at[:-1] + 1, at[1:])]) / np.maximum(words - 1, 1)
    distinct = np.diff(shingle_sets(data, offsets)[1])
    runs = np.maximum(words - 4, 0)
    repeated = np.where(runs > 0, (runs - distinct) / np.maximum(runs, 1), 0.0)
    out[:, STEPS : STEPS + len(_LENGTHS)] = LENGTH_WEIGHT * (words[:, None] <= _LENGTHS[None, :])
    out[:, STEPS + len(_LENGTHS) : -len(_DOUBLED)] = REPEATED_WEIGHT * (repeated[:, None] > _REPEATED[None, :])
    out[:, -len(_DOUBLED) :] = REPEATED_WEIGHT * (doubled[:, None] > _DOUBLED[None, :])
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  # TERMS
    axes: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # labelled x RANK, unit length
    labels: np.ndarray  # labelled

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts) * self.idf @ self.axes
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Votes for label 1; similarities of zero and less have no weight."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        weight = np.where(near >= last[:, None], np.maximum(near, 0.0) ** SHARPNESS, 0.0).astype(np.float64)
        total = weight.sum(axis=1)
        return np.where(total > 0, weight @ self.labels / np.maximum(total, 1e-300), 0.5)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    """A latent space from the labelled texts' term counts, which are weighted block by block: the driver holds one copy of them."""
    if not len(labels):
        return Model(np.zeros(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1), np.float32), labels)
    blocks = [slice(at, at + BLOCK) for at in range(0, len(counts), BLOCK)]
    idf = np.log((1.0 + len(counts)) / (1.0 + sum((counts[b] > 0).sum(axis=0) for b in blocks))) + 0.2
    gram = np.zeros((TERMS, TERMS))
    for b in blocks:
        x = np.sqrt(counts[b].astype(np.float64)) * idf
        gram += x.T @ x
    values, axes = np.linalg.eigh(gram)
    model = Model(idf, axes[:, np.argsort(-values, kind="stable")[:RANK]].copy(), np.zeros((0, RANK), np.float32), labels)
    return Model(idf, model.axes, np.concatenate([model.project(counts[b].astype(np.float64)) for b in blocks]), labels)


def in_training(doc_id: Column) -> Column:
    """The contract's training part: crc32 of doc_id as text modulo 5 is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """The model from at most ``max_labelled`` labelled documents of the training part."""
    marked = labels.where(in_training(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", F.struct(F.xxhash64("text").alias("hash"), "text").alias("own")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("own").alias("own"), F.first("label").alias("label")).select("doc_id", "own.text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text"), BLOCK):
                rows = term_counts(data, offsets).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * TERMS, pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), lists], names=["doc_id", "label", "counts"])

    rows = texts.mapInArrow(count, "doc_id long, label double, counts array<float>").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    labels = rows.column("label").to_numpy()[order]
    counts = rows.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, TERMS)[order]
    del rows
    return fit(counts, labels)


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents' other columns with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = StructType.fromDDL(RESULT)
    keep = [c for c in docs.columns if c != text_col and c not in result.names]
    schema = StructType([docs.schema[c] for c in keep] + result.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(text_col), BLOCK):
                score = shared.value.score(term_counts(data, offsets))
                columns = [batch.column(c).slice(lo, hi - lo) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=schema.names)

    return docs.select(*keep, text_col).mapInArrow(apply, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    return classify(docs.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "text"), model)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are predicted good, with their own columns."""
    named = {c: free_name(docs, f"_own_{c}") for c in ("score", "predicted") if c in docs.columns}
    text = free_name(docs, "_text")
    scored = classify(docs.withColumnsRenamed(named).withColumn(text, F.col("text")), model, text)
    return scored.where("predicted = 1").drop("score", "predicted").withColumnsRenamed({v: k for k, v in named.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])
