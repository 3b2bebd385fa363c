r"""Language identification by unigrams of pieces, marginalised over all segmentations.

Every language has probabilities over the pieces of a fixed public vocabulary. The probability of a text is the sum over all its
segmentations into pieces of the product of their probabilities, by the forward algorithm over the matches of an Aho-Corasick
automaton; as no piece reaches across units, it is the product over units, and units seen before come from a bounded cache. A
character that no piece covers has the probability ``UNKNOWN`` in every language. Languages are equally likely beforehand.

Probabilities are learnt by expectation maximisation from texts with a language. ``train`` takes about ``docs_per_language`` documents
of each language, chosen by a hash of doc_id and text (a documented bound), counts units on Spark, and sums expected piece counts
over all segmentations in each round. What the driver holds is one table of pieces x languages; more than ``MAX_LANGUAGES``
languages are an error, none is left out.

Defined results: a null text or one without letters gives ``und`` with score 0; ties go to the first language by name; repeated
rows are scored row by row; an empty table gives no rows, and without training rows every text is ``und``; other columns are
carried unless they clash with the result's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoloom.llm.common import with_checkpoint_dir
from chronoloom.llm.pieces import DEFAULT_MODEL, Vocabulary, load_vocabulary

DOCS_PER_LANGUAGE, MAX_LANGUAGES = 300, 200
ROUNDS, SMOOTHING, UNKNOWN = 2, 0.05, 1e-7
CACHE = 200_000
UNDETERMINED = "und"
RESULT = "lang_pred string, score double"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    probabilities: np.ndarray  # pieces x languages


class Lattices:
    """The matches of a number of units, as arrays that all units' positions are computed over at once."""

    def __init__(self, vocabulary: Vocabulary, units: list[str]) -> None:
        lengths = np.array([len(u) for u in units])
        self.base = np.concatenate([[0], np.cumsum(lengths + 1)])  # node of each unit's start; a unit has len + 1 nodes
        ends, sizes, ids, owner = [], [], [], []
        for k, u in enumerate(units):
            found = list(vocabulary.automaton.iter(u))
            ends += [e for e, _ in found]
            sizes += [m[0] for _, m in found]
            ids += [m[2] for _, m in found]
            owner.append(len(found))
        end = np.array(ends, np.int64) + 1
        start = end - np.array(sizes, np.int64)
        unit = np.repeat(np.arange(len(units)), owner)
        covered = np.zeros(self.base[-1], bool)
        covered[self.base[unit[end - start == 1]] + end[end - start == 1]] = True
        covered[self.base[:-1]] = True
        bare = np.flatnonzero(~covered)  # characters without a piece of their own
        bare_unit = np.searchsorted(self.base, bare, "right") - 1
        self.piece = np.concatenate([np.array(ids, np.int64), np.full(len(bare), -1)])
        self.end = np.concatenate([end + self.base[unit], bare])
        self.start = np.concatenate([start + self.base[unit], bare - 1])
        self.unit = np.concatenate([unit, bare_unit])
        depth = self.end - self.base[self.unit]
        order = np.argsort(depth, kind="stable")
        self.piece, self.end, self.start, self.unit = self.piece[order], self.end[order], self.start[order], self.unit[order]
        self.steps = np.searchsorted(depth[order], np.arange(1, (lengths.max() if len(units) else 0) + 2))
        self.last = self.base[1:] - 1

    def _weights(self, probabilities: np.ndarray) -> np.ndarray:
        return np.where((self.piece >= 0)[:, None], probabilities[self.piece], UNKNOWN)

    def forward(self, probabilities: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled sums over all ways to each node, the nodes' log scales, and the matches' weights."""
        w = self._weights(probabilities)
        alpha = np.zeros((self.base[-1], w.shape[1]))
        scale = np.zeros(self.base[-1])
        alpha[self.base[:-1]] = 1.0
        for lo, hi in zip(self.steps[:-1], self.steps[1:], strict=True):
            if lo == hi:
                continue
            end, start = self.end[lo:hi], self.start[lo:hi]
            nodes, place = np.unique(end, return_inverse=True)
            scale[nodes] = scale[nodes - 1]  # the node before is the common reference
            part = alpha[start] * w[lo:hi] * np.exp(scale[start] - scale[end])[:, None]
            total = np.zeros((len(nodes), w.shape[1]))
            np.add.at(total, place, part)
            top = total.max(axis=1)
            alpha[nodes] = total / top[:, None]
            scale[nodes] += np.log(top)
        return alpha, scale, w

    def log_likelihoods(self, probabilities: np.ndarray) -> np.ndarray:
        alpha, scale, _ = self.forward(probabilities)
        return np.log(np.maximum(alpha[self.last], 1e-300)) + scale[self.last][:, None]

    def expected(self, probabilities: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations; ``counts`` are units x languages."""
        alpha, scale, w = self.forward(probabilities)
        beta, back = np.zeros_like(alpha), np.zeros(len(scale))
        beta[self.last] = 1.0
        for lo, hi in zip(self.steps[-2::-1], self.steps[:0:-1], strict=True):
            # all ways on from a node end later, so going back by ends settles every node before it is used
            if lo < hi:
                end, start = self.end[lo:hi], self.start[lo:hi]
                known = beta[end].max(axis=1) > 0
                part = beta[end] * w[lo:hi] * np.exp(back[end] - scale[end] + scale[start])[:, None] * known[:, None]
                np.add.at(beta, start, part)
        z = np.maximum(alpha[self.last] * beta[self.last], 1e-300)
        share = alpha[self.start] * w * beta[self.end] * np.exp(scale[self.start] - scale[self.end])[:, None] / z[self.unit] * counts[self.unit]
        real = self.piece >= 0
        out = np.zeros_like(probabilities)
        np.add.at(out, self.piece[real], share[real])
        return out


def _parts(items: list[str], characters: int = 200_000) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(items):
        stop, size = at, 0
        while stop < len(items) and (stop == at or size + len(items[stop]) <= characters):
            size += len(items[stop])
            stop += 1
        yield at, stop
        at = stop


def in_training(doc_id: Column) -> Column:
    """The contract's training part: crc32 of doc_id as text modulo 4 is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def training_sample(docs: DataFrame, languages: dict[str, int], docs_per_language: int) -> DataFrame:
    """About so many documents of each language: those whose hash lies below the language's share. Every task chooses from its own
    rows, so the sample stays spread."""
    share = F.create_map(*[x for k, n in languages.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))])
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    return docs.where(place < F.try_element_at(share, F.col("lang")))


def smoothed(counts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Probabilities of pieces (rows) in languages from their counts. Of the pieces with ``letters`` a language has ``1 - SMOOTHING`` of its
    own, the rest is one background for all languages (the mean of their own, ``SMOOTHING`` of it uniform); pieces without a letter and the
    share of pieces with one are the same in all. What no language has is thus as likely in each, however little text a language has."""
    own = lambda c: c / np.maximum(c.sum(axis=0), 1e-300)
    common = lambda c: ((1 - SMOOTHING) * own(c).mean(axis=1) + SMOOTHING / max(len(c), 1))[:, None]
    share = own(np.stack([counts[letters].sum(axis=0), counts[~letters].sum(axis=0)])).mean(axis=1).clip(SMOOTHING, 1 - SMOOTHING)
    out = np.zeros_like(counts)
    out[letters] = share[0] * ((1 - SMOOTHING) * own(counts[letters]) + SMOOTHING * common(counts[letters]))
    out[~letters] = share[1] * common(counts[~letters])
    return out / out.sum(axis=0)


def train(docs: DataFrame, model_file: str = DEFAULT_MODEL, docs_per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from ``docs`` (text, lang, doc_id); rows without text or lang are left out."""
    spark = with_checkpoint_dir(docs.sparkSession)
    docs = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counted = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    vocabulary = load_vocabulary(model_file)
    size = len(vocabulary.pieces)
    letters = np.array([bool(_LETTER.search(p)) for p in vocabulary.pieces])
    names = tuple(sorted(counted))
    if not names:
        return Model((), np.zeros((size, 0)))
    shared = spark.sparkContext.broadcast(vocabulary)

    def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = shared_vocabulary(shared.value), Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.update((lang, u) for u in vocab.split(text))
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in seen], "unit": [k[1] for k in seen], "n": list(seen.values())}, pa.schema([("lang", pa.string()), ("unit", pa.string()), ("n", pa.int64())]))

    sample = training_sample(docs.select("doc_id", "lang", "text"), counted, docs_per_language)
    units = sample.mapInArrow(count_units, "lang string, unit string, n long").groupBy("unit").pivot("lang", list(names)).agg(F.sum("n")).fillna(0).checkpoint()
    model = np.full((size, len(names)), 1.0 / size)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, total = shared_vocabulary(shared.value), np.zeros_like(now.value)  # noqa: B023
            for batch in batches:
                words = batch.column("unit").to_pylist()
                counts = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(names))], 1).astype(float)
                for lo, hi in _parts(words):
                    total += Lattices(vocab, words[lo:hi]).expected(now.value, counts[lo:hi])  # noqa: B023
            used = np.flatnonzero(total.sum(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * len(names), pa.int32()), pa.array(total[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used), lists], names=["piece", "n"])

        sums = units.mapInArrow(expect, "piece long, n array<double>").groupBy("piece").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(len(names))])
        total = np.zeros_like(model)
        for row in sums.collect():  # one row for each piece of the vocabulary at most
            total[row[0]] = row[1:]
        model = smoothed(total, letters)
    return Model(names, model)


_VOCABULARIES: dict[bytes, Vocabulary] = {}


def shared_vocabulary(vocabulary: Vocabulary) -> Vocabulary:
    """One automaton for each vocabulary and worker."""
    return _VOCABULARIES.setdefault(vocabulary.digest, vocabulary)


class Scorer(dict):
    """Log likelihoods of units: a mapping from a unit to its row of ``table``; new units are computed many at a time."""

    def __init__(self, vocabulary: Vocabulary, model: Model) -> None:
        super().__init__()
        self.vocabulary, self.model = vocabulary, model
        self.table = np.zeros((0, len(model.languages)))
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = row = len(self)
        self.fresh.append(unit)
        return row

    def settle(self) -> None:
        if self.fresh:
            new = [Lattices(self.vocabulary, self.fresh[lo:hi]).log_likelihoods(self.model.probabilities) for lo, hi in _parts(self.fresh)]
            self.table = np.concatenate([self.table, *new])
            self.fresh = []

    def score(self, texts: list[str]) -> np.ndarray:
        """Log likelihoods, texts x languages."""
        if len(self) > CACHE:
            self.clear()
            self.table = self.table[:0]
        rows = [np.fromiter(map(self.__getitem__, self.vocabulary.split(t)), np.int64) for t in texts]
        self.settle()
        return np.stack([self.table[r].sum(axis=0) for r in rows]) if rows else np.zeros((0, self.table.shape[1]))


def identify(docs: DataFrame, model: Model, model_file: str = DEFAULT_MODEL, text_col: str = "text") -> DataFrame:
    """The documents' other columns with ``lang_pred`` and ``score``, the language's posterior probability."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((load_vocabulary(model_file), model))
    result = StructType.fromDDL(RESULT)
    keep = [c for c in docs.columns if c != text_col and c not in result.names]
    schema = StructType([docs.schema[c] for c in keep] + result.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, learnt = shared.value
        scorer = Scorer(shared_vocabulary(vocabulary), learnt)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(text_col).to_pylist()
                some = [k for k, t in enumerate(texts) if t and learnt.languages and _LETTER.search(t)]
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if some:
                    ll = scorer.score([texts[k] for k in some])
                    best = ll.argmax(axis=1)
                    p = 1.0 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
                    for k, b, s in zip(some, best.tolist(), p.tolist(), strict=True):
                        lang[k], score[k] = learnt.languages[b], s
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*keep, text_col).mapInArrow(apply, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learnt from the training part alone."""
    model = train(docs.where(in_training(F.col("doc_id"))))
    return identify(docs.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "text"), model)
