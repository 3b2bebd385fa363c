r"""SentencePiece encoding and decoding: the best segmentation into the pieces of a fixed vocabulary.

An Aho-Corasick automaton over the pieces runs once over the text; at every position it follows the output links through all
pieces that end there, longest first, and relaxes the best score of a segmentation that ends at this position (the first
of equal scores stays). Piece scores are those of the vocabulary; a character that no piece covers costs ``min score - 10`` and
becomes its bytes. Where the scores are an order of merges, a piece may only follow one that ``Vocabulary.admissible`` lets stand
before it; one segmentation of every prefix is left then, so that the ids are those of the merges, the model's own. As no piece
reaches across the units of ``Vocabulary.units``, the best segmentation of a text is that of its units in a row; units seen before
come from a bounded cache. A dummy space stands in front of every text. ``score`` is the Viterbi score, unknown characters included.

Decoding joins the pieces' bytes and takes the dummy space away; it gives back every text, whatever it contains: spaces, line
ends, marks of the vocabulary, characters without a piece.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are encoded row by row; an empty
table gives no rows; other columns are carried unless they clash with the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from chronoloom.llm.pieces import DEFAULT_MODEL, SPACE, Vocabulary, load_vocabulary

#: Units that are remembered, and the length up to which they are.
CACHE, REMEMBERED = 100_000, 64
RESULT = "n_tokens long, n_bytes_tokens long, score double, round_trip boolean, ids array<int>"


class Codec(dict):
    """Encodes units (as a mapping from a unit to its ids' bytes) and texts, and decodes ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}
        self.unknown = min(vocabulary.scores[vocabulary.first :]) - 10.0
        self.scores = np.array(vocabulary.scores)
        self.scores[: vocabulary.first] = 0.0
        for b in range(256):  # a character's first byte bears its cost
            self.scores[vocabulary.bytes_from + b] = 0.0 if 0x80 <= b < 0xC0 else self.unknown
        self.table = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b in range(256):
            self.table[vocabulary.bytes_from + b] = bytes([b])

    def best(self, unit: str) -> tuple[float, list[int]]:
        """The best score of a unit and its ids, by one pass of the automaton."""
        n, admissible = len(unit), self.vocabulary.admissible
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, float, int] | None] = [None] * (n + 1)
        done = 0
        for end, match in self.vocabulary.automaton.iter(unit):
            while done < end:  # positions before this one are settled
                done += 1
                if best[done] is None:
                    best[done] = best[done - 1] + self.unknown
            start = end + 1 - match[0]
            score = best[start] + match[1]
            if ((here := best[end + 1]) is None or score > here) and admissible(back[start][2] if back[start] else -1, match[2]):
                best[end + 1] = score
                back[end + 1] = match
        while done < n:
            done += 1
            if best[done] is None:
                best[done] = best[done - 1] + self.unknown
        ids: list[int] = []
        at = n
        while at:
            if (match := back[at]) is not None:
                ids.append(match[2])
                at -= match[0]
            else:
                ids += [self.vocabulary.bytes_from + b for b in reversed(unit[at - 1].encode())]
                at -= 1
        return best[n], ids[::-1]

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = np.array(self.best(unit)[1], np.int32).tobytes()
        if len(unit) <= REMEMBERED:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found

    def _own_marks(self, text: str) -> bytes:
        """A text that contains the vocabulary's mark: its marks become bytes, so that they don't decode to spaces."""
        mark = np.array([self.vocabulary.bytes_from + b for b in SPACE.encode()], np.int32).tobytes()
        first, *rest = text.split(SPACE)
        whole = [b"".join(map(self.__getitem__, self.vocabulary.split(first)))]
        for part in rest:
            whole.append(mark)
            whole += map(self.__getitem__, self.vocabulary.units.findall(part.replace(" ", SPACE)))
        return b"".join(whole)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if SPACE in text:
            return self._own_marks(text)
        return b"".join(map(self.__getitem__, self.vocabulary.split(text)))

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text of some ids."""
        return b"".join(map(self.table.__getitem__, ids))[1:]


_CODECS: dict[bytes, Codec] = {}


def shared_codec(vocabulary: Vocabulary) -> Codec:
    """One codec for each vocabulary and worker, as building the automaton takes a while."""
    if vocabulary.digest not in _CODECS:
        _CODECS[vocabulary.digest] = Codec(vocabulary)
    return _CODECS[vocabulary.digest]


def encode(docs: DataFrame, model_file: str = DEFAULT_MODEL, text_col: str = "text") -> DataFrame:
    """The documents' other columns with ids, their number, those for bytes, the segmentation's score, and whether decoding
    the ids gives the text back."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(model_file))
    result = StructType.fromDDL(RESULT)
    keep = [c for c in docs.columns if c != text_col and c not in result.names]
    schema = StructType([docs.schema[c] for c in keep] + result.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(shared.value)
        lo, hi = codec.vocabulary.bytes_from, codec.vocabulary.bytes_from + 256
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    texts = [t or "" for t in batch.column(text_col).to_pylist()]
                    coded = [codec.encode(t) for t in texts]
                    ids = np.frombuffer(b"".join(coded), np.int32)
                    bounds = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])])
                    total = np.concatenate([[0.0], np.cumsum(codec.scores[ids])])
                    of_bytes = np.concatenate([[0], np.cumsum((ids >= lo) & (ids < hi))])
                    same = [codec.decode(ids[bounds[k] : bounds[k + 1]].tolist()) == t.encode() for k, t in enumerate(texts)]
                    found = [pa.array(np.diff(bounds)), pa.array(np.diff(of_bytes[bounds])), pa.array(np.diff(total[bounds])), pa.array(same), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], names=schema.names)
        finally:  # workers live on after the task: they keep the automaton, not the cache
            codec.clear()
            codec.older = {}

    return docs.select(*keep, text_col).mapInArrow(apply, schema)


def decode(encoded: DataFrame, model_file: str = DEFAULT_MODEL, ids_col: str = "ids") -> DataFrame:
    """The rows with ``text``, decoded from their ids (null ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    keep = [c for c in encoded.columns if c not in (ids_col, "text")]
    schema = StructType([encoded.schema[c] for c in keep]).add("text", "string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(shared.value)
        for batch in batches:
            texts = [codec.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*keep, ids_col).mapInArrow(apply, schema)
