r"""Packing into sequences of a fixed length whose tokens come from the sources in given proportions.

Every source is a queue of tokens: its documents in the order in which the tasks read them. Deficit round-robin fills windows of ``WINDOW``
tokens in cells of ``CELL``: each cell adds to every queue's credit its share of a cell, a queue sends the cell that its credit is due for
first (the j-th when the credit reaches j + 1/2 cells, equal times by the queue's place), and what a queue is owed or has overdrawn is its
deficit, carried to the next window. The queues' cells therefore stand in the order of (j + 1/2) / share, whatever queues have run out,
so how many cells each has sent by any window (``sent``) is a function of the shares alone: every task knows the deficits at the
windows its own documents lie in, and no task waits for another. In each window every queue's tokens are within two cells of its share. Inside a window
a queue's cells stand together, queues in order. By default shares are the queues' tokens, so that all run out together.

Documents are cut where a window's share of their queue ends. What doesn't fill cells or the last window (at most a window and a cell of each
queue) follows queue by queue and is cut into sequences of ``WINDOW`` tokens, then of powers of two, which need no padding.

The largest ``MAX_QUEUES`` sources are queues of their own; rows of all others share one more queue, whose share is theirs together. The tokens of a text
are those of the tokenizer's model on the words its pattern finds; words seen before come from a bounded cache, and texts with characters
outside of ``_PLAIN``, for which normalisation could do more than lower the case, go through the whole tokenizer. Ids, lengths
and places in the task are written to the checkpoint folder once; offsets of tasks are sums of that table's narrow columns.

Defined results: null and empty texts have the end id alone; repeated rows are packed one by one; an empty table gives no rows; a null
source is a source; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoloom.llm.common import small, starts, written

TOKENIZER, END = "word_bpe_49k.json", 1
WINDOW, CELL = 2_048, 32
MAX_QUEUES = 64
#: Words that are remembered.
CACHE = 400_000
#: Characters that normalisation leaves as they are but for their case: ASCII, Latin letters and Cyrillic ones.
_LETTERS = "a-zß-öø-įı-ſа-џ"
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-įı-ſЀ-џ]*")
#: The words that the tokenizer's own pattern finds in such texts, in lower case.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\x0b\x0c\r{_LETTERS}0-9]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_characters() -> list[str]:
    """The characters by which byte-level vocabularies write bytes: themselves if visible in Latin-1, else from 256 on in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class Tokens(dict):
    """Encodes texts; a mapping from a word to its ids, little-endian, in as many bytes as the vocabulary takes."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_str(definition)
        self.model, self.older, self.characters = self.whole.model, {}, _byte_characters()
        self.code = "H" if max(self.whole.get_vocab(with_added_tokens=True).values(), default=0) < 65_536 else "I"
        parts = json.loads(definition)
        kinds = [x["type"] for x in parts["normalizer"]["normalizers"]] if (parts.get("normalizer") or {}).get("type") == "Sequence" else []
        split = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.by_words = kinds == ["NFC", "Replace", "Lowercase"] and split == _PATTERN
        self.special = re.compile("|".join(re.escape(x["content"]) for x in parts["added_tokens"]) or r"(?!)")

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            written_as = word if word.isascii() and word.isprintable() else "".join(map(self.characters.__getitem__, word.encode()))
            found = array(self.code, [t.id for t in self.model.tokenize(written_as)]).tobytes()
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if self.by_words and _PLAIN.fullmatch(text) and not self.special.search(text):
            return b"".join(map(self.__getitem__, _WORDS.findall(text.lower())))
        return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()


_TOKENS: dict[bytes, Tokens] = {}


def shared_tokens(definition: str) -> Tokens:
    """One encoder for each tokenizer and worker, told by a digest of its whole definition."""
    key = hashlib.sha256(definition.encode()).digest()
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(definition)
    return _TOKENS[key]


def encode(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """doc_id, source, ids (integers of 2 or 4 bytes in a row, the end id last), their number n, the task (part), and the tokens of the
    source that the task has read before."""
    with open(tokenizer or default_tokenizer()) as f:  # on the driver; tasks get it by broadcast
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared_tokens(shared.value)
        size, last = array(tokens.code).itemsize, array(tokens.code, [end]).tobytes()
        part = TaskContext.get().partitionId()
        done: dict[str | None, int] = defaultdict(int)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [tokens.encode(t or "") + last for t in batch.column(2).to_pylist()]
                n, before = [len(x) // size for x in ids], []
                for source, count in zip(batch.column(1).to_pylist(), n, strict=True):
                    before.append(done[source])
                    done[source] += count
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int64()), pa.array(before, pa.int64())], names=["doc_id", "source", "ids", "n", "part", "before"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(apply, "doc_id long, source string, ids binary, n long, part long, before long")


class Schedule:
    """Which cell of which queue stands where: ``tokens`` and ``shares`` of the queues in order."""

    def __init__(self, tokens: list[int], shares: list[float]) -> None:
        self.tokens, self.share = np.array(tokens, np.int64), np.array(shares, np.float64)
        self.cells = self.tokens // CELL
        self.per_window = WINDOW // CELL
        self.windows = int(self.cells.sum()) // self.per_window
        self.full = self.sent(np.array([self.windows]))[0] if len(tokens) else self.cells
        rest = self.tokens - CELL * self.full  # what the full windows leave of each queue
        self.rest_at = np.concatenate([[0], np.cumsum(rest)])
        left, cuts = int(rest.sum()), [0]
        while left:
            cuts.append(cuts[-1] + (size := min(WINDOW, 1 << (left.bit_length() - 1))))
            left -= size
        self.cuts = np.array(cuts, np.int64)

    def due(self, queue: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """When a queue's cell is sent: the time at which its credit reaches the cell's middle."""
        return (cell + 0.5) / self.share[queue]

    def before(self, time: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """For each (time, queue) the cells of every queue that come before it; one row for each time."""
        every = np.arange(len(self.share))
        n = np.floor(time[:, None] * self.share + 0.5).astype(np.int64)

        def first(c: np.ndarray) -> np.ndarray:
            due = self.due(every, c)
            return (due < time[:, None]) | ((due == time[:, None]) & (every < queue[:, None]))

        n += first(n)
        n -= ~first(n - 1)
        return np.clip(n, 0, self.cells)

    def sent(self, window: np.ndarray) -> np.ndarray:
        """Cells that every queue has sent before each window; one row for each window."""
        goal = np.asarray(window, np.int64) * self.per_window
        ends = np.append(0.0, np.sort(self.cells / self.share))  # when queues run out; between these, cells go in proportion to time
        time = np.interp(goal, np.minimum(self.cells, ends[:, None] * self.share).sum(axis=1), ends)
        n = np.minimum(self.cells, np.floor(time[:, None] * self.share + 0.5)).astype(np.int64)
        every, rows = np.arange(len(self.share)), np.arange(len(goal))
        while True:  # the few that rounding leaves, in the order in which they are due
            after = np.where(n < self.cells, self.due(every, n), np.inf)
            last = np.where(n > 0, self.due(every, n - 1), -np.inf)
            nxt, prev = after.argmin(axis=1), last.shape[1] - 1 - last[:, ::-1].argmax(axis=1)
            count = n.sum(axis=1)
            wrong = (last[rows, prev] > after[rows, nxt]) | ((last[rows, prev] == after[rows, nxt]) & (prev > nxt))
            add, take = (count < goal) | ((count == goal) & wrong), (count > goal) | ((count == goal) & wrong)
            if not (add | take).any():
                return n
            n[rows[add], nxt[add]] += 1
            n[rows[take], prev[take]] -= 1

    def pieces(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cuts runs of ``n`` tokens at place ``at`` of their queue: run, start in the run, length, sequence, offset there."""
        full = self.full[queue]
        inside = np.clip(CELL * full - at, 0, n)  # tokens that lie in full windows
        lo, hi = at // CELL, -(-(at + inside) // CELL)
        count = np.where(inside > 0, hi - lo, 0)
        run = np.repeat(np.arange(len(n)), count)
        cell = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + lo[run]
        window = self.before(self.due(queue[run], cell), queue[run]).sum(axis=1) // self.per_window
        head = np.ones(len(run), bool)
        head[1:] = (run[1:] != run[:-1]) | (window[1:] != window[:-1])
        begin = np.flatnonzero(head)
        end = np.append(begin, len(run))[1:] - 1
        r, w = run[begin], window[begin]
        start = np.maximum(CELL * cell[begin], at[r])
        stop = np.minimum(CELL * (cell[end] + 1), (at + inside)[r])
        known, back = np.unique(w, return_inverse=True)
        here, after = self.sent(known), self.sent(known + 1)
        in_window = np.cumsum(after - here, axis=1) - (after - here)
        offset = CELL * in_window[back, queue[r]] + start - CELL * here[back, queue[r]]
        whole = (r, start - at[r], stop - start, w, offset)
        # the rest, on the line of all queues' rests
        r = np.flatnonzero(n > inside)
        first = self.rest_at[queue[r]] + (at + inside)[r] - CELL * full[r]
        last = first + (n - inside)[r]
        lo, hi = np.searchsorted(self.cuts, first, "right") - 1, np.searchsorted(self.cuts, last, "left")
        k = np.repeat(np.arange(len(r)), hi - lo)
        cut = np.arange(len(k)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[k]
        start, stop = np.maximum(self.cuts[cut], first[k]), np.minimum(self.cuts[cut + 1], last[k])
        rest = (r[k], inside[r[k]] + start - first[k], stop - start, self.windows + cut, start - self.cuts[cut])
        return tuple(np.concatenate(x) for x in zip(whole, rest, strict=True))


def pack(docs: DataFrame, shares: Mapping[str | None, float] | None = None, tokenizer: str | None = None, end: int = END, keep_ids: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, source, start, length, ids (with ``keep_ids``), ids_crc32, doc_tokens, sequence_id, offset.

    ``shares``: parts of a window for some of the largest sources; all others share what these leave, in proportion to their tokens (and come
    last where nothing is left). A source whose tokens run out leaves its part to the rest."""
    coded = written(encode(docs, tokenizer, end), "tokens")
    sums = written(coded.groupBy("part", "source").agg(F.sum("n").alias("n")), "sums")
    largest = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("source")).limit(MAX_QUEUES).collect()
    names = [r.source for r in largest]
    place = F.coalesce(F.try_element_at(F.create_map(*[x for i, s in enumerate(names) for x in (F.lit("-" if s is None else f"={s}"), F.lit(i))]), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))), F.lit(MAX_QUEUES)) if names else F.lit(0)
    parts = sums.agg(F.max("part")).first()[0] or 0
    by_part = sums.groupBy(place.alias("queue"), "part").agg(F.sum("n").alias("n"))
    queue_tokens = {r.queue: r.n for r in by_part.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # at most MAX_QUEUES + 1 rows
    tokens = [queue_tokens.get(q, 0) for q in range(max(queue_tokens, default=-1) + 1)]
    given = {q: shares[s] for q, s in enumerate(names) if shares and s in shares}
    others = sum(t for q, t in enumerate(tokens) if q not in given) or 1
    left = max(1 - sum(given.values()), 0.0)
    schedule = Schedule(tokens, [max(given.get(q, left * t / others), 1e-12) for q, t in enumerate(tokens)])
    # where each task's tokens of a source begin in its queue: earlier tasks, and in the shared queue the task's sources in order
    from_part = starts(by_part, ["queue"], "part", "n", parts).select("queue", "part", "start")
    offsets = sums.select("source", "part", "n", place.alias("queue")).join(from_part, ["queue", "part"])
    within = F.coalesce(F.sum("n").over(Window.partitionBy("queue", "part").orderBy(F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(offsets.select("part", "source", F.col("queue").cast("int").alias("queue"), (F.col("start") + within).alias("start")), "offsets").withColumnsRenamed({"part": "_part", "source": "_source"})
    same = (coded["part"] == offsets["_part"]) & coded["source"].eqNullSafe(offsets["_source"])
    placed = coded.join(small(offsets, offsets.count()), same).select("doc_id", "source", "ids", "n", "queue", (F.col("start") + F.col("before")).alias("at"))
    shared = docs.sparkSession.sparkContext.broadcast(schedule)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                n, queue, at = (batch.column(c).to_numpy().astype(np.int64) for c in (3, 4, 5))
                run, start, length, sequence, offset = shared.value.pieces(queue, at, n)
                raw = [memoryview(x if len(x) == 4 * c else np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x, c in zip(batch.column(2).to_pylist(), n.tolist(), strict=True)]
                cut = [raw[r][4 * a : 4 * (a + c)] for r, a, c in zip(run.tolist(), start.tolist(), length.tolist(), strict=True)]
                crc = pa.array(list(map(zlib.crc32, cut)), pa.int64())
                found: list[Any] = [batch.column(0).take(pa.array(run)), batch.column(1).take(pa.array(run)), pa.array(start), pa.array(length)]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    found.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cut), "<u4").astype(np.int32))))
                found += [crc, pa.array(n[run]), pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(found, names=schema.names)

    ids = "ids array<int>, " if keep_ids else ""
    schema = StructType.fromDDL(f"doc_id long, source string, start long, length long, {ids}ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.mapInArrow(apply, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(docs, keep_ids=False).drop("source")
