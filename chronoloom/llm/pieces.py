"""A fixed public piece vocabulary: loading, cutting texts where no piece can reach across, matching pieces, and which pieces may
follow each other.

Vocabularies are read from a model file on the driver and sent to the tasks as a broadcast of ``Vocabulary``, whose size is
that of the vocabulary (32,000 pieces), not of the data. Nothing is trained here.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cached_property

import ahocorasick

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The vocabulary's mark of a space.
SPACE = "▁"
#: Pairs of pieces whose admissibility is remembered.
PAIRS = 500_000


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """pieces in order of ids; ``bytes_from`` is the id of the piece of byte 0, ``first`` that of the first ordinary piece."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    bytes_from: int
    first: int

    @cached_property
    def digest(self) -> bytes:
        """Tells vocabularies apart: of all pieces, scores and numbers."""
        return hashlib.sha256(repr((self.pieces, self.scores, self.bytes_from, self.first)).encode("utf-8", "surrogatepass")).digest()

    @cached_property
    def ordinary(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if i >= self.first and p}

    @cached_property
    def by_merges(self) -> bool:
        """Whether scores are places in an order of merges (whole numbers) and not logarithms of probabilities."""
        return all(s == int(s) for s in self.scores[self.first :])

    def merged(self, text: str) -> list[str]:
        """A text's characters after all merges, the best score first and the leftmost of equal ones."""
        parts, score = list(text), self.scores
        while len(parts) > 1:
            found = [(-score[i], k) for k in range(len(parts) - 1) if (i := self.ordinary.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    @cached_property
    def _pairs(self) -> dict[tuple[int, int], bool]:
        return {}

    def admissible(self, before: int, piece: int) -> bool:
        """Whether a piece may stand after another one (-1: after nothing): always, but for vocabularies of merges only where
        merging both texts together gives these two pieces. A segmentation all of whose pairs are admissible is that of the merges."""
        if not self.by_merges:
            return True
        known = self._pairs.get((before, piece))
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            both = [self.pieces[before], self.pieces[piece]] if before >= 0 else [self.pieces[piece]]
            known = self._pairs[before, piece] = self.merged("".join(both)) == both
        return known

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Aho-Corasick automaton over the ordinary pieces; a match's value is (length, score, id)."""
        a = ahocorasick.Automaton()
        for p, i in self.ordinary.items():
            a.add_word(p, (len(p), self.scores[i], i))
        a.make_automaton()
        return a

    @cached_property
    def units(self) -> re.Pattern[str]:
        """Finds the units of a text, between which no piece reaches: a run of marks and what follows it, cut at line ends and
        between letters and the punctuation that no piece has right after a letter."""
        after_letter = {b for p in self.ordinary for a, b in zip(p, p[1:], strict=False) if a.isalpha() and not b.isalnum()}
        inside = {p for p in self.ordinary if SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1)}
        if inside:
            return re.compile(r"[\s\S]+")
        stops = "".join(re.escape(c) for c in ".,;:!?*$%&|#<>()\"" if c not in after_letter)
        return re.compile(rf"{SPACE}*+[^\W\d_]++(?=[{stops}{SPACE}\n]|\Z)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def split(self, text: str) -> list[str]:
        """Units of a text with its dummy space in front; the text's own marks count as spaces here."""
        return self.units.findall(SPACE + text.replace(" ", SPACE))

    def __reduce__(self):
        return Vocabulary, (self.pieces, self.scores, self.bytes_from, self.first)


def load_vocabulary(model_file: str = DEFAULT_MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.vocab_size()
    kinds = [m.is_byte(i) for i in range(n)]
    first = 1 + max(i for i in range(n) if kinds[i] or m.is_control(i) or m.is_unknown(i))
    return Vocabulary(tuple(m.id_to_piece(i) for i in range(n)), tuple(m.get_score(i) for i in range(n)), kinds.index(True), first)
