"""Token counts under a unigram vocabulary, without building the tokens (count-only Viterbi).

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming keeps, for
each end, the best score and its number of pieces. Ties are those of the public unigram tokenizers: a later candidate
replaces an earlier one only with a strictly higher score, and candidates come by ascending start, so the longest last
piece wins a tie. A character that is no piece by itself may stand as unknown at the lowest score less ten; with byte
pieces it counts as its UTF-8 bytes, else as one. Scores add in double precision from the start of each segment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

SPACE = "▁"
CACHE = 1_000_000  # segments a worker remembers before it starts anew


@dataclass
class Vocabulary:
    pieces: dict[str, float]
    byte_fallback: bool
    unknown: float = field(init=False)
    by_word: bool = field(init=False)
    by_line: bool = field(init=False)

    def __post_init__(self):
        self.unknown = min(self.pieces.values(), default=0.0) - 10.0
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.by_line = not any("\n" in p for p in self.pieces)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            out.add_word(piece, (len(piece), score))
        out.make_automaton()
        return out


def vocabulary(path: str) -> Vocabulary:
    """The scored pieces of a SentencePiece file, read as a unigram vocabulary. Control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in plain}, any(model.is_byte(i) for i in ids))


class Counter:
    """Counts pieces of whole texts; segments that no piece can cross are counted once and remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.found, self.known = vocabulary, vocabulary.automaton(), {}
        newline = "\n" if vocabulary.by_line else ""
        if vocabulary.by_word:
            self.segments = re.compile(f"{SPACE}*[^{SPACE}{newline}]+|{SPACE}+" + ("|\n" if newline else "")).findall
        else:
            self.segments = re.compile("[^\n]+|\n" if newline else r"(?s).+").findall

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        own = self.segments(SPACE + text.replace(" ", SPACE))
        new = set(own).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set(own)
        for segment in new:
            self.known[segment] = self.segment(segment)
        return sum(map(self.known.__getitem__, own))

    def segment(self, segment: str) -> int:
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(segment) + 1)]
        for last, piece in self.found.iter(segment):
            ends[last + 1].append(piece)  # the longest first
        best, count = [0.0], [0]
        for end in range(1, len(segment) + 1):
            top, n, single = float("-inf"), 0, False
            for length, score in ends[end]:
                score += best[end - length]
                if score > top:
                    top, n = score, count[end - length] + 1
                single |= length == 1
            if not single and best[end - 1] + self.v.unknown > top:
                top = best[end - 1] + self.v.unknown
                n = count[end - 1] + (len(segment[end - 1].encode("utf-8", "surrogatepass")) if self.v.byte_fallback else 1)
            best.append(top)
            count.append(n)
        return count[-1]


_COUNTERS: dict[int, Counter] = {}


def token_counts(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Every row of docs with n_tokens long of the whole text appended (a column of that name is replaced).

    Null and empty texts have 0 tokens. Repeated rows count each; texts of any length are counted whole.
    """
    docs = docs.drop("n_tokens")
    table = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def count(batches):
        counter = _COUNTERS.get(id(table.value))
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[id(table.value)] = Counter(table.value)
        for batch in batches:
            for part in slices(batch, column):
                n = [counter.text(t) for t in part.column(column).to_pylist()]
                yield part.append_column("n_tokens", pa.array(n, pa.int64()))

    return docs.mapInArrow(count, docs.withColumn("n_tokens", F.lit(0).cast("long")).schema)
