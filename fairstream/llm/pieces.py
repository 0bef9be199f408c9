"""SentencePiece encoding and decoding: one Viterbi pass driven by an Aho-Corasick automaton.

No piece has the blank sign after another sign, so the best segmentation of a text is that of
its words one after the other, and tasks remember the words they have met.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANK = "▁"
WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 60_000
LOWEST = float("-inf")


def words_of(text: str) -> list[str]:
    """The words of a text that is not empty, without the one blank sign that each begins with."""
    if "  " in text or text[0] == " " or BLANK in text:
        return [w[1:] for w in WORDS.findall(BLANK + text.replace(" ", BLANK))]
    return text.split(" ")


class Remembered(dict):
    """Word -> what ``find`` says of it with its blank sign. Of words not met for long it forgets; call ``rest`` between texts."""

    def __init__(self, find: Callable[[str], object]):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.find(BLANK + word)
        self[word] = found
        return found

    def rest(self) -> None:
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()


class Segmenter:
    """The automaton over the pieces of a model file: an identity-normalising one with dummy prefix and byte fallback."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        count = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(count)]
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(count) if model.is_byte(i)}
        self.bytes = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.automaton = ahocorasick.Automaton()
        self.singles, lowest = set(), 0.0
        for i, name in enumerate(self.names):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                continue
            if BLANK in name.lstrip(BLANK):
                raise ValueError(f"piece {name!r} goes on after a blank")
            self.automaton.add_word(name, (i, len(name), model.get_score(i)))
            lowest = min(lowest, model.get_score(i))
            if len(name) == 1:
                self.singles.add(name)
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY

    def segment(self, word: str) -> tuple[int, ...]:
        """Ids of the segmentation of a whole word with the best sum of scores, of equal ones that with the longer last piece."""
        if not self.singles.issuperset(word):
            return self.segment_unknown(word)
        # best[i] ends behind sign i; best[-1], the last of the list, is the start
        best, came = [LOWEST] * len(word) + [0.0], [(0, 0, 0.0)] * len(word)
        # matches come by their end, at each end along the output links, the longest first
        for end, match in self.automaton.iter(word):
            score = best[end - match[1]] + match[2]
            if score > best[end]:
                best[end], came[end] = score, match
        ids, at = [], len(word) - 1
        while at >= 0:
            match = came[at]
            ids.append(match[0])
            at -= match[1]
        ids.reverse()
        return tuple(ids)

    def segment_unknown(self, word: str) -> tuple[int, ...]:
        """The same where some signs are no pieces: each can stand for itself, as its bytes."""
        best, came = [LOWEST] * len(word) + [0.0], [(-1, 1, self.unknown)] * len(word)
        ends = [[] for _ in word]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        for end, matches in enumerate(ends):
            if word[end] not in self.singles:
                matches = [*matches, (-1, 1, self.unknown)]
            for match in matches:
                score = best[end - match[1]] + match[2]
                if score > best[end]:
                    best[end], came[end] = score, match
        ids, at = [], len(word) - 1
        while at >= 0:
            piece, length, _ = came[at]
            signs = word[at].encode("utf-8", "surrogatepass")
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(signs)]
            at -= length
        return tuple(reversed(ids))


class Pieces:
    """Encoding and decoding of texts; words that were met are remembered.

    What remembers does not point back here, so all of it is freed at the end of a task.
    """

    def __init__(self, model_file: str):
        self.segmenter = Segmenter(model_file)
        self.names, self.bytes = self.segmenter.names, self.segmenter.bytes
        self.ids = Remembered(self.segmenter.segment)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids = list(chain.from_iterable(map(self.ids.__getitem__, words_of(text))))
        self.ids.rest()
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: without the dummy prefix, runs of byte pieces read as UTF-8."""
        raw = self.bytes
        if raw.keys().isdisjoint(ids):
            text = "".join(map(self.names.__getitem__, ids))
        else:
            text = b"".join([raw.get(i) or self.names[i].encode() for i in ids]).decode("utf-8", "replace")
        return text.replace(BLANK, " ").removeprefix(" ")


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, ids array<int>, n_pieces bigint, round_trip boolean``, one row per row.

    The whole text is encoded. A null or empty text has no pieces. ``round_trip`` tells whether
    decoding gives the text again, which it does for every text (the sign that stands for a
    blank is read as one). Other columns are not read; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_file)
        for batch in batches:
            ids, same = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                ids.append(pieces.encode(text))
                same.append(pieces.decode(ids[-1]) == text.replace(BLANK, " "))
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_pieces", "round_trip"])

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, n_pieces bigint, round_trip boolean")


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, text``, one row per row.

    Null and empty lists give an empty text. Runs of byte pieces are read as UTF-8, what is none of it
    as the replacement sign. Long lists are decoded whole; repeated rows give repeated rows, an
    empty table gives an empty result, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_file)
        for batch in batches:
            texts = [pieces.decode(v.as_py() or []) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
