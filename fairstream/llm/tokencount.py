"""Token counts of byte-fallback piece BPE by rank-synchronous array merging.

A text falls into words (a run of blanks and what follows up to the next blank), across which no
merge can go. Tasks collect the words they have not met, hold them as one ragged array of symbols,
and in every round merge each word's best pair (best score, then leftmost) at the same time, until
no word has a pair left. What survives is counted: one for a piece, its UTF-8 bytes for a sign
that is no piece.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from fairstream.llm.pieces import BLANK, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHED_WORDS = 150_000
LONG_WORD = 64
BATCH_WORDS = 20_000
NO_RANK = np.int64(1) << 40
PLACE_BITS = 22


class Merges:
    """Pair table of a model file: which two symbols join to which, and how early."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        names, scores = [], []
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                names.append(model.id_to_piece(i))
                scores.append(model.get_score(i))
        if any(BLANK in n.lstrip(BLANK) for n in names):
            raise ValueError("a piece goes on after a blank")
        pieces = {n: i for i, n in enumerate(names)}
        self.signs = {n: i for n, i in pieces.items() if len(n) == 1}
        for name in names:  # signs that only occur inside pieces take part in merges too
            for sign in name:
                self.signs.setdefault(sign, len(names) + len(self.signs))
        order = np.unique(-np.array(scores), return_inverse=True)[1]  # equal scores, equal rank
        symbols = pieces | self.signs
        pairs = [
            (symbols[n[:cut]] << 32 | symbols[n[cut:]], i)
            for n, i in pieces.items()
            for cut in range(1, len(n))
            if n[:cut] in symbols and n[cut:] in symbols
        ]
        pairs.sort()
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.made = np.array([i for _, i in pairs], np.int64)
        self.rank = order[self.made].astype(np.int64)
        self.known = len(names)
        self.symbol_of = np.full(0x110000, -1, np.int64)
        self.symbol_of[[ord(c) for c in self.signs]] = list(self.signs.values())
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; ``NO_RANK`` if it does not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        found = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank[at], NO_RANK), np.where(found, self.made[at], -1)

    def count(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word, all words merged in step."""
        text = "".join(words)
        signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.symbol_of[signs]
        # what a symbol counts in the end: 1, or its bytes if it is no piece
        size = 1 + (signs > 0x7F) + (signs > 0x7FF) + (signs > 0xFFFF).astype(np.int64)
        weight = np.where((symbol >= 0) & (symbol < self.known), 1, size)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done = np.zeros(len(words), np.int64)
        last = np.append(word[1:] != word[:-1], True)  # a word's last symbol has no pair
        rank, made = np.full(len(symbol), NO_RANK), np.full(len(symbol), -1)
        at = np.flatnonzero(~last)
        rank[at], made[at] = self.lookup(symbol[at], symbol[at + 1])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, last[:-1]])
            # rank first, place second: the smallest is the leftmost best pair of the word
            best = np.minimum.reduceat(rank << PLACE_BITS | np.arange(len(rank)), starts)
            ended = best >= NO_RANK << PLACE_BITS
            if ended.any():
                done[word[starts[ended]]] = np.add.reduceat(weight, starts)[ended]
            at = best[~ended] & ((1 << PLACE_BITS) - 1)
            symbol[at], weight[at], last[at] = made[at], 1, last[at + 1]
            keep = np.repeat(~ended, np.diff(np.r_[starts, len(rank)]))
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            symbol, weight, word, last, rank, made = (x[keep] for x in (symbol, weight, word, last, rank, made))
            # only the pairs on both sides of a merge are new
            before = at[at > 0] - 1
            for new in (at, before):
                rank[new], made[new] = NO_RANK, -1
                new = new[~last[new]]
                rank[new], made[new] = self.lookup(symbol[new], symbol[new + 1])
        return done

    def long_count(self, word: str) -> int:
        """The same for one long word, in time n log n: pairs wait in a heap by rank and place."""
        import heapq

        symbol = [self.signs.get(c, -1) for c in word]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, made = self.lookup(np.array(symbol[:-1], np.int64), np.array(symbol[1:], np.int64))
        waiting = [(int(rank[i]), i, symbol[i], symbol[i + 1], int(made[i])) for i in np.flatnonzero(rank < NO_RANK).tolist()]
        heapq.heapify(waiting)
        table = self.table()
        gone = [False] * n

        def push(i: int) -> None:
            j = after[i]
            if j < n and (hit := table.get((symbol[i], symbol[j]))):
                heapq.heappush(waiting, (hit[0], i, symbol[i], symbol[j], hit[1]))

        while waiting:
            _, i, left, right, result = heapq.heappop(waiting)
            j = after[i]
            if gone[i] or j >= n or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i], gone[j], after[i] = result, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return sum(
            1 if 0 <= symbol[i] < self.known else len(word[i].encode("utf-8", "surrogatepass"))
            for i in range(n)
            if not gone[i]
        )

    def table(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_table"):
            rows = zip((self.pair >> 32).tolist(), (self.pair & 0xFFFFFFFF).tolist(), self.rank.tolist(), self.made.tolist())
            self._table = {(a, b): (r, m) for a, b, r, m in rows}
        return self._table

    def learn(self, texts: list[list[str]]) -> None:
        cache, older = self.cache, self.older
        new = set().union(*texts).difference(cache)
        cache.update((w, older[w]) for w in new.intersection(older))
        new.difference_update(older)
        long = [w for w in new if len(w) >= LONG_WORD]
        cache.update((w, self.long_count(BLANK + w)) for w in long)
        short = list(new.difference(long))
        for start in range(0, len(short), BATCH_WORDS):
            part = short[start : start + BATCH_WORDS]
            cache.update(zip(part, self.count([BLANK + w for w in part]).tolist()))

    def tokens(self, texts: list[str]) -> list[int]:
        words = [words_of(t) if t else [] for t in texts]
        self.learn(words)
        get = self.cache.__getitem__
        counts = [sum(map(get, w)) for w in words]
        if len(self.cache) > CACHED_WORDS:  # of words not met for long it forgets
            self.older, self.cache = self.cache, {}
        return counts


TEXTS_A_STEP = 256
SIGNS_A_STEP = 4 << 20


def counted(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, n_bytes, n_tokens, over_limit``, one row per row.

    The whole text counts, as the library of the model file counts it: no begin, end or added
    tokens, special strings are ordinary text. A null text counts as an empty one, with no
    tokens. Repeated rows give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(model_file)
        for batch in batches:
            sizes, tokens, held, signs = [], [], [], 0
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                held.append(text)
                signs += len(text)
                if len(held) >= TEXTS_A_STEP or signs > SIGNS_A_STEP:
                    tokens += merges.tokens(held)
                    held, signs = [], 0
            tokens += merges.tokens(held)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
