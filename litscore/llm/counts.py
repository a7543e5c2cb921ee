"""Token counts of texts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; dynamic
programming over the ends keeps the best score, the number of pieces on that path and
whether its last piece is unknown. Tie rules are those of the tokenizers library: of paths
with equal score to one end, the one whose last piece starts first stays; a character that
no piece of its own covers is an unknown piece of the least score less 10; unknown
neighbours are one piece, or one per UTF-8 byte where the vocabulary falls back to bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from litscore.llm.common import spread
from litscore.worker import worker_state

UNKNOWN_PENALTY = 10.0
SPACE = "▁"
# A run of spaces starts a new word unless a piece of the vocabulary has one inside.
_CUT = re.compile(rf"(?<=[^{SPACE}])(?={SPACE})")
_TEXTS = 128
#: Distinct words whose counts a worker keeps; beyond that it starts anew.
CACHE_WORDS = 500_000


class _Numbered(dict):
    """Numbers for words in order of their first use; ``new`` collects the unseen."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    )
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in ordinary]


class Counter:
    """Best score and piece count of texts."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_for_unknown: bool = True) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.empty = not len(self.automaton)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_for_unknown = bytes_for_unknown
        self.whole = any(_CUT.search(p) for p, _ in pieces)
        self._clear()

    def _clear(self) -> None:
        self.index = _Numbered()
        self.counts, self.scores = np.zeros(0, np.int64), np.zeros(0)

    @classmethod
    def of_worker(cls, path: str) -> Counter:
        kept = worker_state()
        key = ("counter", path)
        if key not in kept:
            kept[key] = cls(vocabulary(path))
        return kept[key]

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best path over the whole word."""
        n = len(word)
        score, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found: Iterator = iter(()) if self.empty else self.automaton.iter(word)
        match = next(found, None)
        for end in range(1, n + 1):
            top, single = None, False
            while match is not None and match[0] == end - 1:  # longest first
                size, own = match[1]
                value = score[end - size] + own
                single = single or size == 1
                if top is None or value > top:
                    top, at = value, end - size
                match = next(found, None)
            value = score[end - 1] + self.unknown
            if not single and (top is None or value > top):
                score[end], open_[end] = value, True
                if self.bytes_for_unknown:
                    count[end] = count[end - 1] + len(word[end - 1].encode("utf-8", "replace"))
                else:
                    count[end] = count[end - 1] + (not open_[end - 1])
            else:
                score[end], count[end] = top, count[at] + 1
        return score[n], count[n]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        spaced = SPACE + text.replace(" ", SPACE)
        return [spaced] if self.whole else _CUT.split(spaced)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece counts and scores of the texts; equal words are counted once."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        cut = [self.words(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if self.index.new:
            new, self.index.new = self.index.new, []
            found = [self.best(w) for w in new]
            n = len(self.index) - len(new)
            if len(self.counts) < len(self.index):
                more = len(self.index) + len(self.counts)
                self.counts, self.scores = np.resize(self.counts, more), np.resize(self.scores, more)
            self.counts[n : n + len(new)] = [c for _, c in found]
            self.scores[n : n + len(new)] = [s for s, _ in found]
        text = np.repeat(np.arange(len(cut)), sizes)
        counts = np.bincount(text, self.counts[which], len(cut)).astype(np.int64)
        return counts, np.bincount(text, self.scores[which], len(cut))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score), one row per row of ``docs`` (doc_id, text; others ignored).

    A space is a piece of its own kind, and one is put before each text. A null or empty
    text has no tokens and score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of_worker(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                counts, scores = counter([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(scores)], names=["doc_id", "n_tokens", "score"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, score double")
