"""Token counts under a unigram vocabulary by a count-only Viterbi search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import short_batches
from tallyframe.llm.tokens import MAX_CHUNKS, Memo, worker_cache

#: Mark that stands for the white space before a word.
SPACE = "▁"
#: An unknown character scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = range(sp.get_piece_size())
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in found if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    """Counts pieces of the best segmentation of each white-space chunk."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.empty = not vocabulary
        self.reset()

    def reset(self) -> None:
        self.chunks, self.counts = Memo(), np.zeros(1 << 12, np.int32)

    def count(self, word: str) -> int:
        """Pieces of ``word``: best score, then at each place the earliest start among equals.

        Matches that end at a place come longest first, and only a strictly
        better score replaces one, as a search over ascending starts does. A
        character that is no piece is an unknown one; neighbours of that kind
        are one token.
        """
        n = len(word)
        best = [0.0] + [None] * n
        count = [0] * (n + 1)
        unknown = [False] * (n + 1)
        at = 0
        single = False

        def close(end: int) -> None:
            # every match that ends here is known: only now the lone character may enter
            if not single:
                score = best[end - 1] + self.unknown
                if best[end] is None or score > best[end]:
                    best[end], unknown[end] = score, True
                    count[end] = count[end - 1] + (not unknown[end - 1])

        matches = () if self.empty else self.automaton.iter(word)
        for last, (length, score) in matches:
            end = last + 1
            while at < end:
                if at:
                    close(at)
                at += 1
                single = False
            start = end - length
            total = best[start] + score
            if length == 1:
                single = True
            if best[end] is None or total > best[end]:
                best[end], unknown[end], count[end] = total, False, count[start] + 1
        while at <= n:
            if at:
                close(at)
            at += 1
            single = False
        return count[n]

    def batch(self, texts: list[bytes]) -> np.ndarray:
        if len(self.chunks) > MAX_CHUNKS:
            self.reset()
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        idx = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        fresh, self.chunks.fresh = self.chunks.fresh, []
        while len(self.chunks) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        for i, c in enumerate(fresh, len(self.chunks) - len(fresh)):
            self.counts[i] = self.count(SPACE + c.decode())
        return np.bincount(np.repeat(np.arange(len(texts)), n), self.counts[idx], len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` for every row of ``docs``, from its whole text.

    The text is cut at ASCII white space, each chunk gets the space mark in
    front, and its best segmentation into pieces is counted, not built.

    Edge cases: null, empty or blank text has no tokens; repeated rows get
    equal counts; an empty table gives an empty result.

    One pass over the scan, no shuffle; a worker keeps the automaton, one
    Arrow batch and a bounded cache of chunk counts.
    """
    short_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(("counts", vocabulary_path), lambda: Counter(read_vocabulary(vocabulary_path)))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.batch(b.column(1).cast(pa.binary()).to_pylist()))], names=["doc_id", "n_tokens"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long")
