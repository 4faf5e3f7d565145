"""Packing: sum-of-squares online packing of token streams into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import short_batches
from tallyframe.llm.tokens import chunk_tokenizer


class SumOfSquares:
    """Online packer of one stream into windows of ``size`` tokens.

    ``levels[h]`` counts the partially filled windows at fill ``h``. A document
    goes to the level (0: a new window) that leaves the smallest sum of squared
    counts; ties go to the fullest level. A window that is full, or ``good``
    full, leaves the array and counts no more.

    A document of more than ``size`` tokens first fills whole windows. When the
    stream ends, or ``max_open`` windows are open, the open windows are merged
    by the same array: the fullest takes the whole contents of the fullest others
    that fit, then whole pieces of the emptiest one, and only what is still
    missing is cut from it. So an emitted window holds one cut at most. The last one's
    tokens are cut at powers of two, which need no padding.

    ``tokens`` counts what was emitted: filled by ``placing`` documents, as parts of
    ``long`` ones, and in the end whole (``merged``) or ``cut``.
    """

    def __init__(self, size: int = 2048, max_open: int = 4096, good: float = 0.99):
        self.size, self.max_open, self.good = size, max_open, -(-size * good // 1)
        self.levels = np.zeros(size + 1, np.int64)
        self.windows: list[list[list[tuple]]] = [[] for _ in range(size)]
        self.open = 0
        self.tokens = dict.fromkeys(("placing", "long", "merged", "cut"), 0)

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Place a document; yields windows it fills, as lists of (doc, start, ids)."""
        start, n = 0, len(ids)
        while n - start >= self.size:
            self.tokens["long"] += self.size
            yield [(doc, start, ids[start : start + self.size])]
            start += self.size
        rest = n - start
        if not rest:
            return
        piece = (doc, start, ids[start:].copy())
        h = self._level(rest)
        window = self._take(h) if h else []
        window.append(piece)
        if h + rest >= self.good:
            self.tokens["placing"] += h + rest
            yield window
        else:
            self._put(h + rest, window)
        if self.open >= self.max_open:
            yield from self.close()

    def _take(self, h: int) -> list[tuple]:
        self.levels[h] -= 1
        self.open -= 1
        return self.windows[h].pop()

    def _put(self, h: int, window: list[tuple]) -> None:
        self.windows[h].append(window)
        self.levels[h] += 1
        self.open += 1

    def _level(self, rest: int) -> int:
        here = self.levels[: self.size - rest + 1]
        cost = 2 * self.levels[rest : self.size + 1] + 1
        cost[max(0, int(self.good) - rest) :] = 0  # a window that is done leaves no count
        cost[1:] += 1 - 2 * here[1:]
        if rest >= self.good:
            return 0
        usable = np.flatnonzero(here)
        usable = usable[usable > 0]
        if not len(usable):
            return 0
        best = usable[::-1][np.argmin(cost[usable[::-1]])]
        return int(best) if cost[best] <= cost[0] else 0

    def close(self) -> Iterator[list[tuple]]:
        while self.open > 1:
            h = int(np.flatnonzero(self.levels)[-1])
            window, whole, cut = self._take(h), h, 0
            while h < self.good and (fits := np.flatnonzero(self.levels[: self.size - h + 1])).size:
                window += self._take(int(fits[-1]))
                h += int(fits[-1])
            whole = h
            if h < self.good and self.open:
                least = int(np.flatnonzero(self.levels)[0])
                source = sorted(self._take(least), key=lambda p: len(p[2]))
                kept: list[tuple] = []
                while source:  # whole pieces, the longest that fits first
                    piece = source.pop()
                    if len(piece[2]) <= self.size - h and h < self.good:
                        window.append(piece)
                        h += len(piece[2])
                    else:
                        kept.append(piece)
                whole = h
                if h < self.good:
                    doc, start, ids = kept.pop()  # the shortest one left is longer than the gap
                    cut = self.size - h
                    window.append((doc, start, ids[:cut]))
                    kept.append((doc, start + cut, ids[cut:].copy()))
                    h = self.size
                if kept:
                    self._put(sum(len(p[2]) for p in kept), kept)
            if h < self.good:  # nothing else is open
                self._put(h, window)
                break
            self.tokens["merged"] += whole
            self.tokens["cut"] += cut
            yield window
        if not self.open:
            return
        rest = self._take(int(np.flatnonzero(self.levels)[0]))
        left = sum(len(p[2]) for p in rest)
        self.tokens["cut"] += left
        window, room = [], 0
        for doc, start, ids in rest:
            while len(ids):
                if not room:
                    if window:
                        yield window
                    room = 1 << (left.bit_length() - 1)
                    left -= room
                    window = []
                k = min(room, len(ids))
                window.append((doc, start, ids[:k]))
                start, ids, room = start + k, ids[k:], room - k
        if window:
            yield window


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all ``docs`` into token sequences of at most ``size``.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, with ``with_ids``, the ``ids`` themselves. A
    document's ids are those of its whole text and ``end_id``.

    Edge cases: a null or empty text is the end id alone; a null id stays
    null; repeated rows are packed each; an empty table gives no pieces.

    Each input split is one online stream with its own level array: tokenise,
    place and emit run in one pass over the scan without any shuffle, and a
    lost task is simply run again. A task holds one Arrow batch and its open
    windows, which ``SumOfSquares`` bounds. Sequence ids carry the split's
    number in their high bits.
    """
    short_batches(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = chunk_tokenizer(tokenizer_path), SumOfSquares(size)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        cols: list[list] = [[] for _ in range(8)]

        def emit(windows: Iterator[list[tuple]]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for (doc_id, tokens), start, ids in window:
                    for c, v in zip(cols, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset, ids)):
                        c.append(v)
                    offset += len(ids)
                sequence += 1

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = PIECES.replace(" long", "").split(", ")
            if with_ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
                names = [*names, "ids"]
            for c in cols:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc_id, ids in zip(ids_of, tokenizer.encode(texts)):
                ids = np.append(ids, np.int32(end_id))
                emit(packer.add((doc_id, len(ids)), ids))
            if cols[0]:
                yield flush()
        emit(packer.close())
        if cols[0]:
            yield flush()

    return d.mapInArrow(run, schema)
